import gzip
import hashlib
import random

import public_tokenizers
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from frameloom.llm import queries, tokencount, warc

JSON = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", "Hello  world\n\n x", "é ß ñ 123 don't", "<|endoftext|> a <|endoftext|>", "日本 \u00a0 \u2003x", "a" * 20_000, "\x00\x1f\x85", None]


def reference(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    return [len(t.encode(x or "", add_special_tokens=False)) for x in texts]


def test_counts_are_the_library_s(spark):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(100, TEXTS[1], 1), (None, "x y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, content int")
    want = reference([t for _, t, _ in rows])
    got = {(r.doc_id): r for r in tokencount.count_tokens(docs, tokenizer_path=JSON, limit=10).collect()}
    assert [got[i].n_tokens for i, _, _ in rows] == want
    assert [got[i].n_bytes for i, _, _ in rows] == [len((t or "").encode()) for _, t, _ in rows]
    assert [got[i].over_limit for i, _, _ in rows] == [n > 10 for n in want]


def test_long_runs_of_one_character(spark):
    texts = ["a" + " " * 1_200_000 + "b", " " * 1_000_000, "x" * 300_000, "\n" * 200_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(docs, tokenizer_path=JSON).collect()}
    assert [got[i] for i in range(len(texts))] == reference(texts)


def test_the_query_encodes_nothing_the_second_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokencount, "scratch_root", lambda spark: str(tmp_path))
    spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    first = queries.op6_token_counts(spark, str(tmp_path)).collect()
    cache = spark.read.parquet(tokencount.shared_cache(spark))
    assert cache.count() == 2

    def refuse(*_):
        def run(batches):
            assert not any(len(b) for b in batches)
            yield from ()

        return run

    monkeypatch.setattr(tokencount, "_encode", refuse)
    assert sorted(queries.op6_token_counts(spark, str(tmp_path)).collect()) == sorted(first)


def test_a_table_reads_no_other_table_s_cache(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokencount, "scratch_root", lambda spark: str(tmp_path))
    large = [(i, f"text {i}") for i in range(50)]
    for name, rows in (("large", large), ("small", [(1, "text 1"), (2, "text 1"), (3, "more")])):
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
    for name in ("large", "small", "small/", "large"):
        got = queries.op6_token_counts(spark, f"{tmp_path}/{name}").collect()
        assert len(got) == (50 if name == "large" else 3)
        cached = spark.read.parquet(tokencount.shared_cache(spark)).groupBy("table").count().collect()
        assert sorted(r["count"] for r in cached) in ([50], [2, 50])


def test_the_cache_serves_hits_and_takes_misses(spark, tmp_path):
    path = str(tmp_path / "cache")
    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "doc_id long, text string")
    how = {"tokenizer_path": JSON, "cache_path": path}
    tokencount.count_tokens(docs, **how).collect()
    cached = spark.read.parquet(path)
    assert cached.count() == 2
    # a count in the cache is believed; only what is missing is encoded
    poisoned = cached.withColumn("n_tokens", F.lit(999).cast("long"))
    poisoned.write.parquet(path + "2")
    more = docs.union(spark.createDataFrame([(4, "new text")], docs.schema))
    got = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(more, tokenizer_path=JSON, cache_path=path + "2").collect()}
    assert got == {1: 999, 2: 999, 3: 999, 4: 2}
    assert spark.read.parquet(path + "2").count() == 3
    other = tokencount.count_tokens(docs, tokenizer_path=public_tokenizers.path("piece_bpe_32k.model"), cache_path=path + "2")
    assert all(r.n_tokens < 999 for r in other.collect())
    assert tokencount.count_tokens(docs.limit(0), tokenizer_path=JSON).count() == 0


def pages(spark):
    rng = random.Random(2)
    long = ["<html>" + "x" * 1000, "é" * 500, "WARC/1.1\r\n\r\n" + "y" * 2000]
    rows = [(i, f"http://{rng.choice('abc')}.com/{rng.randrange(4)}?q=é", rng.choice([*long, "short", "short", None, ""])) for i in range(120)]
    rows += [(500, None, long[0]), (501, "no scheme", "\r\n\r\nContent-Length: 5\r\n\r\n"), (502, "http://x/\r\nEvil: 1", "z" * 999)]
    rows += [(499, "http://x", "once" * 400), (499, "http://x", "once" * 400)]
    return rows, spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string").repartition(4)


def test_round_trip_and_order(spark):
    rows, df = pages(spark)
    got = warc.warc_round_trip(df).collect()
    assert len(got) == len(rows)
    last = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000:
            last[b] = max(i, last.get(b, i))
    html = {i: (h or "").encode() for i, _, h in rows}
    for r in got:
        b = html[r.page_id]
        first = last.get(b, r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(b), hashlib.sha1(b).hexdigest())
        assert (r.record_type, r.refers_to) == (("response", None) if first == r.page_id else ("revisit", first))
    keys = [(r.url_key, r.capture_time) for r in got]
    assert keys == sorted(keys)
    assert {r.page_id for r in got if r.url_key == ""} == {500}


def test_archives_are_sorted_runs_of_single_members(spark, tmp_path):
    rows, df = pages(spark)
    warc.write_archives(df, str(tmp_path / "w"), archive_bytes=2000)
    files = sorted((tmp_path / "w").glob("*.txt"))
    assert len(files) > 8
    n = 0
    for f in files:
        data = f.read_bytes()
        records = list(warc.parse_archive(data))
        assert sum(len(x) for x in [data]) < 2000 + 1500
        n += len(records)
        assert all(h["WARC-Type"] in ("response", "revisit") and "Evil" not in h for _, h, _ in records)
        # an offset alone is enough to read a record; the whole file is one gzip too
        offset, headers, block = records[-1]
        assert list(warc.parse_archive(data[offset:])) == [(0, headers, block)]
        assert [(h, b) for _, h, b in warc.parse_records(gzip.decompress(data))] == [(h, b) for _, h, b in records]
        keys = [(warc.url_key_of(h["WARC-Target-URI"]), h["WARC-Date"]) for _, h, _ in records]
        assert keys == sorted(keys)
    assert n == len(rows)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.warc_round_trip(empty).count() == 0


def test_any_page_id_and_many_ranges(spark, tmp_path):
    ids = [1 << 62, -(1 << 63), (1 << 63) - 1, -5, None, None, 300_000_000_000, 7, 7]
    rows = [(x, "http://hot.example/", "p" * (2000 if i % 2 else 3)) for i, x in enumerate(ids)]
    rows += [(i, "http://hot.example/", "q%d" % i) for i in range(3000)]
    rows.append((1, "http://a/", "long é" * 700_000))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    path = str(tmp_path / "w")
    warc.write_archives(df, path, archive_bytes=3000)
    chunks = warc.read_archives(spark, path)
    merged = warc.merge_histories(chunks, per_range=100)
    assert merged.rdd.getNumPartitions() > 20
    got = merged.collect()
    assert len(got) == len(rows)
    keys = [(r.url_key, r.capture_time, -(1 << 63) if r.page_id is None else r.page_id) for r in got]
    assert keys == sorted(keys)
    assert all(len(r.capture_time) == 20 for r in got)
    by_text = {r.page_id: r for r in got if r.payload_digest == hashlib.sha1(b"p" * 2000).hexdigest()}
    assert {i: r.refers_to for i, r in by_text.items()} == {
        -(1 << 63): 7, -5: 7, None: 7, 7: None
    }
    assert max(r.payload_bytes for r in got) == len(("long é" * 700_000).encode())


def test_foreign_archives_may_be_plain_and_unsorted(spark, tmp_path):
    def made(page, url, body):
        block = b"HTTP/1.1 200 OK\r\n\r\n" + body
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{page}>\r\nWARC-Date: 2024-01-01T00:00:0{page}Z\r\nWARC-Target-URI: {url}\r\n"
        head += f"WARC-Payload-Digest: sha1:{hashlib.sha1(body).hexdigest()}\r\nContent-Length: {len(block)}\r\n\r\n"
        return head.encode() + block + b"\r\n\r\n"

    (tmp_path / "w").mkdir()
    plain = [made(i, f"http://{h}/", b"x" * i) for i, h in enumerate("dbca")]
    (tmp_path / "w" / "plain.warc").write_bytes(b"".join(plain))
    (tmp_path / "w" / "one.warc.gz").write_bytes(gzip.compress(b"".join(plain[::-1])))
    got = warc.merge_histories(warc.read_archives(spark, str(tmp_path / "w"))).collect()
    assert [r.url_key for r in got] == ["a)/", "a)/", "b)/", "b)/", "c)/", "c)/", "d)/", "d)/"]


@given(st.lists(st.lists(st.integers(0, 30).map(lambda x: ("k", "t", x)), min_size=1).map(sorted), max_size=60))
def test_chunks_open_in_time(chunks):
    entries = [[{"url_key": a, "capture_time": b, "page_id": c} for a, b, c in x] for x in sorted(chunks)]
    got = [warc._key(e) for e in warc._opened(iter(entries), least=2)]
    assert got == sorted(x for c in chunks for x in c)


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from([*"ab./?#:+é-H1", "://"]), max_size=12).map("".join))
def test_url_keys_agree(spark, url):
    got = spark.range(1).select(warc.url_key(F.lit(url)).alias("k")).first().k
    assert got == warc.url_key_of(url)


@given(st.lists(st.lists(st.integers(0, 9).map(lambda x: (x,))).map(sorted), max_size=9))
def test_loser_tree_merges(runs):
    assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)
