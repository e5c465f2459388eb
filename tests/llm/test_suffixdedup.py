import hashlib
import random

import numpy as np

from frameloom.llm import suffixdedup


def brute(rows, threshold=50):
    """rows: (order, text). The definition, string by string."""
    first, out = {}, []
    for doc, text in rows:
        b = (text or "").encode()
        for i in range(len(b) - threshold + 1):
            s = b[i : i + threshold]
            first[s] = min(first.get(s, doc), doc)
    for doc, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - threshold + 1):
            if first[b[i : i + threshold]] < doc:
                gone[i + 1 : i + 1 + threshold] = True
        spans = int((gone[1:] & ~gone[:-1]).sum())
        left = bytes(c for c, g in zip(b, gone[1:]) if not g)
        out.append((doc, len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out)


def corpus(n, seed, alphabet):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 9)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(rng.choice([8, 9, 10, 12, 40])) for _ in range(12)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.35:  # a near copy
            t = list(rng.choice(texts))
            for _ in range(rng.randrange(0, 5)):
                if t:
                    t[rng.randrange(len(t))] = rng.choice(alphabet)
            texts.append("".join(t))
        elif texts and kind < 0.45:  # a piece of another, of about the threshold
            t = rng.choice(texts)
            i = rng.randrange(len(t) + 1)
            texts.append(text(3) + t[i : i + rng.randrange(44, 60)] + text(2))
        else:
            parts = [text(rng.randrange(0, 60)) for _ in range(3)]
            parts.insert(1, rng.choice(passages) if rng.random() < 0.5 else "")
            texts.append("".join(parts))
    return texts


def found(df):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_matches_the_definition(spark):
    texts = corpus(260, 2, "abcdefghijklmnop") + corpus(60, 3, "aé") + ["x" * 300, "x" * 49, "x" * 120, "", "ab" * 90]
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    rows = list(zip(ids, texts)) + [(9001, None), (-5, "x" * 50)]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, doc string").repartition(5)
    got = suffixdedup.dedup_substrings(docs)
    assert found(got) == brute(rows)
    texts_by_id = dict(rows)
    for r in got.collect():
        b = (texts_by_id[r.doc_id] or "").encode()
        assert sum(s.stop - s.start for s in r.spans) == r.n_removed
        assert "�" not in r.kept_text and len(r.kept_text.encode()) >= len(b) - r.n_removed


def test_repeated_and_null_ids(spark):
    a, b = corpus(2, 9, "abcdefgh")
    a, b = a + "q" * 60, b + "r" * 70
    rows = [(1, a), (1, a), (2, a + b), (None, b), (None, "z" * 80), (3, None)]
    got = suffixdedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r.n_removed)
    assert by_id[1][0] == by_id[1][1]
    assert by_id[2][0] >= len(a) and len(b) in by_id[None] and by_id[3] == [0]


def test_empty_table(spark):
    assert suffixdedup.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_small_pieces_and_hot_names_change_nothing(spark, monkeypatch):
    rng = random.Random(7)
    phrase = "sixteen letters!" + "and some more of it"
    texts = corpus(120, 5, "abcd") + ["".join(rng.choices("xyz ", k=rng.randrange(60))) + phrase + rng.choice(["", "tail of the phrase " * 2]) for _ in range(200)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = brute(rows)
    monkeypatch.setattr(suffixdedup, "PIECE", 5)
    assert found(suffixdedup.dedup_substrings(docs)) == want
    names = docs.select("text").mapInArrow(suffixdedup._seed_names(50), "name long").groupBy("name").count()
    hot = [r.name for r in names.where("count > 5").collect()]
    assert len(hot) > 5
    monkeypatch.setattr(suffixdedup, "hot_names", lambda texts, threshold: hot)
    assert found(suffixdedup.dedup_substrings(docs)) == want


def test_a_hundred_thousand_rows_with_one_string_in_common(spark):
    rng = random.Random(8)
    side = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=30))
    rows = [(i, side() + "the common words and some more that all have" + side()) for i in range(100_000)]
    for i in range(0, 100_000, 97):
        rows[i] = (i, side()[:9] + rows[(i * 7 + 1) % 90_000][1])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    texts = docs.withColumnRenamed("doc_id", "doc")
    assert len(suffixdedup.hot_names(texts, 50)) > 0
    assert found(suffixdedup.dedup_substrings(docs)) == brute(rows)


def test_a_text_of_three_megabytes(spark):
    rng = np.random.default_rng(4)
    long = bytes(rng.integers(97, 123, 3_000_000, dtype=np.uint8)).decode()
    rows = [(2, long), (1, long[1_500_000:1_500_300] + "#" + long[-60:]), (3, long[:70]), (4, long[100:149])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(suffixdedup.dedup_substrings(docs)) == brute(rows)
