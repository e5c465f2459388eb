"""Write pages as WARC archives, read them back, and merge their indexes.

Writing: payloads are digested, equal ones get one ``response`` record and the
others ``revisit`` records, and each task writes its captures in order of URL
key, time and page: a locally sorted run. A record is a gzip member of its own,
so that an index entry's offset is enough to read it; an archive ends at
``archive_bytes``. Files are written by Spark's text writer, a row for each
archive, so any file system that Spark knows will do. (It names them ``.txt``
and ends each with its separator, here a zero byte, which is gzip's padding.)

Reading: each archive is walked member by member. Its entries, in the order of
the file, are a sorted run, or several where a foreign archive isn't sorted, and
are kept as chunks of a run.

Merging: chunks are cut at the bounds of ranges of (URL key, time, page) and
dealt to their range. A task gets its chunks by their first entries, and a loser
tree merges the entries of those that are open. A chunk opens when the merge
comes to its first entry, so the task holds the chunks that overlap, and no run
or range as a whole.

Defined cases: a null payload is an empty one; a null URL has the empty key.
Page ids may be any 64-bit number or null; the time made of one stays within
``SPAN_SECONDS``. Payloads below ``least`` bytes are all responses. Of rows that
repeat the largest page id of an equal payload, all are responses; a row with a
null id revisits that page, if there is one with an id. An empty table makes an
empty history. Only the three named columns are read.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm.shared import scratch_path, written

#: Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
LENGTH_FIELD = "X-Payload-Length"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Times made of page ids fall into so many seconds, some 34 years.
SPAN_SECONDS = 1 << 30
#: Entries of a run that travel together.
CHUNK = 256

ENTRY = (
    "archive string, offset long, page_id long, url_key string, capture_time string, "
    "record_type string, payload_digest string, payload_bytes long, refers_to long"
)
CHUNKS = f"run string, low struct<url_key: string, capture_time: string, page: long>, entries array<struct<{ENTRY}>>"
_ENTRY = pa.struct([(x.split()[0], pa.int64() if x.endswith("long") else pa.string()) for x in ENTRY.split(", ")])
_LOW = pa.struct([("url_key", pa.string()), ("capture_time", pa.string()), ("page", pa.int64())])


def url_key(url: Column) -> Column:
    """Sort key of a URL: the host's labels reversed, then the rest."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    tail = F.regexp_extract(rest, r"(?s)^[^/?#]*(.*)$", 1)
    return F.when(rest == "", "").otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), tail)
    )


def captures(pages: DataFrame, *, page_id: str, url: str, payload: str, least: int) -> DataFrame:
    """Each page with its digest and, for a revisit, the page it refers to."""
    body = F.coalesce(F.col(payload), F.lit(""))
    seen = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.coalesce(F.col(url), F.lit("")).alias("url"),
        body.alias("payload"),
        F.sha1(body.cast("binary")).alias("digest"),
        F.octet_length(body).cast("long").alias("n_bytes"),
    )
    first = (
        seen.where(F.col("n_bytes") >= least)
        .groupBy("digest")
        .agg(F.max("page_id").alias("first_id"), F.count("*").alias("copies"))
        .where(F.col("copies") > 1)
        .select("digest", "first_id")
    )
    # Short payloads find no partner here: their digests were left out above.
    return seen.join(first, "digest", "left").withColumn(
        "refers_to", F.when(~F.col("first_id").eqNullSafe(F.col("page_id")), F.col("first_id"))
    )


def record(page: Column, time: Column) -> Column:
    """The text of a record."""
    line = "\r\n"
    revisit = F.col("refers_to").isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    block = F.concat(http, body)
    return F.concat(
        F.lit(VERSION + line + "WARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit(line + "WARC-Record-ID: <urn:page:"),
        F.coalesce(page.cast("string"), F.lit("")),
        F.lit(">" + line + "WARC-Date: "),
        time,
        F.lit(line + "WARC-Target-URI: "),
        F.regexp_replace("url", r"[\r\n]", ""),
        F.lit(line + "WARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.when(
            revisit,
            F.concat(
                F.lit(line + "WARC-Refers-To: <urn:page:"),
                F.col("refers_to").cast("string"),
                F.lit(f">{line}WARC-Profile: {REVISIT_PROFILE}{line}{LENGTH_FIELD}: "),
                F.col("n_bytes").cast("string"),
            ),
        ).otherwise(""),
        F.lit(line + "Content-Type: application/http; msgtype=response" + line + "Content-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(line + line),
        block,
        F.lit(line + line),
    )


def _packed(archive_bytes: int):
    """Records, in order, to archives of gzip members, at most one record longer
    than ``archive_bytes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, size = [], 0
        for batch in batches:
            for value in batch.column(0):
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = z.compress(value.as_buffer()) + z.flush()
                members.append(member)
                size += len(member)
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], names=["archive"])
                    members, size = [], 0
        if members:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], names=["archive"])

    return run


def write_archives(
    pages: DataFrame,
    path: str,
    *,
    page_id: str = "page_id",
    url: str = "url",
    payload: str = "html",
    least: int = 1000,
    epoch: str = "2024-01-01 00:00:00",
    archive_bytes: int = 16 << 20,
) -> None:
    """Write one record per row of ``pages``, as archives below ``path``.

    The table has no times of capture; page ids, modulo ``SPAN_SECONDS``, as
    seconds after ``epoch`` stand for them. Each file is a run sorted by URL key,
    time and page id.
    """
    made = captures(pages, page_id=page_id, url=url, payload=payload, least=least)
    after = F.coalesce(F.pmod("page_id", F.lit(SPAN_SECONDS)), F.lit(0))
    time = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(epoch)) + after), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    records = (
        made.withColumns({"key": url_key(F.regexp_replace("url", r"[\r\n]", "")), "time": time})
        .sortWithinPartitions("key", "time", "page_id")
        .select(record(F.col("page_id"), F.col("time")).cast("binary").alias("record"))
    )
    (
        records.mapInArrow(_packed(archive_bytes), "archive binary")
        # The same bytes under the type that the text writer takes.
        .select(F.col("archive").cast("string").alias("value"))
        .write.option("lineSep", "\0")
        .option("maxRecordsPerFile", 1)
        .text(path)
    )


def _page_number(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def parse_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each record of uncompressed bytes."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8", "replace").split("\r\n")
        if lines[0] != VERSION:
            raise ValueError(f"no record at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        length = int(headers["Content-Length"])
        yield at, headers, data[stop + 4 : stop + 4 + length]
        at = stop + 4 + length + 4


def parse_archive(data: bytes, piece: int = 1 << 16) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each record of an archive, plain or gzipped.

    An offset is that of the record, or of the gzip member which holds it. One
    member is held at a time.
    """
    if data[:2] != b"\x1f\x8b":
        yield from parse_records(data)
        return
    at, view = 0, memoryview(data)
    while at < len(data) and data[at] != 0:
        z, parts, end = zlib.decompressobj(31), [], at
        while not z.eof:
            if end >= len(data):
                raise ValueError(f"the member at byte {at} is cut off")
            parts.append(z.decompress(view[end : end + piece]))
            end = min(end + piece, len(data))
        for _, headers, block in parse_records(b"".join(parts)):
            yield at, headers, block
        at = end - len(z.unused_data)


def _key(entry: dict) -> tuple[str, str, int]:
    """What entries are ordered by; null pages come first."""
    page = entry["page_id"]
    return entry["url_key"], entry["capture_time"], -(1 << 63) if page is None else page


def url_key_of(url: str) -> str:
    """``url_key`` of one URL that is at hand as Python text."""
    scheme, mark, rest = url.partition("://")
    if not (mark and scheme.isascii() and scheme[:1].isalpha() and all(c.isalnum() or c in "+.-" for c in scheme)):
        rest = url
    if not rest:
        return ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    return ",".join(reversed(rest[:end].lower().split("."))) + ")" + rest[end:]


def _entries(path: str, content: bytes) -> Iterator[dict]:
    for offset, headers, block in parse_archive(content):
        kind = headers["WARC-Type"]
        body = block[block.index(b"\r\n\r\n") + 4 :]
        told = headers["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "response" and hashlib.sha1(body).hexdigest() != told:
            raise ValueError(f"{path}: payload at byte {offset} doesn't match its digest")
        length = headers.get(LENGTH_FIELD)
        yield {
            "archive": path,
            "offset": offset,
            "page_id": _page_number(headers["WARC-Record-ID"]),
            "url_key": url_key_of(headers["WARC-Target-URI"]),
            "capture_time": headers["WARC-Date"],
            "record_type": kind,
            "payload_digest": told,
            "payload_bytes": len(body) if kind == "response" else length and int(length),
            "refers_to": _page_number(headers.get("WARC-Refers-To")),
        }


def _chunk_batch(chunks: list[tuple[str, list[dict]]]) -> pa.RecordBatch:
    lows = [dict(zip(("url_key", "capture_time", "page"), _key(entries[0]))) for _, entries in chunks]
    columns = [
        pa.array([run for run, _ in chunks], pa.string()),
        pa.array(lows, _LOW),
        pa.array([entries for _, entries in chunks], pa.list_(_ENTRY)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["run", "low", "entries"])


def _index_archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of the runs of (path, content) rows."""
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            path, n, chunk = path.as_py(), 0, []
            for entry in _entries(path, content.as_py()):
                falls = chunk and _key(entry) < _key(chunk[-1])
                if falls or len(chunk) == CHUNK:
                    yield _chunk_batch([(f"{path} {n}", chunk)])
                    n, chunk = n + bool(falls), []
                chunk.append(entry)
            if chunk:
                yield _chunk_batch([(f"{path} {n}", chunk)])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The index of all archives below ``path``: chunks of sorted runs.

    A revisit has no payload of its own; its ``payload_bytes`` come from a header
    field that ``write_archives`` adds, and are null where that is missing.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return written(files.mapInArrow(_index_archive, CHUNKS), "warc-index")


class LoserTree:
    """Merge k sorted iterators: a tournament that replays one path per item."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.heads: list[tuple | None] = [next(r, None) for r in runs]
        k = len(runs)
        self.losers = [-1] * max(k, 1)  # losers[0] is the overall winner
        for i in range(k):
            self._enter(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and x is not None
        return (x, a) < (y, b)

    def _enter(self, i: int) -> None:
        """Play run i from its leaf upward until a place is free or the root."""
        node = (i + len(self.runs)) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = i
                return
            if self._beats(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator[tuple]:
        return self.until(None)

    def until(self, key: object) -> Iterator[tuple]:
        """Items in order, up to those whose first field is not below ``key``."""
        while self.runs:
            i = self.losers[0]
            head = self.heads[i]
            if head is None or (key is not None and head[0] >= key):
                return
            yield head
            self.heads[i] = next(self.runs[i], None)
            self._enter(i)

    def left(self) -> list[Iterator[tuple]]:
        """The runs that still have items."""
        return [chain([head], run) for head, run in zip(self.heads, self.runs) if head is not None]


def _cut_at(bounds: list[tuple]):
    """Chunks cut at ``bounds``, with the number of the range that each is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks, ranges = [], []
            for name, entries in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                at = [bisect_right(bounds, _key(e)) for e in entries]
                start = 0
                for i in range(1, len(at) + 1):
                    if i == len(at) or at[i] != at[start]:
                        chunks.append((name, entries[start:i]))
                        ranges.append(at[start])
                        start = i
            cut = _chunk_batch(chunks)
            yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), *cut.columns], names=["range", *cut.schema.names])

    return run


def _opened(chunks: Iterator[list[dict]], least: int = 16) -> Iterator[dict]:
    """Merge chunks that come in the order of their first entries.

    When the merge reaches the first entry of the next chunk, that one and as
    many more as are open are taken in and the tree is made anew, so that its
    making costs a constant for each chunk.
    """
    ahead = next(chunks, None)
    rest: list[Iterator[tuple]] = []
    n = 0
    while ahead is not None or rest:
        for _ in range(max(least, len(rest))):
            if ahead is None:
                break
            # The number keeps entries from being compared when keys are equal.
            rest.append(iter([(_key(e), n, i, e) for i, e in enumerate(ahead)]))
            n, ahead = n + 1, next(chunks, None)
        tree = LoserTree(rest)
        for item in tree.until(None if ahead is None else _key(ahead[0])):
            yield item[3]
        rest = tree.left()


def _merge_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunks = (entries for batch in batches for entries in (x.as_py() for x in batch.column(0)))
    out: list[dict] = []

    def flushed() -> pa.RecordBatch:
        return pa.RecordBatch.from_struct_array(pa.array(out, _ENTRY))

    for entry in _opened(chunks):
        out.append(entry)
        if len(out) == 4096:
            yield flushed()
            out.clear()
    if out:
        yield flushed()


def merge_histories(chunks: DataFrame, per_range: int = 100_000) -> DataFrame:
    """Index entries in global order of URL key, time and page.

    Ranges hold about ``per_range`` entries, and their bounds go down to the page,
    so the many captures of one URL spread over several. The driver gets some 30
    keys for each range, drawn by hash, to choose the bounds from.
    """
    facts = chunks.agg(F.sum(F.size("entries")).alias("entries"), F.count("*").alias("chunks")).first()
    ranges = max(1, -(-(facts["entries"] or 0) // per_range))
    one_in = max(1, facts["chunks"] // (32 * ranges))
    bounds: list[tuple] = []
    if ranges > 1:
        drawn = chunks.where(F.pmod(F.xxhash64("run", "low"), F.lit(one_in)) == 0).select("low.*").collect()
        keys = sorted(map(tuple, drawn))
        bounds = sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []
    dealt = chunks.mapInArrow(_cut_at(bounds), f"range int, {CHUNKS}").repartitionById(len(bounds) + 1, F.col("range"))
    return dealt.sortWithinPartitions("low").select("entries").mapInArrow(_merge_chunks, ENTRY)


def warc_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to scratch archives, read them back, merge the index."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, **options)
    return merge_histories(read_archives(spark, path))
