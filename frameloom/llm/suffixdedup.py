"""Bytes that repeat a string of an earlier document, by sorted ranks of thinned
positions.

A byte goes if a string of ``threshold`` bytes that covers it also starts in a
document with a smaller id. Sorting all positions of a corpus would move it
several times over, so positions are thinned first in a way that loses no
match: in every window of ``threshold`` bytes the position with the least hash
of its next ``SEED`` bytes is an anchor. Equal windows have equal anchors.

Anchors and windows then go through two sorted rounds of prefix doubling. Ranks
are 64-bit names (hashes) of strings rather than places in the order:

* length ``SEED``: Spark sorts anchors by the name of their first bytes. A name
  that only one document holds is unique, and its anchors are done. So are those
  whose whole reach (all windows that they stand for) has the same name as in an
  earlier document: a match past the threshold. Of the others, the windows are
  open that have at least half of their remaining bytes on a side whose next
  bytes (by an 8-bit check, which only errs towards open) others share.
* length ``threshold``: each open window is a pair of ranks, of its first half
  and of the half at that offset. Spark sorts the pairs, and equal ones match.

So lengths grow from ``SEED`` to ``threshold`` in one step of halves rather than
by doubling at all positions, which would sort every byte's rank pair three times.

Copies are dropped from the sorting as soon as they are known: each task does
so for its own rows before the shuffle, so a string that a third of all
documents hold arrives as one row from each batch. A name that many documents
hold in different surroundings is dealt to several tasks by its reach, and a task
holds no more than ``PIECE`` rows of a name at once.

Defined cases: null texts are empty. Texts are UTF-8 bytes and whole. Matches
never cross documents, and repeats inside a document don't count. Of rows that
share an id, equal ones have equal results, and others are ordered by a hash
of their texts; null ids come last. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm import textnum as tn
from frameloom.llm.shared import written

U64 = tn.U64
SEED = 16
#: Bits of a packed place: start of the reach, windows in it, where in it the
#: anchor is, and checks of the bytes on its left and its right.
_AT, _WIDTH, _ANCHOR, _LEFT = 31, 23, 16, 8
#: Documents that a task looks at together, which bounds what it holds.
TOGETHER = 4096
#: Rows of one name that a task holds at most, and tasks for a hot name.
PIECE, SALTS = 1 << 18, 64
ROWS = "name long, reach long, doc long, place long"
SPANS = "doc long, start long, stop long, open boolean"


def _names(p: np.ndarray, inv: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of the byte strings [a, b)."""
    return tn.mix((p[b] - p[a]) * inv[a] + (b - a).astype(U64) * U64(0xD6E8FEB86659FD93))


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least value in each window of ``width``."""
    done, m = 1, h
    while done * 2 <= width:
        m = np.minimum(m[:-done], m[done:])
        done *= 2
    rest = width - done
    return np.minimum(m[:-rest], m[rest:]) if rest else m


def anchors(data: np.ndarray, offs: np.ndarray, threshold: int) -> tuple[np.ndarray, ...]:
    """(document, start, windows, anchor) of each run of windows with one anchor.

    Places are those of ``data``; ``windows`` is how many windows, from the one
    at ``start`` on, have that anchor.
    """
    width = threshold - SEED + 1
    none = np.zeros(0, np.int64)
    if len(data) < threshold:
        return none, none, none, none
    p = tn.prefix_hashes(data)
    _, inv = tn.powers(len(data) + 1)
    n = len(data) - SEED + 1
    h = tn.mix((p[SEED:] - p[:-SEED]) * inv[:n])
    order = (h & U64(0xFFFFFFFF00000000)) | np.arange(n, dtype=U64)
    best = (_least(order, width) & U64(0xFFFFFFFF)).astype(np.int64)
    # windows that lie inside one document
    lengths = np.diff(offs)
    inside = np.zeros(len(data) + 1, np.int8)
    fits = lengths >= threshold
    inside[offs[:-1][fits]] += 1
    inside[offs[1:][fits] - threshold + 1] -= 1
    valid = np.cumsum(inside[: len(best)]) > 0
    first = np.ones(len(best), bool)
    first[1:] = (best[1:] != best[:-1]) | ~valid[:-1]
    first[offs[:-1][offs[:-1] < len(best)]] = True
    start = np.flatnonzero(first & valid)
    if not len(start):
        return none, none, none, none
    # a run ends where the next begins, or with its document's last window
    doc = np.searchsorted(offs, start, "right") - 1
    stop = np.minimum(np.append(start[1:], len(best)), offs[doc + 1] - threshold + 1)
    return doc, start, stop - start, best[start]


def _merged(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of intervals of each document."""
    if not len(doc):
        return doc, start, stop
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    # lay documents end to end, so that a running maximum serves all
    fresh = np.ones(len(doc), bool)
    fresh[1:] = doc[1:] != doc[:-1]
    base = np.cumsum(fresh) * (int(stop.max()) + 1)
    reach = np.maximum.accumulate(stop + base)
    fresh[1:] |= start[1:] + base[1:] > reach[:-1]
    at = np.flatnonzero(fresh)
    return doc[at], start[at], np.maximum.reduceat(stop, at)


def _split_copies(keys: list[np.ndarray], doc: np.ndarray) -> np.ndarray:
    """Whether each row's keys are those of a row with a smaller document."""
    order = np.lexsort((doc, *keys[::-1]))
    same = np.ones(len(doc), bool)
    for k in keys:
        s = k[order]
        same[1:] &= s[1:] == s[:-1]
    same[:1] = False
    group = np.cumsum(~same) - 1
    least = doc[order][np.flatnonzero(~same)] if len(doc) else doc
    out = np.zeros(len(doc), bool)
    out[order] = doc[order] > least[group] if len(doc) else False
    return out


def _slices(batches: Iterator[pa.RecordBatch], n: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, n):
            yield batch.slice(i, n)


def _even(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Even names for spans that only pass through a sort, spread over it."""
    return tn.mix(doc.astype(U64) ^ tn.mix(start.astype(U64))) & ~U64(1)


def _anchor_rows(threshold: int):
    """Rows of anchors (odd names) and of spans known to be copies (even ones)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            ids = batch.column(0).to_numpy()
            data, offs = tn.utf8(batch.column(1))
            found = []
            for a, b in tn.blocks(offs):
                part, at = data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
                doc, start, n, anchor = anchors(part, at, threshold)
                if not len(doc):
                    continue
                p = tn.prefix_hashes(part)
                _, inv = tn.powers(len(part) + 1)
                name = _names(p, inv, anchor, anchor + SEED) | U64(1)
                stop = start + n - 1 + threshold
                reach = _names(p, inv, start, stop) + tn.mix((anchor - start).astype(U64))
                half = (threshold - SEED + 1) // 2
                lo = np.maximum(anchor - half, at[doc])
                hi = np.minimum(anchor + SEED + half, at[doc + 1])
                left = _names(p, inv, lo, anchor) & U64(0xFF)
                right = _names(p, inv, anchor + SEED, hi) & U64(0xFF)
                place = (
                    ((start - at[doc]).astype(U64) << U64(_AT))
                    | (n.astype(U64) << U64(_WIDTH))
                    | ((anchor - start).astype(U64) << U64(_ANCHOR))
                    | (left << U64(_LEFT))
                    | right
                )
                found.append((name, reach, ids[a:b][doc], place))
            if not found:
                continue
            name, reach, doc, place = (np.concatenate(x) for x in zip(*found))
            copy = _split_copies([name, reach], doc)
            start = (place >> U64(_AT)).astype(np.int64)
            stop = start + ((place >> U64(_WIDTH)) & U64(0xFF)).astype(np.int64) - 1 + threshold
            d, s, e = _merged(doc[copy], start[copy], stop[copy])
            keep = ~copy
            columns = (
                np.concatenate([name[keep], _even(d, s)]).view(np.int64),
                np.concatenate([reach[keep].view(np.int64), e]),
                np.concatenate([doc[keep], d]),
                np.concatenate([place[keep].view(np.int64), s]),
            )
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["name", "reach", "doc", "place"])

    return run


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, bool]]:
    """(columns, cut, again) of rows sorted by (name, reach, doc), piece by piece.

    A piece keeps the rows of a name together, but for names of more than
    ``most`` rows, which come in several pieces; ``cut`` marks their rows. To go
    on from the piece before, such a piece begins with the first of the last
    equal reaches there, which ``again`` tells.
    """
    rest: list[np.ndarray] | None = None
    cut_name, again = None, False
    for batch in batches:
        now = [batch.column(i).to_numpy() for i in range(4)]
        if rest is not None:
            now = [np.concatenate([a, b]) for a, b in zip(rest, now)]
        if not len(now[0]):
            continue
        cut = int(np.searchsorted(now[0], now[0][-1], "left"))
        if cut:
            yield [x[:cut] for x in now], now[0][:cut] == cut_name, again
            now, cut_name, again = [x[cut:] for x in now], None, False
        if len(now[0]) > most:
            cut_name = now[0][-1]
            yield now, now[0] == cut_name, again
            first = int(np.searchsorted(now[1], now[1][-1], "left"))
            now, again = [x[first : first + 1] for x in now], True
        rest = now
    if rest is not None and len(rest[0]):
        yield rest, rest[0] == cut_name, again


def _span_batch(doc, start, stop, open_) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(doc), pa.array(start), pa.array(stop), pa.array(open_)], names=["doc", "start", "stop", "open"]
    )


def _shared_by_others(group: np.ndarray, check: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether another document of the group has the same check."""
    key = group.astype(np.int64) * 256 + check
    _, at = np.unique(key, return_inverse=True)
    low = np.full(at.max() + 1, np.iinfo(np.int64).max)
    high = np.full(at.max() + 1, np.iinfo(np.int64).min)
    np.minimum.at(low, at, doc)
    np.maximum.at(high, at, doc)
    return low[at] != high[at]


def _rank_anchors(threshold: int, hot: np.ndarray):
    """Spans of anchors that are copies, and of those whose windows are open.

    Names in ``hot`` are dealt by their reaches too, so this task need not have
    all rows of one; as with names too large for a piece, all their windows that
    aren't known to be copies are open.
    """
    most = PIECE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (name, reach, doc, place), large, again in _pieces(batches, most):
            fresh = np.ones(len(name), bool)
            fresh[:1] = not again
            known = ((name & 1) == 0) & fresh
            if known.any():
                yield _span_batch(doc[known], place[known], reach[known], np.zeros(known.sum(), bool))
                name, reach, doc, place, large, fresh = (x[~known] for x in (name, reach, doc, place, large, fresh))
            if not len(name):
                continue
            large = large | np.isin(name, hot)
            group = np.cumsum(np.append(False, name[1:] != name[:-1]))
            # unique names: one document only
            begin = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
            several = np.minimum.reduceat(doc, begin) != np.maximum.reduceat(doc, begin)
            live = several[group] | large
            if not live.any():
                continue
            reach, doc, place, group, large, fresh = (x[live] for x in (reach, doc, place, group, large, fresh))
            copy = _split_copies([group, reach], doc)
            bits = place.view(U64)
            start = (bits >> U64(_AT)).astype(np.int64)
            stop = start + ((bits >> U64(_WIDTH)) & U64(0xFF)).astype(np.int64) - 1 + threshold
            left = ((bits >> U64(_LEFT)) & U64(0xFF)).astype(np.int64)
            right = (bits & U64(0xFF)).astype(np.int64)
            # sides shared with others; the first of equal reaches stands for all
            first = ~copy
            by_left, by_right = np.zeros(len(doc), bool), np.zeros(len(doc), bool)
            g, d = group[first], doc[first]
            by_left[first] = _shared_by_others(g, left[first], d) | large[first]
            by_right[first] = _shared_by_others(g, right[first], d) | large[first]
            # a window with half of the rest on one side needs that side shared
            anchor = start + ((bits >> U64(_ANCHOR)) & U64(0x7F)).astype(np.int64)
            rest = threshold - SEED
            half = (rest + 1) // 2
            last = np.where(by_right, stop - threshold, np.minimum(stop - threshold, anchor - (rest - half + 1)))
            begin_at = np.where(by_left, start, np.maximum(start, anchor - (half - 1)))
            open_ = (by_left | by_right) & (begin_at <= last)
            start = np.where(open_, begin_at, start)
            stop = np.where(open_, last + threshold, stop)
            keep = (copy | open_) & fresh
            yield _span_batch(doc[keep], start[keep], stop[keep], open_[keep])

    return run


def _seed_names(threshold: int):
    """The distinct names of a document's anchors, for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            data, offs = tn.utf8(batch.column(0))
            for a, b in tn.blocks(offs):
                part, at = data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
                doc, _, _, anchor = anchors(part, at, threshold)
                p = tn.prefix_hashes(part)
                _, inv = tn.powers(len(part) + 1)
                name = _names(p, inv, anchor, anchor + SEED) | U64(1)
                order = np.lexsort((name, doc))
                name, doc = name[order], doc[order]
                fresh = np.ones(len(name), bool)
                fresh[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(name[fresh].view(np.int64))], names=["name"])

    return run


def hot_names(texts: DataFrame, threshold: int, sample: int = 20_000, share: float = 0.05) -> list[int]:
    """Names that more than ``share`` of about ``sample`` documents, drawn by a
    hash of their texts, hold: some thousands at most.

    They only say which names to deal to several tasks. Results don't depend on
    them, and a name that is missed costs a task more rows, not more memory.
    """
    one_in = max(1, texts.count() // sample)
    drawn = texts.where(F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0)
    n = drawn.count() if one_in > 1 else 0
    if n < 1000:
        return []
    found = drawn.select("text").mapInArrow(_seed_names(threshold), "name long").groupBy("name").agg(F.count("*").alias("n"))
    return [r.name for r in found.where(F.col("n") > share * n).select("name").collect()]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed bytes, for the shuffles that move them; the columns
    (doc, text, carried) become (doc, packed, carried)."""
    z = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        data, offs = tn.utf8(batch.column(1))
        raw = memoryview(data)
        packed = [z.compress(raw[offs[i] : offs[i + 1]]) for i in range(len(offs) - 1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(packed, pa.binary()), batch.column(2)], names=["doc", "packed", "carried"]
        )


def _unpacked(value: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(value)


def _window_rows(threshold: int):
    """(name of half, name of half, doc, place) of every open window."""
    half = threshold // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            ids, out = batch.column(0).to_numpy(), []
            for i in range(len(ids)):
                data = np.frombuffer(_unpacked(batch.column(1)[i].as_py()), np.uint8)
                at = np.asarray(batch.column(2)[i].values.to_numpy(zero_copy_only=False), np.int64)
                p = tn.prefix_hashes(data)
                _, inv = tn.powers(len(data) + 1)
                start, n = at >> 8, at & 0xFF
                w = np.unique(np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum()))
                a = (_names(p, inv, w, w + half) | U64(1)).view(np.int64)
                b = _names(p, inv, w + half, w + threshold).view(np.int64)
                out.append((a, b, np.full(len(w), ids[i]), w))
            if not out:
                continue
            a, b, doc, w = (np.concatenate(x) for x in zip(*out))
            copy = _split_copies([a, b], doc)
            d, s, e = _merged(doc[copy], w[copy], w[copy] + threshold)
            keep = ~copy
            columns = (
                np.concatenate([a[keep], _even(d, s).view(np.int64)]),
                np.concatenate([b[keep], e]),
                np.concatenate([doc[keep], d]),
                np.concatenate([w[keep], s]),
            )
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["name", "reach", "doc", "place"])

    return run


def _rank_windows(threshold: int):
    """Spans of windows that start in an earlier document too."""
    most = PIECE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (a, b, doc, w), _, again in _pieces(batches, most):
            known = (a & 1) == 0
            copy = ~known & _split_copies([a, b], doc)
            keep = known | copy
            keep[:1] &= not again
            stop = np.where(known, b, w + threshold)
            d, s, e = _merged(doc[keep], w[keep], stop[keep])
            yield _span_batch(d, s, e, np.zeros(len(d), bool))

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, packed, spans, carried) to what is left of each text."""
    for batch in _slices(batches, TOGETHER // 4):
        rows = []
        for i in range(batch.num_rows):
            text = _unpacked(batch.column(1)[i].as_py())
            spans = batch.column(2)[i]
            starts, stops = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if spans.is_valid:
                v = spans.values
                start, stop = v.field(0).to_numpy(), v.field(1).to_numpy()
                _, starts, stops = _merged(np.zeros(len(start), np.int64), start, stop)
            kept, last = [], 0
            for s, e in zip(starts.tolist(), stops.tolist()):
                kept.append(text[last:s])
                last = e
            kept.append(text[last:])
            left = b"".join(kept)
            rows.append(
                (
                    len(text),
                    len(text) - len(left),
                    hashlib.sha256(left).hexdigest(),
                    [{"start": int(s), "stop": int(e)} for s, e in zip(starts, stops)],
                    _clean(text, starts.tolist(), stops.tolist()),
                )
            )
        n, removed, digest, spans, left = zip(*rows) if rows else ((),) * 5
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(n, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(digest, pa.string()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                pa.array(left, pa.string()),
                batch.column(3),
            ],
            names=["doc", "n_bytes", "n_removed", "kept_sha256", "spans", "kept_text", "carried"],
        )


def _clean(text: bytes, starts: list[int], stops: list[int]) -> str:
    """The text without its spans, drawn in so that no character is cut."""
    kept, last = [], 0
    for s, e in zip(starts, stops):
        while s < e and text[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(text) and text[e] & 0xC0 == 0x80:
            e -= 1
        kept.append(text[last:s])
        last = max(last, e)
    kept.append(text[last:])
    return b"".join(kept).decode("utf-8", "replace")


def _numbered(own: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc, text, carried), where ``doc`` orders documents as their ids do, and (doc,
    doc_id) unless both are the same.

    ``doc`` is the id itself if ids are distinct and not null, else a number
    that follows the order of (id, hash of the text).
    """
    odd = own.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if odd.isEmpty():
        return own.withColumnRenamed("doc_id", "doc"), None
    own = own.withColumn("h", F.xxhash64("text"))
    by = [F.col("doc_id").asc_nulls_last(), F.col("h")]
    ordered = own.select("doc_id", "h").distinct().repartitionByRange(*by).sortWithinPartitions(*by)
    numbers = written(ordered.withColumn("doc", F.monotonically_increasing_id()), "numbers")
    o, m = own.alias("o"), numbers.alias("m")
    same = F.col("o.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("o.h") == F.col("m.h"))
    return o.join(m, same).select("m.doc", "o.text", "o.carried"), numbers.select("doc", "doc_id")


def dedup_substrings(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    threshold: int = 50,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256,
    the removed spans (byte ranges), the kept text, and ``carried``, a struct of
    the columns named in ``carry``.

    ``kept_text`` leaves out only whole characters of a span, so that it stays
    valid text; the digest is of exactly the bytes that no span covers.
    """
    if not 2 * SEED <= threshold <= 128:
        raise ValueError(f"threshold must be from {2 * SEED} to 128 bytes")
    own = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.struct(*(F.col(c) for c in carry)).alias("carried") if carry else F.struct(F.lit(0).alias("none")).alias("carried"),
    )
    texts, numbers = _numbered(own)

    order = ("name", "reach", "doc")
    named = texts.select("doc", "text").mapInArrow(_anchor_rows(threshold), ROWS)
    hot = hot_names(texts, threshold)
    salt = [F.when(F.col("name").isin(hot), F.pmod("reach", F.lit(SALTS))).otherwise(0)] if hot else []
    named = named.repartition("name", *salt).sortWithinPartitions(*order)
    spans = written(named.mapInArrow(_rank_anchors(threshold, np.array(hot, np.int64)), SPANS), "anchor-spans")

    kind = texts.schema["carried"].dataType.simpleString()
    packed = texts.select("doc", "text", "carried").mapInArrow(_packed, f"doc long, packed binary, carried {kind}")
    place = F.col("start") * 256 + (F.col("stop") - F.col("start") - threshold + 1)
    open_ = spans.where("open").groupBy("doc").agg(F.collect_list(place).alias("places"))
    windows = packed.join(open_, "doc").select("doc", "packed", "places").mapInArrow(_window_rows(threshold), ROWS)
    # By the pair, so that only equal windows meet, whatever their halves share.
    ranked = windows.repartition("name", "reach").sortWithinPartitions(*order)
    more = written(ranked.mapInArrow(_rank_windows(threshold), SPANS), "window-spans")

    all_spans = spans.where("not open").unionByName(more)
    by_doc = all_spans.groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    cut = (
        packed.join(by_doc, "doc", "left")
        .select("doc", "packed", "spans", "carried")
        .mapInArrow(
            _cut,
            "doc long, n_bytes long, n_removed long, kept_sha256 string, "
            f"spans array<struct<start: long, stop: long>>, kept_text string, carried {kind}",
        )
    )
    cut = cut.withColumn("n_spans", F.size("spans").cast("long"))
    return cut.withColumnRenamed("doc", "doc_id") if numbers is None else cut.join(numbers, "doc").drop("doc")
