"""Near-duplicate documents by circulant MinHash.

A document's distinct word shingles go through one permutation, and a second
one, circularly shifted by k, gives coordinate k of its signature: two
permutations make all coordinates. Bands of coordinates propose links; every
link is confirmed by the exact Jaccard similarity of the full shingle sets.

Documents with equal shingle sets are one class from the start. Inside a band
bucket not all pairs are made: members are compared with one centre, and after
that only those still outside their bucket's largest component, with documents
that share one of their rarest shingles (an exact prefix filter). So no link
that the bands propose is lost, and a group of thousands of copies costs little
more than its members.

Defined cases: a null or empty text, or one of white space only, has an empty
set and no links. Ids must be distinct and not null for components to mean
something; rows that repeat an id count as copies of one document if their
texts are equal, and rows with a null id are kept, alone. Extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm import textnum as tn
from frameloom.llm.components import components
from frameloom.llm.shared import written

U32 = np.uint32
#: 32 bands of 5: at similarity 0.8 three links in a million are not proposed.
BANDS, ROWS = 32, 5
#: 256 bits: the parity of how many elements of a set fall on each.
PARITIES = ("p0", "p1", "p2", "p3")
PARITY_COLUMNS = ", ".join(f"{x} long" for x in PARITIES)
#: Draws of a centre that the bands take in turn.
CENTRES = 8
#: Slots of the sketch of element counts: a broadcast of 2 MB at any scale.
SKETCH = 1 << 18

SIGNATURES = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"


def _shuffled(x: np.ndarray, scratch: np.ndarray) -> np.ndarray:
    """The second permutation of 32-bit values, in place."""
    x *= U32(0x7FEB352D)
    np.right_shift(x, U32(15), out=scratch)
    x ^= scratch
    x *= U32(0x846CA68B)
    np.right_shift(x, U32(16), out=scratch)
    x ^= scratch
    x *= U32(0x9E3779B1)
    return x


def signature(shingles: np.ndarray, size: int = BANDS * ROWS, width: int = 1024) -> np.ndarray:
    """Circulant MinHash of distinct 64-bit shingle hashes: ``size`` minima.

    The first permutation is that of the hashes themselves, whose high half
    is the element; the second is applied to the element less k.
    """
    elements = (shingles >> tn.U64(32)).astype(U32)
    shifts = np.arange(size, dtype=U32)[:, None]
    least = np.full(size, 0xFFFFFFFF, U32)
    for i in range(0, len(elements), width):
        x = elements[None, i : i + width] - shifts
        np.minimum(least, _shuffled(x, np.empty_like(x)).min(axis=1), out=least)
    return least


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a column."""
    data, offs = tn.utf8(column)
    for a, b in tn.blocks(offs):
        part, at = tn.lower(data[offs[a] : offs[b]]), offs[a : b + 1] - offs[a]
        s, e, w_offs = tn.word_spans(part, at)
        h, h_offs = tn.shingle_hashes(tn.word_hashes(part, s, e), w_offs, k)
        for i in range(b - a):
            yield np.unique(h[h_offs[i] : h_offs[i + 1]])


def _signatures(k: int, bands: int, rows: int):
    salt = tn.mix(np.arange(1, bands + 1, dtype=tn.U64))
    factor = tn.mix(np.arange(101, 101 + rows, dtype=tn.U64)) | tn.U64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b, keys = [], [], [], []
            for s in shingle_sets(batch.column(1), k):
                n.append(len(s))
                a.append(tn.mix(s + tn.U64(1)).sum(dtype=tn.U64).astype(np.int64))
                b.append(tn.mix(s ^ tn.U64(tn.BASE)).sum(dtype=tn.U64).astype(np.int64))
                if len(s):
                    coordinates = signature(s, bands * rows).reshape(bands, rows).astype(tn.U64)
                    keys.append(tn.mix((coordinates * factor).sum(axis=1, dtype=tn.U64) + salt).view(np.int64))
                else:
                    keys.append(np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(a, pa.int64()),
                    pa.array(b, pa.int64()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "set_a", "set_b", "bands"],
            )

    return run


def _confirmed(k: int, percent: int):
    """Keep the pairs whose full sets have 100 * common >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[object, np.ndarray] = (None, np.zeros(0, tn.U64))
        for batch in batches:
            u, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            # Pairs come in order of v, so that its set is made once.
            lefts, keep = shingle_sets(batch.column(2), k), []
            for i, left in enumerate(lefts):
                if last[0] != v[i]:
                    last = (v[i], next(shingle_sets(batch.column(3).slice(i, 1), k)))
                right = last[1]
                common = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * common >= percent * (len(left) + len(right) - common))
            keep = np.array(keep, bool)
            yield pa.RecordBatch.from_arrays(
                [pa.array(u[keep], pa.int64()), pa.array(v[keep], pa.int64())], names=["u", "v"]
            )

    return run


def _counted(k: int):
    """How often elements fall into each slot of a sketch of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for s in shingle_sets(batch.column(0), k):
                np.add.at(total, (s % tn.U64(SKETCH)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["slot", "n"])

    return run


def _prefixes(k: int, percent: int, counts: np.ndarray):
    """The first elements of each set in a global order, rare ones first.

    Of n elements a similar set has at least percent * n / 100, so one of any
    n - that + 1; any order does that all sets share, and one by rarity leaves
    what many copies have in common at the end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, parities = [], []
            for s in shingle_sets(batch.column(4), k):
                bit = (s >> tn.U64(20)) % tn.U64(64 * len(PARITIES))
                odd = np.bincount(bit.astype(np.int64), minlength=64 * len(PARITIES)) & 1
                parities.append(np.packbits(odd.astype(np.uint8), bitorder="little").view(tn.U64))
                order = np.lexsort((s, counts[(s % tn.U64(SKETCH)).astype(np.int64)]))
                keys.append(s[order[: len(s) + (-percent * len(s)) // 100 + 1]])
            n = [len(x) for x in keys]
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            at = pa.array(np.repeat(np.arange(len(n)), n))
            parity = np.array(parities, tn.U64).reshape(-1, len(PARITIES)).view(np.int64)
            nth = np.concatenate([np.arange(x, dtype=np.int32) for x in n]) if n else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(flat),
                    pa.array(nth),
                    *(pa.array(x).take(at) for x in parity.T),
                    *(batch.column(i).take(at) for i in range(4)),
                ],
                names=["key", "nth", *PARITIES, "rep", "n_shingles", "component", "outside"],
            )

    return run


def near_duplicates(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = written(own.mapInArrow(_signatures(words, bands, rows), SIGNATURES), "signatures")
    full = signed.where("n_shingles > 0 and doc_id is not null")

    # Equal sets: one representative each, found with a map-side minimum.
    # Aggregates are written before they are joined: a join of two plain tables is
    # one whose hot keys (many copies, a much linked centre) Spark splits.
    classes = written(full.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep")), "reps")
    same = written(full.join(classes, ["set_a", "set_b", "n_shingles"]).select("doc_id", "rep", "n_shingles", "bands"), "classes")
    reps = same.where("doc_id = rep").dropDuplicates(["rep"])

    # A bucket's centre is drawn by hash, with another draw in each of eight bands,
    # so that members of a large group try several documents, and not one outlier.
    keyed = reps.select(F.posexplode("bands").alias("band", "key"), "rep", "n_shingles")
    draw = F.struct(F.xxhash64(F.col("band") % CENTRES, "rep"), "rep")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min(draw).alias("drawn")).where("n > 1")
    shared = shared.select("key", F.col("drawn.rep").alias("centre"))
    shared = written(shared, "shared")
    buckets = written(keyed.join(shared, "key").select("key", "centre", "rep", "n_shingles"), "buckets")
    sizes = buckets.select("rep", "n_shingles").distinct()
    texts = written(own.join(sizes.withColumnRenamed("rep", "doc_id"), "doc_id"), "candidates")

    def confirm(pairs: DataFrame, label: str) -> DataFrame:
        """Links among candidate pairs (u, v), by the full sets of both."""
        u = texts.select(F.col("doc_id").alias("u"), F.col("text").alias("u_text"), F.col("n_shingles").alias("u_n"))
        v = texts.select(F.col("doc_id").alias("v"), F.col("text").alias("v_text"), F.col("n_shingles").alias("v_n"))
        small, large = F.least("u_n", "v_n"), F.greatest("u_n", "v_n")
        both = (
            pairs.join(u, "u")
            .join(v, "v")
            .where(100 * small >= percent * large)
            .sortWithinPartitions("v")
            .select("u", "v", "u_text", "v_text")
        )
        return written(both.mapInArrow(_confirmed(words, percent), "u long, v long"), label)

    # Each member of a bucket against its centre: at most one pair for each band.
    tried = written(
        buckets.where("rep <> centre")
        .select(F.greatest("rep", "centre").alias("u"), F.least("rep", "centre").alias("v"))
        .distinct(), "pairs"
    )
    links = confirm(tried, "links")
    labels = components(links)
    placed = buckets.join(labels.toDF("rep", "component"), "rep", "left").select(
        "key", "rep", F.coalesce("component", "rep").alias("component")
    )
    placed = written(placed, "placed")
    # Whoever is now outside the largest component of a bucket has proposed links
    # that are still open. All documents of such buckets meet by prefix: of two
    # sets as similar as asked, the rarest elements of each have one in common.
    split = written(
        placed.groupBy("key", "component")
        .agg(F.count("*").alias("size"))
        .groupBy("key")
        .agg(F.count("*").alias("n"), F.max(F.struct("size", "component")).alias("largest"))
        .where("n > 1")
        .select("key", F.col("largest.component").alias("largest")),
        "split",
    )
    if not split.isEmpty():
        open_ = written(
            placed.join(split, "key")
            .groupBy("rep", "component")
            .agg(F.max(F.col("component") != F.col("largest")).alias("outside")),
            "open",
        )
        # Text last: only documents of such buckets are read again.
        open_texts = written(
            texts.join(open_.withColumnRenamed("rep", "doc_id"), "doc_id").select(
                "doc_id", "n_shingles", "component", "outside", "text"
            ),
            "open-texts",
        )
        held = open_texts.select("text").mapInArrow(_counted(words), "slot int, n long")
        counts = np.zeros(SKETCH, np.int64)
        for part in held.groupBy("slot").agg(F.sum("n").alias("n")).toArrow().to_batches():
            counts[part.column(0).to_numpy()] = part.column(1).to_numpy()
        heads = written(
            open_texts.mapInArrow(
                _prefixes(words, percent, counts), f"key long, nth int, {PARITY_COLUMNS}, rep long, n_shingles long, component long, outside boolean"
            ),
            "prefixes",
        )
        names = ("nth", *PARITIES, "rep", "n_shingles", "component")
        a = heads.where("outside").select("key", *[F.col(x).alias(f"a_{x}") for x in names])
        b = heads.select("key", *[F.col(x).alias(f"b_{x}") for x in names])
        # At the first element in common, no more than what follows can be shared.
        most = F.least(F.col("a_n_shingles") - F.col("a_nth"), F.col("b_n_shingles") - F.col("b_nth"))
        both = F.col("a_n_shingles") + F.col("b_n_shingles")
        # Each bit in which parities differ is an element that only one set has.
        differ = sum(F.bit_count(F.col(f"a_{x}").bitwiseXOR(F.col(f"b_{x}"))) for x in PARITIES)
        pairs = (
            a.join(b, "key")
            .where(
                (F.col("a_component") != F.col("b_component"))
                & ((100 + percent) * most >= percent * both)
                & ((100 + percent) * differ <= (100 - percent) * both)
            )
            .select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b"))
            .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        )
        pairs = written(pairs.distinct().join(tried, ["u", "v"], "left_anti"), "pairs")
        more = confirm(pairs, "links")
        if not more.isEmpty():
            labels = components(links.unionByName(more))

    by_rep = same.select("doc_id", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    found = by_rep.groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    return (
        signed.select("doc_id", "n_shingles")
        .join(found, "doc_id", "left")
        .withColumn("component_id", F.coalesce("component_id", "doc_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
