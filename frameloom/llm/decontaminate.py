"""Benchmark passages in documents by spaced seeds, in DataFrame functions alone.

Two fixed masks ignore some token positions of a window and hash the others,
over every window of the benchmark and of the documents; hashes are joined,
and each hit is verified: somewhere around it, ``LENGTH`` aligned tokens have
at most ``SUBSTITUTIONS`` that differ. The masks are chosen so that no such
overlap lacks a hit (a test goes through all placements of substitutions).

Tokens are runs of letters and digits in lower case, so punctuation, case and
line breaks make no difference.

An item of fewer tokens than that, but ``LEAST`` of them, is looked for as a whole,
all of its tokens in a row: windows of its length are hashed, joined and compared.

Defined cases: null and empty texts, items of fewer than ``LEAST`` tokens, and
documents shorter than what is looked for, hold no overlap. Texts are read whole, whatever their length. Repeated items are each reported. Rows that
share a document id (null included) share their hits. An empty benchmark or
document table gives rows without hits, or no rows. Extra columns are kept out
of the result, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An overlap, and masks that together catch every one of them.
LENGTH, SUBSTITUTIONS = 13, 2
MASKS = ("11010111", "11110011")
SPAN = max(map(len, MASKS))
#: Fewer tokens than these are no passage, and any text may hold them.
LEAST = 5
#: What separates tokens.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Seeds up to this number, each with at most 2 * LENGTH - SPAN tokens, are
#: broadcast; beyond, hashes are joined by shuffle.
BROADCAST_SEEDS = 200_000


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), GAP), "")


def seeded(df: DataFrame, words: str, place: str) -> DataFrame:
    """A row for each window of ``words`` and each mask: ``place`` and ``seed``."""
    n = F.size(words)
    at = F.explode(F.when(n >= LENGTH, F.sequence(F.lit(0), n - SPAN)))
    hashes = [
        F.xxhash64(F.lit(k), *[F.get(words, F.col(place) + i) for i, c in enumerate(mask) if c == "1"])
        for k, mask in enumerate(MASKS)
    ]
    return df.withColumn(place, at).withColumn("seed", F.explode(F.array(*hashes)))


def _around(words: str, at: str) -> Column:
    """The tokens that an overlap with a hit at ``at`` can reach."""
    first = F.greatest(F.col(at) - (LENGTH - SPAN), F.lit(0))
    return F.slice(F.col(words), first + 1, 2 * LENGTH - SPAN)


def overlaps(w: Column, b: Column, i: Column, j: Column) -> Column:
    """Whether some LENGTH tokens around places i of w and j of b nearly agree."""
    back = F.least(i, j, F.lit(LENGTH - SPAN))
    ahead = F.least(F.size(w) - i, F.size(b) - j, F.lit(LENGTH))
    same = F.transform(
        F.sequence(-back, ahead - 1), lambda k: (F.get(w, i + k) == F.get(b, j + k)).cast("int")
    )
    width = back + ahead
    enough = F.exists(
        F.sequence(F.lit(1), width - LENGTH + 1),
        lambda s: F.aggregate(F.slice(same, s, F.lit(LENGTH)), F.lit(0), lambda n, x: n + x) >= LENGTH - SUBSTITUTIONS,
    )
    return F.when(width >= LENGTH, enough).otherwise(False)


def find_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    broadcast_seeds: int = BROADCAST_SEEDS,
) -> DataFrame:
    """(doc_id, item_id, shift): verified alignments, one row each."""
    own = docs.select(F.col(doc_id).alias("doc_id"), tokens(F.col(text)).alias("w"))
    items = benchmark.select(F.col(item_id).alias("item_id"), tokens(F.col(item_text)).alias("b")).distinct()
    # A seed carries the tokens that its verification reads and no more, so that
    # the number of seeds bounds what a broadcast of them holds.
    seeds = seeded(items, "b", "j").select("seed", "item_id", "j", _around("b", "j").alias("b"))
    n, shortest, short = items.agg(
        F.sum(F.when(F.size("b") >= LENGTH, F.size("b") - SPAN + 1)),
        F.sort_array(F.collect_set(F.when(F.size("b").between(LEAST, LENGTH - 1), F.size("b")))),
        F.count_if(F.size("b").between(LEAST, LENGTH - 1)),
    ).first()
    n = n or 0
    at = seeded(own, "w", "i")
    if n * len(MASKS) <= broadcast_seeds:
        met = at.join(F.broadcast(seeds), "seed")
    else:
        # Places of hits first, without the texts; then the texts of those only.
        found = (
            at.select("doc_id", "i", "seed")
            .join(seeds.select("seed", "item_id", "j"), "seed")
            .select("doc_id", "i", "item_id", "j")
        )
        tokens_of = items.select("item_id", F.col("b").alias("all"))
        met = (
            found.withColumnRenamed("doc_id", "hit")
            .join(own, F.col("hit").eqNullSafe(F.col("doc_id")))
            .drop("hit")
            .join(tokens_of, "item_id")
            .withColumn("b", _around("all", "j"))
        )
    # Verification must stay above the join and the cutting out of words. As the
    # join's condition it would keep the join out of the generated loop over
    # windows, and rows of all windows with all words would pile up before it; a
    # column of ids that it reads is what Spark won't push it past.
    near = met.select(
        "doc_id", "item_id", "i", "j", _around("w", "i").alias("w"), "b",
        F.monotonically_increasing_id().alias("hit"),
    )
    inside = [F.least(F.col(x), F.lit(LENGTH - SPAN)) for x in "ij"]
    verified = near.where((F.col("hit") >= 0) & overlaps(F.col("w"), F.col("b"), *inside))
    hits = verified.select("doc_id", "item_id", (F.col("i") - F.col("j")).alias("shift"))
    if short:
        few = short <= broadcast_seeds
        hits = hits.unionByName(_whole_items(own, items, shortest, few))
    return hits.distinct()


def _whole_items(own: DataFrame, items: DataFrame, lengths: list[int], broadcast: bool) -> DataFrame:
    """(doc_id, item_id, shift) of items of fewer than ``LENGTH`` tokens, which
    have one of ``lengths``: all their tokens, in a row."""
    small = items.where(F.size("b").between(LEAST, LENGTH - 1)).select("item_id", "b", F.xxhash64("b").alias("seed"))
    n = F.size("w")
    sizes = F.array(*[F.lit(x) for x in lengths])
    at = own.withColumn("size", F.explode(F.filter(sizes, lambda x: x <= n)))
    at = at.withColumn("shift", F.explode(F.sequence(F.lit(0), n - F.col("size"))))
    part = F.slice("w", F.col("shift") + 1, F.col("size"))
    at = at.select("doc_id", "shift", part.alias("part")).withColumn("seed", F.xxhash64("part"))
    met = at.join(F.broadcast(small) if broadcast else small, "seed").where(F.col("part") == F.col("b"))
    return met.select("doc_id", "item_id", "shift")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """One row per document: doc_id, n_overlaps, item_ids (sorted), contaminated."""
    hits = (
        find_overlaps(docs, benchmark, doc_id=doc_id, **options)
        .groupBy(F.col("doc_id").alias("hit"))
        .agg(F.count("*").alias("n_overlaps"), F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    )
    return (
        docs.select(F.col(doc_id).alias("doc_id"))
        .join(hits, F.col("doc_id").eqNullSafe(F.col("hit")), "left")
        .select(
            "doc_id",
            F.coalesce("n_overlaps", F.lit(0)).alias("n_overlaps"),
            F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"),
            (F.coalesce("n_overlaps", F.lit(0)) > 0).alias("contaminated"),
        )
    )
