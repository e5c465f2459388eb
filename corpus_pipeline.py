"""A corpus pipeline of five stages, each one operator of ``frameloom.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of ``documents``:

1. toxicity: documents whose calibrated score says toxic go.
2. minhash: of each group of near copies the document with the least id stays.
3. suffix_dedup: passages that an earlier document holds too are cut out.
4. decontamination: documents that hold a benchmark passage go.
5. mixing: how many words to take from each document that is left.

Nulls, empty and very long texts, ties and extra columns are as the operators
define them. Toxicity and decontamination judge each row by its own text, whatever
its id. The near-copy stage goes by ids: rows with a null id are alone and stay,
and of rows that agree in id and text one stays. An empty table goes through all
stages and comes out empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm import decontaminate, minhash, mixing, suffixdedup, toxicity
from frameloom.llm.shared import remove, scratch_path, scratch_scope, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose own text isn't rated toxic. An empty or null text has the base
    rate and stays; rows with one text fare alike, whatever their ids."""
    rated = toxicity.rate_toxicity(docs, table(spark, sf_dir, "labels"), carry=COLUMNS)
    return rated.where("predicted = 0").select("carried.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the least id. Texts
    without words have no copies; of rows that agree in id (null too) and text one
    stays."""
    found = minhash.near_duplicates(docs, words=5, percent=80)
    gone = found.where("not kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    twice = written(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated-ids")
    if twice.isEmpty():
        return left
    same = left["doc_id"].eqNullSafe(twice["doc_id"])
    return left.join(twice, same, "left_anti").unionByName(
        left.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"])
    )


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated passages; the shortest that counts is 50 bytes, as for
    ``op8``. Text keeps whole characters only, n_chars follows it, and a null
    text comes out empty."""
    cut = suffixdedup.dedup_substrings(docs, threshold=50, carry=("lang", "source", "n_chars"))
    same = F.col("n_removed") == 0
    return cut.select(
        "doc_id",
        F.col("kept_text").alias("text"),
        "carried.lang",
        "carried.source",
        F.when(same, F.col("carried.n_chars")).otherwise(F.length("kept_text").cast("long")).alias("n_chars"),
    )


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose own text overlaps no benchmark item. Rows are told apart by a
    digest of the text, so that equal texts fare alike and ids don't matter."""
    digest = F.md5(F.coalesce("text", F.lit("")))
    own = docs.select(digest.alias("doc_id"), "text")
    hits = decontaminate.find_overlaps(own, table(spark, sf_dir, "benchmark"))
    hits = written(hits.select(F.col("doc_id").alias("digest")).distinct(), "contaminated")
    return docs.withColumn("digest", digest).join(hits, "digest", "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words to take from each row: none, once or twice its size."""
    return mixing.mix_sources(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]

#: Learned scores and prefix doubling are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again. A stage's own
    intermediate tables, and what the stage before wrote, go once it is written."""
    docs, before = table(spark, sf_dir, "documents").select(*COLUMNS), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        with scratch_scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
