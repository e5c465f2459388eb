"""Token counts through a cache keyed by content and tokenizer digests.

Texts are reduced to distinct content digests, those that the cache has counts
for (for this very tokenizer version) are left out, only the misses are
encoded, and their counts are appended to the cache, a parquet folder.

Every text is counted by the library that the vocabulary file belongs to.

Defined cases: a null text counts as empty, with 0 bytes and 0 tokens. Equal
texts are encoded once, however many rows hold them. Texts are encoded whole.
Content is normalised by nothing but that null rule, as any other change (case,
Unicode forms, white space) changes the counts of a byte-level tokenizer.
Repeated and null ids keep a row each, an empty table gives an empty result,
and columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm.shared import exists, scratch_path, scratch_root, written

CACHE = "content string, tokenizer string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """Digest of the vocabulary file and the library that reads it."""
    import sentencepiece
    import tokenizers

    h = hashlib.sha256()
    with open(path, "rb") as f:
        for block in iter(lambda: f.read(1 << 20), b""):
            h.update(block)
    lib = tokenizers if path.endswith(".json") else sentencepiece
    h.update(f"{lib.__name__} {lib.__version__}".encode())
    return h.hexdigest()


@lru_cache(maxsize=4)
def _counter(path: str):
    """A function from texts to numbers of tokens; one for each worker."""
    if not path.endswith(".json"):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in p.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return lambda texts: [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)]


def _encode(path: str, version: str, at_once: int = 64):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = _counter(path)
        for batch in batches:
            texts = batch["text"].tolist()
            n = [x for i in range(0, len(texts), at_once) for x in count(texts[i : i + at_once])]
            yield pd.DataFrame({"content": batch["content"], "tokenizer": version, "n_tokens": n})

    return run


def shared_cache(spark: SparkSession, table_path: str | None = None) -> str:
    """A cache in the shared scratch folder that outlives calls and sessions.

    Each table has its own below it: a call reads its whole cache, and what that
    takes must follow the table, not all that was ever counted beside it. So a
    table is encoded once, then only what is new in it; texts that it shares with
    other tables are encoded for each.
    """
    root = f"{scratch_root(spark)}/frameloom-token-cache"
    return root if table_path is None else f"{root}/table={hashlib.sha256(table_path.encode()).hexdigest()}"


def count_tokens(
    docs: DataFrame,
    *,
    tokenizer_path: str,
    cache_path: str | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    limit: int = 512,
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    ``cache_path`` names a folder of counts to use and extend; without it the
    call keeps a cache of its own in scratch. The vocabulary is read by path on
    each executor, as it is installed there.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text"), F.sha2(body, 256).alias("content"))
    cache_path = cache_path or scratch_path(spark, "token-cache")

    def known() -> DataFrame:
        return spark.read.schema(CACHE).parquet(cache_path).where(F.col("tokenizer") == version)

    # Equal texts meet map-side first, so many copies reach the shuffle as few.
    misses = keyed.groupBy("content").agg(F.first("text").alias("text"))
    if exists(spark, cache_path):
        misses = misses.join(known(), "content", "left_anti")
    misses.mapInPandas(_encode(tokenizer_path, version), CACHE).write.mode("append").parquet(cache_path)

    # Two runs at once may append the same miss twice; both counts are equal.
    # Written, so that the join below is one of plain tables, whose skew Spark splits.
    counts = written(known().groupBy("content").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    return (
        keyed.select("doc_id", "content", F.octet_length("text").cast("long").alias("n_bytes"))
        .join(counts, "content")
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
