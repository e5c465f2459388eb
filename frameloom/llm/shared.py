"""Small helpers that several operators use: tables, scratch space, words."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators between words, and the ASCII capitals.
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Spark's setting to remove the shuffle files of a statement when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_scratch: list[str] = []
_scopes = threading.local()
_cleaning = threading.Lock()
_cleaners: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the named parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that setting is missing, a session inside one process (``local[n]``, as
    in tests) gets a temporary folder that goes when Python ends; on a cluster it
    is an error, as no machine-local folder would do.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_scratch:
        _own_scratch.append(tempfile.mkdtemp(prefix="frameloom-"))
        atexit.register(shutil.rmtree, _own_scratch[0], True)
    return _own_scratch[0]


def _application_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/frameloom/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path: inside the innermost open scope, or for the application."""
    open_scopes = getattr(_scopes, "open", [])
    folder = open_scopes[-1] if open_scopes else _application_folder(spark)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written inside the block go when it ends, so results
    that read them have to be written before that."""
    stack = _scopes.open = getattr(_scopes, "open", [])
    stack.append(f"{_application_folder(spark)}/scope-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        remove(spark, stack.pop())


def clear_scratch(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application. Results that were not
    written or collected before can't be read after it."""
    remove(spark, _application_folder(spark))


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a finished write serve nothing any more. The first of
    several jobs at once turns the setting on, the last one puts it back."""
    with _cleaning:
        _cleaners.append(spark.conf.get(CLEANUP, "false"))
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _cleaning:
            before = _cleaners[0] if len(_cleaners) == 1 else None
            _cleaners.pop()
            if before is not None:
                spark.conf.set(CLEANUP, before)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to shared scratch and read it again.

    This cuts the lineage: a lost executor costs a reread, not the job before.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with _shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; null counts as empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")
