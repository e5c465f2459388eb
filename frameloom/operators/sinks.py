"""Sinks and reports: named records, session summaries, counts of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.sources.frames import ordinal

#: Suffixes that a record keeps, and those of content types.
KEPT_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff")
TYPE_SUFFIXES = {"image/jpeg": ".jpg", "image/png": ".png", "image/bmp": ".bmp", "image/tiff": ".tif"}


def extension(file_name: Column, content_type: Column) -> Column:
    """An image suffix of the file name as it is, else by content type, else .bin."""
    suffix = F.regexp_extract(file_name, r"(\.[^.]+)$", 1)
    pairs = [F.lit(x) for pair in TYPE_SUFFIXES.items() for x in pair]
    by_type = F.try_element_at(F.create_map(*pairs), F.lower(content_type))
    return F.when(F.lower(suffix).isin(*KEPT_SUFFIXES), suffix).otherwise(F.coalesce(by_type, F.lit(".bin")))


def records(df: DataFrame, port: str, cycle: str = "cycle_index") -> DataFrame:
    """One record per frame that reaches a sink, numbered in cycle order."""
    frame = df.where(F.col(port).isNotNull()).select(cycle, f"{port}.*")
    numbered = ordinal(frame, cycle, "nth").withColumn("nth", F.col("nth") + 1)
    stem = F.format_string("%06d-%s-seq%04d", F.col("nth"), F.col("camera_id"), F.col("sequence_number"))
    return numbered.withColumns(
        {
            "stored_name": F.concat(stem, extension(F.col("file_name"), F.col("content_type"))),
            "metadata_name": F.concat(stem, F.lit(".json")),
        }
    )


def write_session(df: DataFrame, port: str, folder: str) -> None:
    """Write the records of a port, with payloads, as a Parquet session."""
    records(df, port).write.mode("overwrite").parquet(folder)


def per_camera(recorded: DataFrame) -> DataFrame:
    """Frames of each camera, as the session inspection lists them."""
    return recorded.groupBy("camera_id").agg(F.count("*").alias("frames"))


def session_summary(recorded: DataFrame) -> DataFrame:
    """Count, bytes and cameras of a session; no row for an empty one."""
    return recorded.agg(
        F.count("*").alias("frame_count"),
        F.sum("content_length").alias("total_bytes"),
        F.countDistinct("camera_id").alias("cameras"),
    ).where("frame_count > 0")


def run_report(df: DataFrame, sinks: list[str]) -> DataFrame:
    """Cycles of a run, and those in which at least one sink had a frame."""
    reached = F.lit(False)
    for port in sinks:
        reached = reached | F.col(port).isNotNull()
    return df.agg(
        F.count("*").alias("total_cycles"),
        F.coalesce(F.sum(reached.cast("long")), F.lit(0)).alias("accepted_cycles"),
    )


def node_stats(df: DataFrame, ports: dict[str, str]) -> DataFrame:
    """How many messages each node gave: (node, messages)."""
    counts = df.agg(*[F.count(F.col(port)).alias(node) for node, port in ports.items()])
    return counts.unpivot([], list(ports), "node", "messages")


def source_profile(df: DataFrame, measure: str) -> DataFrame:
    """Averages over the frames that carry a measure, and over all."""
    return df.agg(
        F.count("*").alias("frames"),
        F.count(measure).alias("measured"),
        F.avg(measure).alias("average"),
        F.max(measure).alias("largest"),
    )
