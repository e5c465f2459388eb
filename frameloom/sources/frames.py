"""Frames as rows: one per cycle, with its bytes in ``payload``.

``cycle_index`` orders everything downstream. Tables with dense ids use them;
``ordinal`` numbers other tables without a single-task sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Frame schema, and content types by file suffix (fixed values).
FRAME = (
    "cycle_index long, camera_id string, sequence_number int, file_name string, source_path string, "
    "ts timestamp, content_type string, content_length long, payload binary"
)
CONTENT_TYPES = {
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "png": "image/png",
    "bmp": "image/bmp",
    "tif": "image/tiff",
    "tiff": "image/tiff",
}
OCTETS = "application/octet-stream"
#: Ids of one block are numbered together by ``ordinal``.
BLOCK = 1 << 16


def content_type(file_name: Column) -> Column:
    suffix = F.lower(F.regexp_extract(file_name, r"\.([^.]+)$", 1))
    pairs = [F.lit(x) for pair in CONTENT_TYPES.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), suffix), F.lit(OCTETS))


def ordinal(df: DataFrame, by: str, name: str, block: int = BLOCK) -> DataFrame:
    """Number rows from 0 in the order of the integer column ``by``, null last;
    rows that tie have numbers of their own, in any order.

    Rows are numbered inside blocks of ids, and blocks get an offset from the
    counts before them: only the table of counts is sorted as a whole. Blocks
    are as wide as ids are sparse, so that there is about one for each ``block``
    rows; for that the least and the largest id are asked for first.
    """
    low, high, n = df.agg(F.min(by), F.max(by), F.count("*")).first()
    width = block if low is None else max(1, (int(high) - int(low) + 1) // max(1, -(-n // block)))
    blocks = df.withColumn("_block", F.coalesce(F.floor((F.col(by).cast("decimal(38, 0)") - F.lit(low or 0)) / width), F.lit((1 << 63) - 1)))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocks.groupBy("_block")
        .agg(F.count("*").alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = F.row_number().over(Window.partitionBy("_block").orderBy(F.col(by).asc_nulls_last())) - 1
    return blocks.withColumn("_inside", inside).join(offsets, "_block").withColumn(
        name, F.col("_offset") + F.col("_inside")
    ).drop("_block", "_inside", "_offset")


def event_frames(events: DataFrame) -> DataFrame:
    """Events as frames: one per event, the camera being its user."""
    per_camera = Window.partitionBy("user_id").orderBy("event_id")
    return ordinal(events, "event_id", "cycle_index").select(
        "cycle_index",
        F.concat(F.lit("cam-"), F.col("user_id").cast("string")).alias("camera_id"),
        F.row_number().over(per_camera).alias("sequence_number"),
        F.concat(F.lit("event-"), F.col("event_id").cast("string"), F.lit(".json")).alias("file_name"),
        F.lit(None).cast("string").alias("source_path"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.lit("application/json").alias("content_type"),
        F.octet_length("props").cast("long").alias("content_length"),
        F.col("props").cast("binary").alias("payload"),
        "event_type",
        "value",
    )


def document_frames(documents: DataFrame) -> DataFrame:
    """Documents as frames: the payload is the text, the camera its source, and
    the id, which is dense and in order, the cycle."""
    text = F.coalesce("text", F.lit(""))
    return documents.select(
        F.col("doc_id").alias("cycle_index"),
        F.col("source").alias("camera_id"),
        F.lit(1).alias("sequence_number"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"),
        F.lit(None).cast("string").alias("source_path"),
        F.lit(None).cast("timestamp").alias("ts"),
        F.lit("text/plain").alias("content_type"),
        F.octet_length(text).cast("long").alias("content_length"),
        text.cast("binary").alias("payload"),
    )


def folder_frames(spark: SparkSession, folder: str, cameras: int = 1, passes: int = 1) -> DataFrame:
    """Files of a folder in path order, for each of ``cameras`` cameras.

    A missing folder is empty, not an error. ``passes`` replays the folder;
    sequence numbers go on through the passes.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], FRAME)
    files = spark.read.format("binaryFile").load(folder)
    # A folder's listing is small beside its bytes; only the listing is ordered.
    order = Window.orderBy("path")
    listing = files.select("path").withColumn("nth", F.row_number().over(order))
    n = F.max("nth").over(Window.partitionBy())
    numbered = listing.withColumn("n_files", n)
    name = F.element_at(F.split("path", "/"), -1)
    return multi_camera(
        files.join(numbered, "path").select(
            "nth", "n_files", "path", name.alias("file_name"), "modificationTime", "length", "content"
        ),
        cameras,
        passes,
    )


def multi_camera(files: DataFrame, cameras: int, passes: int = 1) -> DataFrame:
    """Interleave cameras: for each file in order, a frame for each camera."""
    each = files.withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).withColumn(
        "_camera", F.explode(F.sequence(F.lit(1), F.lit(cameras)))
    )
    nth = F.col("nth") + F.col("_pass") * F.col("n_files")
    return each.select(
        ((nth - 1) * cameras + F.col("_camera") - 1).cast("long").alias("cycle_index"),
        F.concat(F.lit("sim-cam-"), F.col("_camera").cast("string")).alias("camera_id"),
        nth.cast("int").alias("sequence_number"),
        "file_name",
        F.col("path").alias("source_path"),
        F.col("modificationTime").alias("ts"),
        content_type(F.col("file_name")).alias("content_type"),
        F.col("length").alias("content_length"),
        F.col("content").alias("payload"),
    )


def replay(frames: DataFrame, passes: int) -> DataFrame:
    """``passes`` passes over the same frames; cycles and sequences go on."""
    facts = frames.agg(F.count("*").alias("n")).first()["n"]
    per_camera = frames.groupBy("camera_id").agg(F.max("sequence_number").alias("_last"))
    again = frames.join(per_camera, "camera_id").withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    return again.withColumns(
        {
            "cycle_index": F.col("cycle_index") + F.col("_pass") * facts,
            "sequence_number": (F.col("sequence_number") + F.col("_pass") * F.col("_last")).cast("int"),
        }
    ).drop("_pass", "_last")


def max_cycles(frames: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` cycles; 0 is no limit. A filter, so it is pushed down."""
    return frames if limit <= 0 else frames.where(F.col("cycle_index") < limit)
