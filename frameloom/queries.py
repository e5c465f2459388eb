"""Queries over the driver tables, one for each operator, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom import demos
from frameloom.functions import images, payloads
from frameloom.operators import ports as op
from frameloom.operators import sinks
from frameloom.plans.compile import CLASSIFIERS, column, compile_graph
from frameloom.sources import frames as src

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

E = """WITH e AS (
  SELECT row_number() OVER (ORDER BY event_id) - 1 AS cycle_index, 'cam-' || user_id AS camera_id,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence_number,
         'event-' || event_id || '.json' AS file_name, octet_length(encode(props)) AS content_length,
         event_id, event_type, value, props FROM events
) """
D = """WITH d AS (
  SELECT doc_id AS cycle_index, source AS camera_id, encode(coalesce(text, '')) AS payload,
         octet_length(encode(coalesce(text, ''))) AS n,
         list_sum(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::INT)) AS s
  FROM documents
), m AS (SELECT *, CASE WHEN n = 0 THEN 0.0 ELSE s::DOUBLE / n END AS mean FROM d) """


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a wide row: the frame port beside the event's own columns."""
    f = src.event_frames(_read(spark, sf_dir, "events"))
    return f.select("cycle_index", "event_type", "value", op.frame_port(f).alias("frame"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.document_frames(_read(spark, sf_dir, "documents"))


def _labelled(label: Column) -> Column:
    return op.classification(label, F.lit(None), None, F.lit(None).cast("string"), "events").withField("class_label", label)


# -- sources and limits -------------------------------------------------------


@query(
    "source_frames",
    E + "SELECT cycle_index, camera_id, sequence_number, file_name, 'application/json' AS content_type, content_length FROM e",
)
def source_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.event_frames(_read(spark, sf_dir, "events")).select(
        "cycle_index", "camera_id", F.col("sequence_number").cast("long").alias("sequence_number"), "file_name", "content_type", "content_length"
    )


@query(
    "source_multi_camera",
    """WITH f AS (SELECT n_nationkey + 1 AS nth, 'flags/' || n_name || CASE WHEN n_nationkey % 2 = 0 THEN '.PNG' ELSE '.dat' END AS path,
  count(*) OVER () AS total FROM nation), x AS (SELECT *, p.range AS p, c.range AS c FROM f, range(0, 2) p, range(1, 4) c)
SELECT (nth + p * total - 1) * 3 + c - 1 AS cycle_index, 'sim-cam-' || c AS camera_id, nth + p * total AS sequence_number,
  path AS source_path, CASE WHEN path LIKE '%.PNG' THEN 'image/png' ELSE 'application/octet-stream' END AS content_type FROM x""",
)
def source_multi_camera(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _read(spark, sf_dir, "nation")
    suffix = F.when(F.col("n_nationkey") % 2 == 0, ".PNG").otherwise(".dat")
    files = nation.select(
        (F.col("n_nationkey") + 1).alias("nth"),
        F.concat(F.lit("flags/"), "n_name", suffix).alias("path"),
        F.concat("n_name", suffix).alias("file_name"),
        F.lit(None).cast("timestamp").alias("modificationTime"),
        F.lit(0).cast("long").alias("length"),
        F.lit(b"").alias("content"),
    ).crossJoin(F.broadcast(nation.agg(F.count("*").alias("n_files"))))
    return src.multi_camera(files, 3, 2).select(
        "cycle_index", "camera_id", F.col("sequence_number").cast("long").alias("sequence_number"), "source_path", "content_type"
    )


@query("max_cycles", E + "SELECT cycle_index, camera_id FROM e WHERE cycle_index < 500")
def max_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.max_cycles(src.event_frames(_read(spark, sf_dir, "events")), 500).select("cycle_index", "camera_id")


LOOP = '{"nodes": [{"id": "cam", "module": "table-source"}, {"id": "save", "module": "dataset-writer"}, %s], "edges": [{"from": "cam.frame", "to": "save.frame"}, {"from": "save", "to": "cycle"}]}'


@query("loop_count", E + "SELECT count(*) AS total_cycles, count(*) AS accepted_cycles FROM e WHERE cycle_index < 120")
def loop_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = LOOP % '{"id": "cycle", "primitive": "loop", "config": {"mode": "count", "count": 120}}'
    return compile_graph(graph, {"cam": src.event_frames(_read(spark, sf_dir, "events"))}).report()


@query(
    "loop_forever_capped",
    """WITH n AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS i, n_name, count(*) OVER () AS total FROM nation)
SELECT i + p.range * total AS cycle_index, n_name AS camera_id, 1 + p.range AS sequence_number FROM n, range(0, 8) p WHERE i + p.range * total < 180""",
)
def loop_forever_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = src.ordinal(_read(spark, sf_dir, "nation"), "n_nationkey", "cycle_index")
    frames = nation.select(
        "cycle_index",
        F.col("n_name").alias("camera_id"),
        F.lit(1).alias("sequence_number"),
        F.col("n_name").alias("file_name"),
        F.lit(None).cast("string").alias("source_path"),
        F.lit(None).cast("timestamp").alias("ts"),
        F.lit("text/plain").alias("content_type"),
        F.lit(0).cast("long").alias("content_length"),
        F.lit(b"").alias("payload"),
    )
    graph = LOOP % '{"id": "cycle", "primitive": "loop", "config": {"mode": "forever"}}'
    wide = compile_graph(graph, {"cam": frames}, cycles=180).frame
    return wide.select("cycle_index", "cam__frame.camera_id", F.col("cam__frame.sequence_number").cast("long").alias("sequence_number"))


# -- gates, filters, routing --------------------------------------------------


def _gate(name: str, sql: str, **how) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _events(spark, sf_dir).select("cycle_index", op.gate_signal(F.col("cycle_index"), **how).alias("present"))

    query(name, E + f"SELECT cycle_index, {sql} AS present FROM e")(run)


_gate("gate_sequence_hold", "CASE WHEN cycle_index < 4 THEN [true, false, true, false][cycle_index + 1] ELSE false END",
      sequence=(True, False, True, False), hold_last=True)
_gate("gate_sequence_fallback", "CASE WHEN cycle_index < 3 THEN [false, false, true][cycle_index + 1] ELSE true END",
      sequence=(False, False, True))
_gate("gate_disabled", "false", enabled=False, sequence=(True, True))


@query("fork_fanout", E + "SELECT cycle_index, p.unnest AS port FROM e, unnest(['a', 'b', 'c']) p")
def fork_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = """{"nodes": [{"id": "cam", "module": "table-source"}, {"id": "f", "primitive": "fork"},
      {"id": "s1", "module": "dataset-writer"}, {"id": "s2", "module": "dataset-writer"}, {"id": "s3", "module": "dataset-writer"}],
      "edges": [{"from": "cam.frame", "to": "f.frame"}, {"from": "f.a", "to": "s1.frame"}, {"from": "f.b", "to": "s2.frame"}, {"from": "f.c", "to": "s3.frame"}]}"""
    wide = compile_graph(graph, {"cam": src.event_frames(_read(spark, sf_dir, "events"))}).frame
    ports = F.explode(F.array(*[F.struct(F.lit(p).alias("port"), F.col(column("f", p)).alias("frame")) for p in "abc"]))
    return wide.select("cycle_index", ports.alias("x")).where("x.frame is not null").select("cycle_index", "x.port")


@query("if_gate", E + "SELECT cycle_index, camera_id FROM e WHERE cycle_index < 6 AND [true, false, true, true, false, true][cycle_index + 1]")
def if_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = """{"nodes": [{"id": "cam", "module": "table-source"},
      {"id": "gate", "module": "product-gate", "config": {"sequence": [true, false, true, true, false, true], "productPresent": false}},
      {"id": "branch", "primitive": "if"}, {"id": "save", "module": "dataset-writer"}],
      "edges": [{"from": "cam.frame", "to": "branch.frame"}, {"from": "gate.productPresent", "to": "branch.productPresent"}, {"from": "branch.acceptedFrame", "to": "save.frame"}]}"""
    wide = compile_graph(graph, {"cam": src.event_frames(_read(spark, sf_dir, "events"))}).frame
    return wide.where("branch__acceptedframe is not null").select("cycle_index", "branch__acceptedframe.camera_id")


def _switch(name: str, ports: tuple[str, ...], sql: str, label: Callable[[], Column] = lambda: F.col("event_type")) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        wide = _events(spark, sf_dir).withColumn("class", _labelled(label()))
        routed = op.route(F.col("frame"), F.col("class"), ports)
        port = F.coalesce(*[F.when(c.isNotNull(), p) for p, c in routed.items()])
        return wide.select("cycle_index", port.alias("port")).where("port is not null")

    query(name, E + sql)(run)


_switch("switch_exact", ("click", "VIEW", "signup", "purchase", "error"),
        "SELECT cycle_index, CASE WHEN event_type = 'view' THEN 'VIEW' ELSE event_type END AS port FROM e "
        "WHERE event_type IN ('click', 'view', 'signup', 'purchase', 'error')")  # fmt: skip
_switch("switch_default", ("Click", "default"),
        "SELECT cycle_index, CASE WHEN event_type = 'click' THEN 'Click' ELSE 'default' END AS port FROM e")
_switch("switch_drop", ("click", "view"), "SELECT cycle_index, event_type AS port FROM e WHERE event_type IN ('click', 'view')")
_switch("switch_null_label", ("click", "default"),
        "SELECT cycle_index, CASE WHEN value <= 100 AND event_type = 'click' THEN 'click' ELSE 'default' END AS port FROM e",
        lambda: F.when(F.col("value") <= 100, F.col("event_type")))


@query("processor_brightness_gate", D + "SELECT cycle_index, camera_id FROM m WHERE mean >= 94.5")
def processor_brightness_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    # As a filter alone: an accepted frame that is selected too is measured twice.
    f = _documents(spark, sf_dir)
    return f.where(op.bright_enough(op.frame_port(f), 94.5).isNotNull()).select("cycle_index", "camera_id")


def _decoded() -> Column:
    """A measured mean that fails on every seventh event."""
    return F.when(F.col("cycle_index") % 7 != 0, F.col("value"))


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as small pictures, a bitmap or a PNG by turns, as bright as the
    event's value; those of every seventh event are cut short."""
    f = src.event_frames(_read(spark, sf_dir, "events"))
    level = F.least(F.greatest(F.floor("value"), F.lit(0)), F.lit(255)).cast("int")
    odd = F.col("cycle_index") % 2 == 1
    kind = F.when(odd, "image/png").otherwise("image/bmp")
    drawn = images.drawn(level, kind)
    payload = F.when(F.col("cycle_index") % 7 == 0, F.substring(drawn, 1, 40)).otherwise(drawn)
    f = f.withColumns({"content_type": kind, "payload": payload})
    return f.select("cycle_index", op.frame_port(f).alias("frame"))


LEVEL = "least(greatest(floor(value), 0), 255)"


@query("processor_dark_filter", E + f"SELECT cycle_index FROM e WHERE cycle_index % 7 <> 0 AND {LEVEL} >= 18")
def processor_dark_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = F.col("frame")
    kept = _pictures(spark, sf_dir).select("cycle_index", op.not_dark(frame, images.decoded_mean(frame)).alias("f"))
    return kept.where("f is not null").select("cycle_index")


@query("processor_black_check", E + f"SELECT cycle_index FROM e WHERE cycle_index % 7 = 0 OR {LEVEL} <= 40")
def processor_black_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = F.col("frame")
    kept = _pictures(spark, sf_dir).select("cycle_index", op.is_black(frame, images.decoded_mean(frame)).alias("f"))
    return kept.where("f is not null").select("cycle_index")


# -- classifiers and transformers ---------------------------------------------

BRIGHT = "SELECT cycle_index, CASE WHEN n = 0 THEN 'unknown' WHEN mean <= 94.0 THEN 'black' ELSE 'ok' END AS class_label, " \
    "CASE WHEN n > 0 THEN mean END AS measurement, 'mean-byte' AS unit, " \
    "CASE WHEN n = 0 THEN 'empty frame' ELSE 'n=' || n END AS details FROM "  # fmt: skip
FIELDS = ("class.class_label", "class.measurement", "class.unit", "class.details")


@query("classify_brightness", D + BRIGHT + "m")
def classify_brightness(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _documents(spark, sf_dir)
    return f.select("cycle_index", op.classify_brightness(op.frame_port(f), 94.0).alias("class")).select("cycle_index", *FIELDS)


@query("classify_empty", D + BRIGHT + "(SELECT cycle_index, CASE WHEN cycle_index % 10 = 0 THEN 0 ELSE n END AS n, mean FROM m)")
def classify_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _documents(spark, sf_dir)
    f = f.withColumn("payload", F.when(F.col("cycle_index") % 10 == 0, F.lit(b"")).otherwise(F.col("payload")))
    return f.select("cycle_index", op.classify_brightness(op.frame_port(f), 94.0).alias("class")).select("cycle_index", *FIELDS)


@query("classify_length", D + "SELECT cycle_index, 'seen' AS class_label, n::DOUBLE AS measurement, 'bytes' AS unit FROM m")
def classify_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _documents(spark, sf_dir)
    return f.select("cycle_index", op.classify_length(op.frame_port(f)).alias("class")).select("cycle_index", *FIELDS[:3])


@query("classify_warmup", D + "SELECT cycle_index, 'ok' AS class_label, n::DOUBLE AS measurement, 'bytes' AS unit, 'warmed up' AS details FROM m")
def classify_warmup(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _documents(spark, sf_dir)
    return f.select("cycle_index", CLASSIFIERS["warmup-classifier"](op.frame_port(f), {}).alias("class")).select("cycle_index", *FIELDS)


@query("classify_mean", D + "SELECT cycle_index, 'seen' AS class_label, CASE WHEN n > 0 THEN mean END AS measurement, 'mean' AS unit FROM m")
def classify_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _documents(spark, sf_dir).withColumn("n", F.octet_length("payload"))
    made = f.select("cycle_index", "n", CLASSIFIERS["mean"](op.frame_port(f), {}).alias("class"))
    return made.select("cycle_index", "class.class_label", F.when(F.col("n") > 0, F.col("class.measurement")).alias("measurement"), "class.unit")


@query("classify_counter_route", E + """SELECT cycle_index, 'even' AS class_label, cycle_index + 1 AS seen, 'count' AS unit,
  'seen ' || (cycle_index + 1) AS details FROM e WHERE (cycle_index + 1) % 2 = 0""")
def classify_counter_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = op.counted(_events(spark, sf_dir), "frame", "class", block=1 << 12)
    even = op.route(F.col("frame"), F.col("class"), ("even",))["even"]
    return wide.where(even.isNotNull()).select(
        "cycle_index", "class.class_label", F.col("class.measurement").cast("long").alias("seen"), "class.unit", "class.details"
    )


@query("transform_invert", D + "SELECT cycle_index, md5(translate(hex(payload), '0123456789ABCDEF', 'FEDCBA9876543210')) AS digest FROM d")
def transform_invert(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _documents(spark, sf_dir)
    return f.select("cycle_index", F.md5(F.hex(op.invert(op.frame_port(f)).getField("payload"))).alias("digest"))


# -- fan-in, values, selection ------------------------------------------------


@query("fan_in_lockstep", E + "SELECT cycle_index, camera_id, value FROM e")
def fan_in_lockstep(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _events(spark, sf_dir)
    a, b = wide.select("cycle_index", "frame"), wide.select("cycle_index", F.struct("value").alias("signal"))
    return op.in_step(a, b, all_needed=True).select("cycle_index", "frame.camera_id", "signal.value")


@query(
    "fan_in_void_skip",
    E + "SELECT cycle_index, value > 100 AS has_frame, event_type = 'click' AS has_signal FROM e WHERE value > 100 OR event_type = 'click'",
)
def fan_in_void_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _events(spark, sf_dir)
    a = wide.where("value > 100").select("cycle_index", "frame")
    b = wide.where("event_type = 'click'").select("cycle_index", F.struct("event_type").alias("signal"))
    return op.in_step(a, b).select(
        "cycle_index", F.col("frame").isNotNull().alias("has_frame"), F.col("signal").isNotNull().alias("has_signal")
    )


@query("value_constant", E + "SELECT cycle_index, 'value' AS signal_type, true AS holds, '40' AS payload FROM e")
def value_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _events(spark, sf_dir).select("cycle_index", op.value_signal(F.lit("40")).alias("v"))
    return wide.select("cycle_index", "v.signal_type", F.col("v.value").alias("holds"), "v.payload")


@query("value_list", E + "SELECT cycle_index, 'list' AS signal_type, false AS holds, 0::BIGINT AS items FROM e")
def value_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _events(spark, sf_dir).select("cycle_index", op.value_signal(F.array().cast("array<string>"), True).alias("v"))
    return wide.select("cycle_index", "v.signal_type", F.col("v.value").alias("holds"), F.size("v.payload").cast("long").alias("items"))


ITEMS = """WITH i AS (SELECT l_orderkey AS cycle_index, l_linenumber AS line, l_returnflag AS flag, l_linestatus AS status FROM lineitem) """


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as a list message of JSON objects; an order has few."""
    lines = _read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("cycle_index"),
        F.col("l_linenumber").alias("line"),
        F.to_json(
            F.struct(F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))
        ).alias("item"),
    )
    return lines.groupBy("cycle_index").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("line", "item"))), lambda x: x.item).alias("items")
    )


def _line(item: Column) -> Column:
    return F.get_json_object(item, "$.line").cast("long")


def _select(name: str, sql: str, criterion: str | None, many: bool = False, edge: Callable[[], Column] | None = None, **how) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        static = F.lit(criterion).cast("string")
        wanted = op.criterion_of(edge() if edge else None, None, static)
        pick = op.select_many if many else op.select_one
        wide = _orders(spark, sf_dir).select("cycle_index", pick(F.col("items"), wanted, **how).alias("s")).where("s is not null")
        if many:
            lines = F.array_join(F.transform("s.payload", lambda x: _line(x).cast("string")), ",")
            return wide.select("cycle_index", F.col("s.value").alias("holds"), lines.alias("lines"))
        return wide.select("cycle_index", _line(F.col("s.payload")).alias("line"))

    query(name, ITEMS + sql)(run)


MANY = "coalesce(count(*) FILTER ({0}) > 0, false) AS holds, coalesce(string_agg(line::VARCHAR, ',' ORDER BY line) FILTER ({0}), '') AS lines"
_select("select_one_by", "SELECT cycle_index, min(line)::BIGINT AS line FROM i WHERE flag = 'R' GROUP BY 1", '"R"', by="flag")
_select("select_many_by", "SELECT cycle_index, " + MANY.format("flag = 'N'") + " FROM i GROUP BY 1", '"N"', True, by="flag")
_select("select_many_empty", "SELECT cycle_index, false AS holds, '' AS lines FROM i GROUP BY 1", '"?"', True, by="flag")
_select("select_object_subset", "SELECT cycle_index, min(line)::BIGINT AS line FROM i WHERE flag = 'N' AND status = 'O' GROUP BY 1",
        '{"status": "O", "flag": "N"}', fields=("flag", "status"))
_select("select_criterion_edge", "SELECT cycle_index, " + MANY.format("flag = 'A'") + " FROM i WHERE cycle_index % 3 <> 0 GROUP BY 1",
        '"R"', True, by="flag",
        edge=lambda: F.struct(F.when(F.col("cycle_index") % 3 != 0, F.lit('"A"')).alias("payload")))


@query("select_scalar", "SELECT l_orderkey AS cycle_index, count(*) AS found FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1")
def select_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("cycle_index"))
    flags = lines.agg(F.collect_list(F.to_json(F.to_variant_object(F.array("l_returnflag")))).alias("raw"))
    items = F.transform("raw", lambda x: F.regexp_extract(x, r"\[(.*)\]", 1))
    picked = flags.select("cycle_index", op.select_many(items, F.lit('"A"')).alias("s"))
    return picked.where("s.value").select("cycle_index", F.size("s.payload").cast("long").alias("found"))


# -- sinks and reports --------------------------------------------------------

KEPT = "(SELECT *, row_number() OVER (ORDER BY cycle_index) AS nth FROM e WHERE value > 100)"


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _events(spark, sf_dir).withColumn("kept", op.accept(F.col("frame"), F.col("value") > 100))
    return sinks.records(wide, "kept")


@query("sink_records", E + "SELECT nth, camera_id, printf('%06d-%s-seq%04d.bin', nth, camera_id, sequence_number) AS stored_name FROM " + KEPT)
def sink_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir).select("nth", "camera_id", "stored_name")


@query(
    "sink_extension",
    E + """, x AS (SELECT cycle_index, ['a.JPG', 'b.tiff', 'c.txt', 'noext', 'd.dat'][cycle_index % 5 + 1] AS file_name,
  ['image/png', 'IMAGE/JPEG', 'text/plain'][cycle_index % 3 + 1] AS content_type FROM e)
SELECT cycle_index, CASE WHEN file_name = 'a.JPG' THEN '.JPG' WHEN file_name = 'b.tiff' THEN '.tiff'
  WHEN lower(content_type) = 'image/png' THEN '.png' WHEN lower(content_type) = 'image/jpeg' THEN '.jpg' ELSE '.bin' END AS extension FROM x""",
)
def sink_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("cycle_index").cast("int")
    names = F.array(*[F.lit(x) for x in ("a.JPG", "b.tiff", "c.txt", "noext", "d.dat")])
    types = F.array(*[F.lit(x) for x in ("image/png", "IMAGE/JPEG", "text/plain")])
    return _events(spark, sf_dir).select("cycle_index", sinks.extension(F.get(names, c % 5), F.get(types, c % 3)).alias("extension"))


@query(
    "session_summary",
    E + "SELECT count(*) AS frame_count, sum(content_length)::BIGINT AS total_bytes, count(DISTINCT camera_id) AS cameras FROM " + KEPT,
)
def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.session_summary(_kept(spark, sf_dir))


@query("inspect_session", E + "SELECT camera_id, count(*) AS frames FROM " + KEPT + " GROUP BY 1")
def inspect_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.per_camera(_kept(spark, sf_dir))


@query(
    "accepted_cycles",
    E + "SELECT count(*) AS total_cycles, count(*) FILTER (value > 100 OR event_type = 'click') AS accepted_cycles FROM e",
)
def accepted_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("frame")
    wide = _events(spark, sf_dir).withColumns(
        {"a": op.accept(f, F.col("value") > 100), "b": op.accept(f, F.col("event_type") == "click")}
    )
    return sinks.run_report(wide, ["a", "b"])


@query(
    "node_stats_counts",
    E + "SELECT 'all' AS node, count(*) AS messages FROM e UNION ALL SELECT 'gate', count(*) FILTER (value > 100) FROM e",
)
def node_stats_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _events(spark, sf_dir).withColumn("kept", op.accept(F.col("frame"), F.col("value") > 100))
    return sinks.node_stats(wide, {"all": "frame", "gate": "kept"})


@query(
    "source_profile_avg",
    E + "SELECT count(*) AS frames, count(v) AS measured, round(avg(v), 6) AS average, max(v) AS largest FROM (SELECT CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM e)",
)
def source_profile_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = sinks.source_profile(_events(spark, sf_dir).withColumn("v", _decoded()), "v")
    return profile.withColumn("average", F.round("average", 6))


@query(
    "tensor_descriptor",
    """SELECT vec_id, 'tensor' AS media_type, 'f32' AS element_type, len(embedding)::BIGINT AS d0, 2::BIGINT AS d1,
  8::BIGINT AS stride0, 4::BIGINT AS stride1, len(embedding)::BIGINT * 8 AS payload_length FROM embeddings""",
)
def tensor_descriptor(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    shape = F.array(F.size("embedding").cast("long"), F.lit(2).cast("long"))
    v = vectors.select("vec_id", shape.alias("shape"), F.lit("f32").alias("element_type"))
    steps = payloads.strides(F.col("shape"), F.col("element_type"))
    return v.select(
        "vec_id",
        F.lit("tensor").alias("media_type"),
        "element_type",
        F.get("shape", 0).alias("d0"),
        F.get("shape", 1).alias("d1"),
        F.get(steps, 0).alias("stride0"),
        F.get(steps, 1).alias("stride1"),
        payloads.payload_length(F.col("shape"), F.col("element_type")).alias("payload_length"),
    )


# -- whole graphs -------------------------------------------------------------

LABELS = "count(*) FILTER (n > 0 AND mean <= 94.0) AS black, count(*) FILTER (n > 0 AND mean > 94.0) AS ok"


def _sink_counts(wide: DataFrame, sinks_of: dict[str, str]) -> DataFrame:
    return wide.agg(*[F.count(F.col(port)).alias(name) for name, port in sinks_of.items()])


@query("brightness_demo", D + f"SELECT {LABELS}, (sum(255 * n - s) FILTER (n > 0 AND mean <= 94.0))::BIGINT AS inverted_sum FROM m")
def brightness_demo(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = compile_graph(demos.SORTING, {"feed": _documents(spark, sf_dir)}).frame
    return wide.agg(
        F.count("flip__frame").alias("black"),
        F.count("lanes__ok").alias("ok"),
        F.sum(payloads.byte_sum(F.col("flip__frame.payload"))).alias("inverted_sum"),
    )


@query("inspection_demo", D + f"SELECT {LABELS}, count(*) AS sampled "
    "FROM (SELECT m.*, m.cycle_index + p.range * count(*) OVER (PARTITION BY p.range) AS c FROM m, range(0, 3) p) WHERE c % 2 = 1")
def inspection_demo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three passes over all documents; the loop rewinds its source twice."""
    documents = _documents(spark, sf_dir)
    wide = compile_graph(demos.SAMPLING, {"feed": documents}, cycles=3 * documents.count()).frame
    return _sink_counts(wide, {"black": "lanes__black", "ok": "lanes__ok", "sampled": "keep__even"})


@query(
    "value_demo",
    E + """SELECT cycle_index, 'm5' AS one, 5::BIGINT AS many FROM e""",
)
def value_demo(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = compile_graph(demos.NARROWING, {"feed": src.event_frames(_read(spark, sf_dir, "events"))}).frame
    return wide.select(
        "cycle_index",
        F.get_json_object("chosen__selected.payload", "$.tag").alias("one"),
        F.size("inhall__selected.payload").cast("long").alias("many"),
    )


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sorting graph, frame by frame: its lane and the inverse's digest."""
    wide = compile_graph(demos.SORTING, {"feed": _documents(spark, sf_dir)}).frame
    return wide.select(
        "cycle_index",
        "feed__frame.camera_id",
        F.col("gauge__class.class_label").alias("label"),
        F.col("gauge__class.measurement").alias("mean_byte"),
        F.when(F.col("lanes__black").isNotNull(), "black").when(F.col("lanes__ok").isNotNull(), "ok").alias("route"),
        F.md5("flip__frame.payload").alias("inverted_md5"),
    )
