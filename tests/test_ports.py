import json

import pytest
from pyspark.sql import functions as F

from frameloom.functions import payloads
from frameloom.operators import ports as op
from frameloom.operators import sinks
from frameloom.plans.binding import LiveValues
from frameloom.plans.compile import KINDS, compile_graph, register
from frameloom.plans.graph import GraphError, read_graph
from frameloom.sources import frames as src

TABLE = "cycle_index long, camera_id string, sequence_number int, file_name string, source_path string, ts timestamp, content_type string, content_length long, payload binary"


def frames(spark, payloads_, camera="cam1"):
    rows = [(i, camera, i + 1, f"frame{i}.jpg", None, None, "image/jpeg", len(p or b""), p) for i, p in enumerate(payloads_)]
    return spark.createDataFrame(rows, TABLE)


def test_bytes(spark):
    values = [b"", b"\x00", b"\xff\xfe", None, bytes(range(256)) * 3, b"a"]
    df = spark.createDataFrame(list(enumerate(values)), "i int, p binary").repartition(3)
    rows = {r.i: r for r in df.select("i", payloads.byte_sum(F.col("p")).alias("s"), payloads.mean_byte(F.col("p")).alias("m"), payloads.inverted(F.col("p")).alias("inv")).collect()}
    for i, v in enumerate(values):
        assert rows[i].s == sum(v or b"")
        assert rows[i].m == (None if v is None else sum(v) / len(v) if v else 0.0)
        assert rows[i].inv == (None if v is None else bytes(255 - x for x in v))


def test_gate_truth_table(spark):
    cycles = spark.range(6).withColumnRenamed("id", "c")

    def values(**how):
        return [r[0] for r in cycles.orderBy("c").select(op.gate_signal(F.col("c"), **how)).collect()]

    assert values() == [True] * 6 and values(present=False) == [False] * 6
    assert values(enabled=False, sequence=(True,)) == [False] * 6
    assert values(sequence=(True, False), hold_last=True) == [True, False, False, False, False, False]
    assert values(sequence=(False, False), present=True) == [False, False, True, True, True, True]


def test_switch_truth_table(spark):
    rows = [(0, "f", "Black"), (1, "f", "OK"), (2, "f", "other"), (3, "f", None), (4, None, "ok"), (5, "f", "none")]
    df = spark.createDataFrame(rows, "i int, frame string, label string")
    signal = F.when(F.col("label") == "none", None).otherwise(F.struct(F.col("label").alias("class_label")))
    signal = F.when(F.col("label").isNull(), F.struct(F.lit(None).cast("string").alias("class_label"))).otherwise(signal)

    def reached(*names):
        ports = op.route(F.col("frame"), signal, names)
        got = df.select("i", *[c.alias(n) for n, c in ports.items()]).collect()
        return {n: {r.i for r in got if r[n] is not None} for n in names}

    assert reached("black", "ok") == {"black": {0}, "ok": {1}}
    assert reached("black", "default") == {"black": {0}, "default": {1, 2, 3}}
    assert reached("default") == {"default": {0, 1, 2, 3}}


def test_selection(spark):
    items = [json.dumps(x) for x in ({"a": 1, "b": "x"}, {"b": "y", "a": 1.0}, {"a": 2}, 3, "t", None)]
    df = spark.createDataFrame([(items,)], "items array<string>")

    def one(criterion, **how):
        r = df.select(op.select_one(F.col("items"), F.lit(criterion).cast("string"), **how).alias("s")).first().s
        return None if r is None else json.loads(r.payload)

    def many(criterion, **how):
        r = df.select(op.select_many(F.col("items"), F.lit(criterion).cast("string"), **how).alias("s")).first().s
        return None if r is None else (r.value, [json.loads(x) for x in r.payload])

    assert one("1", by="a") == {"a": 1, "b": "x"} and one("9", by="a") is None and one(None, by="a") is None
    assert many("1", by="a") == (True, [{"a": 1, "b": "x"}, {"b": "y", "a": 1.0}])
    assert many('{"b": "y"}', fields=("b",)) == (True, [{"b": "y", "a": 1.0}])
    assert many('"t"') == (True, ["t"]) and many("3.0") == (True, [3]) and many('"none"') == (False, [])
    assert many(None) is None


def test_criterion_precedence(spark):
    message = F.struct(F.lit('"edge"').alias("payload"))
    empty = F.struct(F.lit(None).cast("string").alias("payload"))
    missing = F.when(F.lit(False), message)
    live, static = F.lit('"live"'), F.lit('"static"')
    row = spark.range(1).select(
        op.criterion_of(message, live, static), op.criterion_of(empty, live, static),
        op.criterion_of(missing, live, static), op.criterion_of(missing, None, static), op.criterion_of(None, None, None),
    ).first()
    assert tuple(row) == ('"edge"', None, '"live"', '"static"', None)


def test_fan_in_skips_only_if_all_are_missing(spark):
    a = spark.createDataFrame([(0, "a"), (1, "a")], "cycle_index long, a string")
    b = spark.createDataFrame([(1, "b"), (2, "b")], "cycle_index long, b string")
    assert sorted(map(tuple, op.in_step(a, b).collect())) == [(0, "a", None), (1, "a", "b"), (2, None, "b")]
    assert op.in_step(a, b, all_needed=True).count() == 1


def test_counter_counts_messages_over_blocks(spark):
    df = spark.range(50).select(F.col("id").alias("cycle_index"), F.when(F.col("id") % 3 != 0, F.lit("x")).alias("port"))
    got = op.counted(df, "port", "class", block=7).orderBy("cycle_index").collect()
    n = 0
    for r in got:
        if r.port is None:
            assert r["class"] is None
            continue
        n += 1
        assert (r["class"].measurement, r["class"].class_label, r["class"].details) == (n, "odd" if n % 2 else "even", f"seen {n}")


def test_ordinal_with_gaps(spark):
    ids = [5, 100, 7, 10_000_000, -3, 66_000]
    df = spark.createDataFrame([(i,) for i in ids], "k long")
    got = {r.k: r.n for r in src.ordinal(df, "k", "n", block=64).collect()}
    assert got == {k: n for n, k in enumerate(sorted(ids))}


def test_folder_source(spark, tmp_path):
    assert src.folder_frames(spark, str(tmp_path / "missing")).count() == 0
    for name, data in (("b.PNG", b"2"), ("a.jpg", b"1"), ("c.dat", b"3")):
        (tmp_path / name).write_bytes(data)
    rows = src.folder_frames(spark, str(tmp_path), cameras=2, passes=2).orderBy("cycle_index").collect()
    assert [r.cycle_index for r in rows] == list(range(12))
    assert [r.camera_id for r in rows[:3]] == ["sim-cam-1", "sim-cam-2", "sim-cam-1"]
    assert [bytes(r.payload) for r in rows[::2]] == [b"1", b"2", b"3"] * 2
    assert [r.sequence_number for r in rows[::2]] == [1, 2, 3, 4, 5, 6]
    assert [r.content_type for r in rows[:6:2]] == ["image/jpeg", "image/png", "application/octet-stream"]


LINE = {
    "nodes": [
        {"id": "cam", "module": "table-source"},
        {"id": "bright", "module": "brightness-gate"},
        {"id": "save", "module": "dataset-writer"},
        {"id": "all", "module": "dataset-writer"},
        {"id": "f", "primitive": "fork"},
    ],
    "edges": [
        {"from": "cam.frame", "to": "f.frame"},
        {"from": "f.a", "to": "bright.frame"},
        {"from": "bright.frame", "to": "save.frame"},
    ],
}


def test_a_graph_end_to_end(spark, tmp_path):
    run = compile_graph(json.dumps(LINE), {"cam": frames(spark, [b"\x05", b"\x40", b"", None, b"\xff\x10"])})
    assert tuple(run.report().first()) == (5, 2)
    assert [r.stored_name for r in run.sink("save").orderBy("nth").collect()] == ["000001-cam1-seq0002.jpg", "000002-cam1-seq0005.jpg"]
    stats = {r.node: r.messages for r in run.stats().collect()}
    assert stats == {"cam": 5, "f": 5, "bright": 2}
    sinks.write_session(run.frame, "bright__frame", str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    assert sinks.session_summary(run.sink("save").where("nth > 9")).count() == 0


def test_limits_sources_and_refusals(spark):
    assert compile_graph(json.dumps(LINE), {"cam": frames(spark, [b"x"] * 9)}, cycles=4).report().first().total_cycles == 4
    two = {
        "nodes": [{"id": "a", "module": "table-source"}, {"id": "b", "module": "table-source"}, {"id": "s", "module": "dataset-writer"}, {"id": "t", "module": "dataset-writer"}],
        "edges": [{"from": "a.frame", "to": "s.frame"}, {"from": "b.frame", "to": "t.frame"}],
    }
    run = compile_graph(json.dumps(two), {"a": frames(spark, [b"1"] * 5), "b": frames(spark, [b"2"] * 3)})
    assert tuple(run.report().first()) == (3, 3)
    double = json.loads(json.dumps(two))
    double["edges"][1]["to"] = "s.frame"
    loop = {"nodes": [*two["nodes"], {"id": "l", "primitive": "loop", "config": {"mode": "forever"}}], "edges": two["edges"]}
    for bad in (double, loop, {"nodes": [{"id": "s", "module": "dataset-writer"}]}):
        with pytest.raises(GraphError):
            compile_graph(json.dumps(bad), {"a": frames(spark, [b"1"]), "b": frames(spark, [b"2"])})


def test_own_modules_and_live_values(spark):
    register("first-byte", "classifier", lambda f, c: F.when(
        f.isNotNull(), op.classification(F.hex(F.substring(f.getField("payload"), 1, 1)), F.lit(None), None, F.lit(None).cast("string"), "own")))
    graph = read_graph(
        json.dumps({
            "nodes": [{"id": "cam", "module": "table-source"}, {"id": "c", "module": "first-byte"},
                      {"id": "s", "primitive": "switch"}, {"id": "save", "module": "dataset-writer"},
                      {"id": "v", "primitive": "value", "config": {"type": "int", "literal": 1}}],
            "edges": [{"from": "cam.frame", "to": "s.frame"}, {"from": "cam.frame", "to": "c.frame"},
                      {"from": "c.class", "to": "s.class"}, {"from": "s.7F", "to": "save.frame"}],
        }), KINDS)
    live = LiveValues()
    source = {"cam": frames(spark, [b"\x7f", b"\x01"])}
    run = compile_graph(graph, source, live=live)
    assert run.report().first().accepted_cycles == 1
    live.register(graph.node("v"))
    assert run.frame.first().v__value.payload == "1"
    assert live.try_set("v", 2) is None
    assert compile_graph(graph, source, live=live).frame.first().v__value.payload == "2"


def test_sums_widen_no_whole_batch(monkeypatch):
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    values = [rng.bytes(8 << 20), b"", None, *(rng.bytes(3000) for _ in range(2000))]
    want = [int(np.frombuffer(v or b"", np.uint8).sum(dtype=np.int64)) for v in values]
    batch = pa.array(values, pa.binary())
    tracemalloc.start()
    assert payloads._sums(batch).tolist() == want
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20
    small = pa.array([b"", b"abc", None, b"", b"x" * 20, b"\xff" * 7, b"", None, b"z"], pa.binary())
    for at_once in (1, 2, 7, 30, 31):
        monkeypatch.setattr(payloads, "AT_ONCE", at_once)
        for cut in (small, small.slice(1), small.slice(2, 5), small.slice(3, 1), small.slice(9)):
            assert payloads._sums(cut).tolist() == [sum(v or b"") for v in cut.to_pylist()]
