import itertools
import json

from pyspark.sql import functions as F

from frameloom.plans.compile import compile_graph
from frameloom.sources.frames import FRAME
from frameloom.streaming.runs import counted_stream, restart_pauses, run_to_end

GRAPH = json.dumps(
    {
        "nodes": [
            {"id": "cam", "module": "table-source"},
            {"id": "f", "primitive": "fork"},
            {"id": "c", "module": "brightness-classifier", "config": {"maximumMean": 100}},
            {"id": "s", "primitive": "switch"},
            {"id": "dark", "module": "dataset-writer"},
            {"id": "ok", "module": "dataset-writer"},
        ],
        "edges": [
            {"from": "cam.frame", "to": "f.frame"},
            {"from": "f.a", "to": "c.frame"},
            {"from": "f.b", "to": "s.frame"},
            {"from": "c.class", "to": "s.class"},
            {"from": "s.black", "to": "dark.frame"},
            {"from": "s.ok", "to": "ok.frame"},
        ],
    }
)


def write_frames(spark, folder, first, n):
    rows = spark.range(first, first + n).select(
        F.col("id").alias("cycle_index"),
        F.concat(F.lit("cam-"), (F.col("id") % 3).cast("string")).alias("camera_id"),
        F.lit(1).alias("sequence_number"),
        F.lit("x.png").alias("file_name"),
        F.lit(None).cast("string").alias("source_path"),
        F.lit(None).cast("timestamp").alias("ts"),
        F.lit("image/png").alias("content_type"),
        F.lit(1).cast("long").alias("content_length"),
        F.chr(F.col("id") % 120 + 1).cast("binary").alias("payload"),
    )
    rows.coalesce(1).write.mode("append").parquet(folder)


def test_a_stream_gives_what_a_batch_gives(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_frames(spark, folder, 0, 200)
    batch = compile_graph(GRAPH, {"cam": spark.read.schema(FRAME).parquet(folder)}).frame
    stream = compile_graph(GRAPH, {"cam": spark.readStream.schema(FRAME).parquet(folder)}).frame
    run_to_end(stream, lambda df, _: df.write.mode("append").parquet(out), str(tmp_path / "cp"))
    columns = ["cycle_index", "s__black.camera_id", "s__ok.payload"]
    want = sorted(map(str, batch.select(*columns).collect()))
    assert sorted(map(str, spark.read.parquet(out).select(*columns).collect())) == want
    assert not (tmp_path / "cp").exists()


def test_the_counter_goes_on_after_a_failure(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    write_frames(spark, folder, 0, 10)
    stream = counted_stream(spark.readStream.schema(FRAME).parquet(folder))

    def keep(df, _):
        df.write.mode("append").parquet(out)

    run_to_end(stream, keep, checkpoint, clear_when_done=False)
    write_frames(spark, folder, 10, 5)

    def fail(df, _):
        raise RuntimeError("the sink broke")

    try:
        run_to_end(stream, fail, checkpoint)
        raise AssertionError("the failure was lost")
    except Exception as e:
        assert "the sink broke" in str(e)
    assert (tmp_path / "cp").exists()
    run_to_end(stream, keep, checkpoint)
    rows = sorted((r.cycle_index, r["count"], r.label) for r in spark.read.parquet(out).collect())
    assert rows == [(i, i + 1, "odd" if i % 2 == 0 else "even") for i in range(15)]
    by_camera = counted_stream(spark.readStream.schema(FRAME).parquet(folder), by="camera_id")
    run_to_end(by_camera, lambda df, _: df.write.mode("append").parquet(out + "2"), checkpoint + "2")
    assert spark.read.parquet(out + "2").groupBy("camera_id").agg(F.max("count").alias("n")).where("n <> 5").count() == 0


def test_pauses_before_restarts():
    first = lambda setting: list(itertools.islice(restart_pauses(setting), 6))
    assert first({"mode": " Reconnect", "maxRetries": 3, "backoffMs": 100, "maxBackoffMs": 150}) == [0.1, 0.15, 0.15]
    assert first("forever") == [0.5, 1.0, 2.0, 4.0, 5.0, 5.0] and first({"mode": "retry", "limit": 1}) == [0.5]
    assert first("fail") == first(None) == first({}) == first("nonsense") == first({"mode": "restart", "limit": 2, "backoffMs": -1})[2:] == []


def test_a_failing_run_is_restarted_from_its_checkpoint(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    write_frames(spark, folder, 0, 8)
    stream = counted_stream(spark.readStream.schema(FRAME).parquet(folder))
    failures, naps = [1, 2], []

    def shaky(df, _):
        if failures:
            failures.pop()
            raise RuntimeError("the sink broke")
        df.write.mode("append").parquet(out)

    on_error = {"mode": "restart", "limit": 2, "backoffMs": 10}
    assert run_to_end(stream, shaky, checkpoint, on_error=on_error, sleep=naps.append) == 2 and naps == [0.01, 0.02]
    assert sorted(r["count"] for r in spark.read.parquet(out).collect()) == list(range(1, 9))
