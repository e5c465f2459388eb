import json
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from frameloom.__main__ import main
from frameloom.functions import images, modules
from frameloom.operators import ports as op
from frameloom.plans.compile import compile_graph, register
from frameloom.sources import frames as sources
from tests.test_ports import frames


def bitmap(pixels, bits=24):
    height, width = len(pixels), len(pixels[0])
    rows = b""
    for r in pixels:
        raw = b"".join(bytes([v] * (bits // 8)) for v in r)
        rows += raw + b"\0" * (-len(raw) % 4)
    head = struct.pack("<2sIHHI", b"BM", 54 + len(rows), 0, 0, 54)
    return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, bits, 0, len(rows), 0, 0, 0, 0) + rows


def test_bitmaps():
    assert abs(images.bitmap_gray_mean(bitmap([[0, 100, 200], [10, 20, 30]])) - 60) < 1e-9
    assert images.bitmap_gray_mean(bitmap([[7, 9]], 8)) == 8
    assert abs(images.bitmap_gray_mean(bitmap([[5]], 32)) - 5) < 1e-9
    for bad in (b"", b"BM", b"PNG", bitmap([[1, 2]])[:-3]):
        assert images.bitmap_gray_mean(bad) is None


def test_decoded_mean_and_failures(spark):
    df = frames(spark, [bitmap([[20, 40]]), b"broken", b"\x10\x20"])
    kind = F.when(F.col("cycle_index") < 2, "image/bmp").otherwise("application/octet-stream")
    df = df.withColumn("content_type", kind)
    mean = images.decoded_mean(op.frame_port(df))
    rows = df.select(mean.alias("m"), op.not_dark(op.frame_port(df), mean).isNotNull().alias("kept"),
                     op.is_black(op.frame_port(df), mean).isNotNull().alias("black")).collect()
    assert [(r.m and round(r.m, 6), r.kept, r.black) for r in rows] == [(30, True, True), (None, False, True), (24, True, True)]


def test_own_functions_fail_without_failing_the_run(spark):
    register("length-parity", "classifier", modules.classifier(
        lambda b: {"label": "even" if len(b) % 2 == 0 else "odd", "measurement": 1 / (len(b) - 3)}))
    register("longer", "processor", modules.processor(lambda b: len(b) > 1))
    register("doubled", "processor", modules.transformer(lambda b: b + b if b[0] else None))
    graph = {
        "nodes": [{"id": "cam", "module": "table-source"}, {"id": "p", "module": "longer"}, {"id": "t", "module": "doubled"},
                  {"id": "c", "module": "length-parity"}, {"id": "s", "module": "dataset-writer"}],
        "edges": [{"from": "cam.frame", "to": "p.frame"}, {"from": "p.frame", "to": "t.frame"}, {"from": "cam.frame", "to": "c.frame"},
                  {"from": "t.frame", "to": "s.frame"}],
    }
    run = compile_graph(json.dumps(graph), {"cam": frames(spark, [b"ab", b"a", b"abc", b"\0bcd", None, b""])})
    rows = run.frame.orderBy("cycle_index").collect()
    assert [r.c__class and r.c__class.class_label for r in rows] == ["even", "odd", None, "even", None, "even"]
    assert [r.t__frame and bytes(r.t__frame.payload) for r in rows] == [b"abab", None, b"abcabc", None, None, None]


def test_command_line(spark, tmp_path, capsys):
    folder = tmp_path / "frames"
    folder.mkdir()
    for i in range(3):
        (folder / f"f{i}.bin").write_bytes(bytes([50 * i]) * 10)
    graph = {
        "nodes": [{"id": "cam", "module": "folder-source"}, {"id": "g", "module": "brightness-gate"},
                  {"id": "s", "module": "dataset-writer", "config": {"sessionPrefix": "kept"}}],
        "edges": [{"from": "cam.frame", "to": "g.frame"}, {"from": "g.frame", "to": "s.frame"}],
    }
    path = tmp_path / "graph.json"
    path.write_text(json.dumps(graph))
    assert main(["validate", str(path)]) == 0
    assert main(["run", str(path), "--source", f"cam={folder}", "--out", str(tmp_path / "out")]) == 0
    assert '{"total_cycles": 3, "accepted_cycles": 2}' in capsys.readouterr().out
    (session,) = (tmp_path / "out").glob("kept-*")
    assert main(["inspect", str(session)]) == 0 and "sim-cam-1\t2" in capsys.readouterr().out
    path.write_text('{"nodes": [{"id": "x", "primitive": "loop", "config": {"mode": "odd"}}]}')
    assert main(["validate", str(path)]) == 1 and "loop-invalid-mode" in capsys.readouterr().out
    assert main(["modules"]) == 0 and main(["schemas"]) == 0


def png(pixels, color, filters):
    """A PNG of (height, width, channels) bytes, its rows filtered as told."""
    height, width, n = pixels.shape
    rows, before = [], np.zeros(width * n, int)
    for y in range(height):
        row = pixels[y].reshape(-1).astype(int)
        left = np.concatenate([np.zeros(n, int), row[:-n]]) if width > 1 else np.zeros(n, int)
        corner = np.concatenate([np.zeros(n, int), before[:-n]]) if width > 1 else np.zeros(n, int)
        far = [np.abs(left + before - corner - x) for x in (left, before, corner)]
        paeth = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], before, corner))
        guess = [0, left, before, (left + before) // 2, paeth][filters[y]]
        rows.append(bytes([filters[y]]) + ((row - guess) % 256).astype(np.uint8).tobytes())
        before = row

    def part(name, body):
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    head = struct.pack(">IIBBBBB", width, height, 8, color, 0, 0, 0)
    data = zlib.compress(b"".join(rows))
    return images.PNG + part(b"IHDR", head) + part(b"IDAT", data[:5]) + part(b"tEXt", b"x") + part(b"IDAT", data[5:]) + part(b"IEND", b"")


def test_png_means():
    rng = np.random.default_rng(3)
    for color, n in ((0, 1), (4, 2), (2, 3), (6, 4)):
        pixels = rng.integers(0, 256, (7, 5, n))
        want = pixels[..., 0].mean() if n < 3 else (pixels[..., 0] * 0.299 + pixels[..., 1] * 0.587 + pixels[..., 2] * 0.114).mean()
        data = png(pixels, color, [0, 1, 2, 3, 4, 4, 3])
        assert abs(images.png_gray_mean(data) - want) < 1e-9
        assert images.png_gray_mean(data[:-15]) is None and images.png_gray_mean(data.replace(b"tEXtx", b"tEXty")) is None
    assert images.png_gray_mean(b"") is None and images.png_gray_mean(images.PNG) is None


def test_a_folder_s_pictures_are_decoded_by_spark(spark, tmp_path):
    image = spark._jvm.java.awt.image.BufferedImage(8, 8, 1)
    for x in range(8):
        for y in range(8):
            image.setRGB(x, y, 0x646464)
    for kind in ("jpg", "png", "bmp"):
        spark._jvm.javax.imageio.ImageIO.write(image, kind, spark._jvm.java.io.File(str(tmp_path / f"a.{kind}")))
    (tmp_path / "b.jpg").write_bytes(b"broken")
    got = {r.source_path.rsplit("/", 1)[1]: r.decoded_mean for r in images.folder_means(spark, str(tmp_path)).collect()}
    assert got.pop("b.jpg") is None and sorted(got) == ["a.bmp", "a.jpg", "a.png"]
    assert all(abs(x - 100) < 1 for x in got.values())
    assert abs(images.png_gray_mean((tmp_path / "a.png").read_bytes()) - 100) < 1e-9


def test_numbering_keeps_rows_without_an_id(spark):
    rows = [(None, "x"), (None, "y"), (1 << 62, "c"), (-5, "a"), (3, "b"), (3, "b2")]
    got = sources.ordinal(spark.createDataFrame(rows, "id long, name string"), "id", "nth").collect()
    assert sorted(r.nth for r in got) == list(range(6))
    first = {r.name: r.nth for r in got}
    assert first["a"] == 0 and {first["b"], first["b2"]} == {1, 2} and first["c"] == 3
    sparse = spark.range(0, 3000).selectExpr("id * 1000003 AS id")
    numbered = sources.ordinal(sparse, "id", "nth", block=64)
    assert numbered.where("nth * 1000003 <> id").count() == 0
    assert sources.ordinal(sparse.limit(0), "id", "nth").count() == 0
