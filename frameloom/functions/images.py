"""Grayscale mean of pictures: bitmaps, PNG, what Spark decodes, raw gray bytes."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameloom.functions.payloads import mean_byte

#: Weights of blue, green and red in gray.
GRAY = np.array([0.114, 0.587, 0.299])


def bitmap_gray_mean(data: bytes) -> float | None:
    """Mean gray of an uncompressed 8, 24 or 32 bit bitmap; None if it is not one."""
    try:
        if data[:2] != b"BM":
            return None
        start, _, width, height, _, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
        if packing not in (0, 3) or bits not in (8, 24, 32) or width <= 0 or height == 0:
            return None
        n, row = bits // 8, (width * bits // 8 + 3) // 4 * 4
        pixels = np.frombuffer(data, np.uint8, row * abs(height), start).reshape(abs(height), row)
        pixels = pixels[:, : width * n].reshape(abs(height), width, n)
        if n == 1:
            palette = np.frombuffer(data, np.uint8, start - 54, 54)[: (start - 54) // 4 * 4].reshape(-1, 4)
            return float((palette[:, :3] @ GRAY)[pixels[..., 0]].mean()) if len(palette) else float(pixels.mean())
        return float((pixels[..., :3] @ GRAY).mean())
    except (struct.error, ValueError, IndexError):
        return None


#: Fixed values of PNG: its signature, and channels by color type.
PNG = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    """Rows of a PNG, each after its filter byte, as pixel bytes."""
    kinds, rows = raw[:, 0], raw[:, 1:].astype(np.int64)
    above = np.zeros(rows.shape[1], np.int64)
    for y, kind in enumerate(kinds):
        row = rows[y]
        if kind == 1:
            row = np.cumsum(row.reshape(-1, step), axis=0).reshape(-1) & 255
        elif kind == 2:
            row = (row + above) & 255
        elif kind in (3, 4):
            left, corner = np.zeros(step, np.int64), np.zeros(step, np.int64)
            up, out = above.reshape(-1, step), row.reshape(-1, step).copy()
            for x in range(len(out)):
                if kind == 3:
                    guess = (left + up[x]) // 2
                else:
                    far = np.abs(np.stack([up[x] - corner, left - corner, left + up[x] - 2 * corner]))
                    guess = np.choose(far.argmin(axis=0), [left, up[x], corner])
                out[x] = (out[x] + guess) & 255
                left, corner = out[x], up[x]
            row = out.reshape(-1)
        elif kind != 0:
            raise ValueError("no such filter")
        rows[y] = above = row
    return rows


def png_gray_mean(data: bytes) -> float | None:
    """Mean gray of a PNG of 8 bits a channel, not interlaced; else None."""
    try:
        if data[:8] != PNG:
            return None
        at, body, palette, head = 8, [], None, None
        while True:
            size, name = struct.unpack_from(">I4s", data, at)
            part = data[at + 8 : at + 8 + size]
            if len(part) < size or zlib.crc32(name + part) != struct.unpack_from(">I", data, at + 8 + size)[0]:
                return None
            if name == b"IHDR":
                head = struct.unpack(">IIBBBBB", part)
            elif name == b"PLTE":
                palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
            elif name == b"IDAT":
                body.append(part)
            elif name == b"IEND":
                break
            at += 12 + size
        width, height, depth, color, _, _, interlaced = head
        n = CHANNELS[color]
        if depth != 8 or interlaced:
            return None
        raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, 1 + width * n)
        pixels = _unfiltered(raw, n).reshape(height, width, n)
        if color == 3:
            pixels = palette[pixels[..., 0]]
        if pixels.shape[2] < 3:
            return float(pixels[..., 0].mean())
        return float((pixels[..., :3] @ GRAY[::-1]).mean())
    except (struct.error, ValueError, IndexError, KeyError, TypeError, zlib.error):
        return None


def draw_bitmap(level: int, side: int = 2) -> bytes:
    """A 24 bit bitmap of one gray level."""
    row = bytes([level] * 3 * side).ljust((3 * side + 3) // 4 * 4, b"\0")
    head = struct.pack("<IiiHHIIiiII", 40, side, side, 1, 24, 0, len(row) * side, 0, 0, 0, 0)
    return b"BM" + struct.pack("<IHHI", 54 + len(row) * side, 0, 0, 54) + head + row * side


def draw_png(level: int, side: int = 2) -> bytes:
    """A gray PNG of one level, each row filtered by the one above."""
    rows = bytes([0] + [level] * side) + bytes([2] + [0] * side) * (side - 1)

    def part(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    head = struct.pack(">IIBBBBB", side, side, 8, 0, 0, 0, 0)
    return PNG + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


@F.arrow_udf(T.BinaryType())
def drawn(level: pa.Array, kind: pa.Array) -> pa.Array:
    """Pictures of one gray level, as the content type asks."""
    draw = {"image/bmp": draw_bitmap, "image/png": draw_png}
    return pa.array([draw[k](n) for n, k in zip(level.to_pylist(), kind.to_pylist())], pa.binary())


@F.arrow_udf(T.DoubleType())
def _picture_means(payload: pa.Array) -> pa.Array:
    means = []
    for x in payload:
        data = x.as_py()
        means.append(None if data is None else bitmap_gray_mean(data) if data[:2] == b"BM" else png_gray_mean(data))
    return pa.array(means, pa.float64())


@F.arrow_udf(T.DoubleType())
def _blue_green_red_mean(data: pa.Array, channels: pa.Array) -> pa.Array:
    means = []
    for x, n in zip(data, channels.to_pylist()):
        pixels = np.frombuffer(x.as_py() or b"", np.uint8)
        if not n or not len(pixels):
            means.append(None)
        else:
            pixels = pixels.reshape(-1, n)
            means.append(float((pixels[:, :3] @ GRAY).mean() if n >= 3 else pixels[:, 0].mean()))
    return pa.array(means, pa.float64())


def folder_means(spark: SparkSession, folder: str) -> DataFrame:
    """(source_path, decoded_mean) of the files of a folder, as Spark's image
    source decodes them in the JVM (JPEG, PNG, GIF, bitmaps); null where it can't.

    To be joined with the frames of that folder, whose payloads are the files.
    """
    image = spark.read.format("image").load(folder).select("image.*")
    mean = F.when(F.col("height") > 0, _blue_green_red_mean("data", "nChannels"))
    return image.select(F.col("origin").alias("source_path"), mean.alias("decoded_mean"))


def decoded_mean(frame: Column) -> Column:
    """Mean gray of a frame: pictures are decoded (null where that fails), any
    other payload is taken as gray bytes already."""
    payload, kind = frame.getField("payload"), F.lower(frame.getField("content_type"))
    picture = F.when(kind.startswith("image/"), payload)
    raw = F.when(~kind.startswith("image/"), payload)
    return F.coalesce(_picture_means(picture), mean_byte(raw))
