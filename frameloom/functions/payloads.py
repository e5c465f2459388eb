"""Bytes of payloads, and the descriptor of typed payloads.

The byte functions are Arrow UDFs over whole batches: they read the flat buffer
of a binary column and never make a Python object for a row.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of payload descriptors: element types in code order with their
#: sizes, media types, the largest rank.
ELEMENT_TYPES = ("u8", "i8", "u16", "i16", "u32", "i32", "u64", "i64", "f16", "bf16", "f32", "f64")
ELEMENT_SIZES = (1, 1, 2, 2, 4, 4, 8, 8, 2, 2, 4, 8)
MEDIA_TYPES = ("blob", "tensor", "image", "json")
MAX_RANK = 8
#: Bytes that are summed at once, as numpy widens each of them to eight.
AT_ONCE = 1 << 18
#: How a packed header begins.
MAGIC = b"FLP1"


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values, those under a null too, and where each begins."""
    column = column.cast(pa.large_binary())
    _, ends, data = column.buffers()
    offs = np.frombuffer(ends, np.int64, len(column) + 1, column.offset * 8)
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), offs - offs[0]
    return np.frombuffer(data, np.uint8, offs[-1] - offs[0], offs[0]), offs - offs[0]


def _sums(payload: pa.Array) -> np.ndarray:
    """Exact sum of the bytes of each value; null has 0. Values are summed in
    parts of ``AT_ONCE`` bytes, so memory grows neither with them nor with a batch."""
    data, offs = _flat(payload)
    sums = np.zeros(len(offs) - 1, np.int64)
    for at in range(0, len(data), AT_ONCE):
        part = data[at : at + AT_ONCE]
        own = slice(np.searchsorted(offs, at, "right") - 1, np.searchsorted(offs, at + len(part), "left"))
        begins = np.maximum(offs[own] - at, 0)
        filled = np.minimum(offs[1:][own] - at, len(part)) > begins
        sums[own][filled] += np.add.reduceat(part, begins[filled], dtype=np.int64)
    if payload.null_count:
        sums[payload.is_null().to_numpy(zero_copy_only=False)] = 0
    return sums


@F.arrow_udf(T.LongType())
def byte_sum(payload: pa.Array) -> pa.Array:
    return pa.array(_sums(payload))


@F.arrow_udf(T.BinaryType())
def inverted(payload: pa.Array) -> pa.Array:
    """Every byte b becomes 255 - b; null stays null."""
    data, offs = _flat(payload)
    buffers = [None, pa.py_buffer(np.ascontiguousarray(offs)), pa.py_buffer(255 - data)]
    out = pa.Array.from_buffers(pa.large_binary(), len(payload), buffers).cast(pa.binary())
    if payload.null_count:
        import pyarrow.compute as pc

        out = pc.if_else(payload.is_valid(), out, None)
    return out


def mean_byte(payload: Column) -> Column:
    """Mean of the bytes as sum / length; an empty payload has 0, null has null."""
    n = F.octet_length(payload)
    return F.when(n == 0, F.lit(0.0)).when(n > 0, byte_sum(payload) / n)


def element_size(element_type: Column) -> Column:
    pairs = [F.lit(x) for pair in zip(ELEMENT_TYPES, ELEMENT_SIZES) for x in pair]
    return F.try_element_at(F.create_map(*pairs), element_type)


def payload_length(shape: Column, element_type: Column) -> Column:
    """Product of the shape times the element size; rank 0 is one element."""
    return F.aggregate(shape, F.lit(1).cast("long"), lambda n, d: n * d) * element_size(element_type)


def strides(shape: Column, element_type: Column) -> Column:
    """Row-major strides in bytes."""
    size = element_size(element_type).cast("long")
    return F.transform(
        shape,
        lambda _, i: F.aggregate(F.slice(shape, i + 2, F.size(shape)), size, lambda n, d: n * d),
    )


def pack_header(media: str, element: str, shape: list[int], epoch: int) -> bytes:
    """A header of 192 bytes, little endian: magic, version, codes, rank, epoch,
    length, then the dimensions and strides."""
    if media not in MEDIA_TYPES or element not in ELEMENT_TYPES:
        raise ValueError(f"unknown media or element type: {media}, {element}")
    if len(shape) > MAX_RANK or any(d < 0 for d in shape):
        raise ValueError(f"shape {shape} has rank over {MAX_RANK} or a negative dimension")
    size = ELEMENT_SIZES[ELEMENT_TYPES.index(element)]
    steps, step = [], size
    for d in reversed(shape):
        steps.insert(0, step)
        step *= d
    pad = [0] * (MAX_RANK - len(shape))
    head = struct.pack(
        "<4sHBBIIqq", MAGIC, 1, MEDIA_TYPES.index(media), ELEMENT_TYPES.index(element), len(shape), 0, epoch, step
    )
    return (head + struct.pack("<16q", *shape, *pad, *steps, *pad)).ljust(192, b"\0")


def unpack_header(header: bytes) -> dict | None:
    """The fields of a header, or None if it is not a valid one."""
    if len(header) < 192 or header[:4] != MAGIC:
        return None
    _, version, media, element, rank, _, epoch, length = struct.unpack_from("<4sHBBIIqq", header)
    if version != 1 or media >= len(MEDIA_TYPES) or element >= len(ELEMENT_TYPES) or rank > MAX_RANK:
        return None
    numbers = struct.unpack_from("<16q", header, 32)
    shape = list(numbers[:rank])
    size = ELEMENT_SIZES[element]
    if any(d < 0 for d in shape) or int(np.prod(shape, dtype=object)) * size != length:
        return None
    return {
        "media_type": MEDIA_TYPES[media],
        "element_type": ELEMENT_TYPES[element],
        "shape": shape,
        "strides": list(numbers[8 : 8 + rank]),
        "epoch": epoch,
        "payload_length": length,
    }
