"""Words and hashes of whole Arrow batches of texts, computed with numpy.

Texts stay one flat buffer of UTF-8 bytes with offsets, as Arrow holds them,
so no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: An odd base: powers of it have inverses modulo 2**64.
BASE = 0x9E3779B97F4A7C15
#: Bytes of text that are hashed at once, so that tables stay small.
BLOCK = 1 << 20

_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of tokens made of ASCII letters, digits and anything beyond ASCII.
_joined = np.zeros(256, bool)
_joined[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[0x41:0x5B] += 0x20
_powers = _inverses = np.ones(1, U64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, ends, data = column.buffers()
    offs = np.frombuffer(ends, np.int64, len(column) + 1, column.offset * 8)
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), offs - offs[0]
    return np.frombuffer(data, np.uint8, offs[-1] - offs[0], offs[0]), offs - offs[0]


def blocks(offs: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about ``size`` bytes; a long one stands alone."""
    first, n = 0, len(offs) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + size, "right")) - 1)
        yield first, last
        first = last


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased; no other byte changes."""
    return _lower[data]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2**64."""
    global _powers, _inverses
    if len(_powers) < n:
        for name, b in (("_powers", BASE), ("_inverses", pow(BASE, -1, 1 << 64))):
            step = np.full(max(n, BLOCK + 1), b, U64)
            step[0] = 1
            globals()[name] = np.cumprod(step, dtype=U64)
    return _powers[:n], _inverses[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = the polynomial hash of data[i:j] times BASE**i."""
    p, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * p[:-1], dtype=U64, out=out[1:])
    return out


def word_spans(
    data: np.ndarray, offs: np.ndarray, letters_only: bool = False
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, word offsets of documents) for words between white space,
    or between white space and ASCII punctuation."""
    solid = _joined[data] if letters_only else ~_space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs[:-1]] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | edge[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    s = np.flatnonzero(starts)
    return s, np.flatnonzero(ends) + 1, np.searchsorted(s, offs)


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word data[s:e]."""
    p = prefix_hashes(data)
    _, inv = powers(len(data) + 1)
    return mix((p[e] - p[s]) * inv[s] + (e - s).astype(U64))


def shingle_hashes(w: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each document's windows of k words, in order.

    A document with fewer words, but any, has its whole sequence as one window.
    """
    n = np.diff(offs)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_offs = np.concatenate([[0], np.cumsum(count)])
    factor = mix(np.arange(1, k + 1, dtype=U64)) | U64(1)
    padded = np.concatenate([w, np.zeros(k, U64)])
    at = np.repeat(offs[:-1] - out_offs[:-1], count) + np.arange(out_offs[-1])
    length = np.repeat(np.minimum(n, k), count)
    h = length.astype(U64) * U64(BASE)
    for j in range(k):
        h += np.where(j < length, padded[at + j] * factor[j], U64(0))
    return mix(h), out_offs
