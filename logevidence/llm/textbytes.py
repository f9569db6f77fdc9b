"""Vectorised work on the UTF-8 bytes of many texts at once (numpy inside Arrow tasks).

A chunk is one byte array with the offsets of its texts. Polynomial hashes are taken modulo 2^64 from
prefix sums of ``code(byte) * BASE**i``: the hash of any stretch is one subtraction and one product.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text forms a chunk of its own.
CHUNK_BYTES = 2 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit value over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A 64-bit code for each byte value.
CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2^64 for i < n at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        out = []
        for b in (_BASE, inverse):
            a = np.full(size, b, dtype=np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        _powers[:] = out
    return _powers[0], _powers[1]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of code(data[k]) * BASE**k for i <= k < j."""
    up, _ = powers(len(data) + 1)
    p = np.empty(len(data) + 1, dtype=np.uint64)
    p[0] = 0
    np.cumsum(CODES[data] * up[: len(data)], out=p[1:])
    return p


def stretch_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes start..end, equal wherever these bytes stand."""
    _, down = powers(len(p))
    return (p[end] - p[start]) * down[start]


def raw_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]], off - off[0]


def text_of(batch: pa.RecordBatch, text: str = "text") -> pa.Array:
    """The text column; where whole rows travel in one column ``row``, that of the row."""
    names = batch.schema.names
    return batch.column(names.index(text)) if text in names else pc.struct_field(batch.column(names.index("row")), text)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of at most ``limit`` bytes of text, or one row."""
    limit = limit or CHUNK_BYTES
    for batch in batches:
        _, off = raw_texts(text_of(batch, text))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(off, off[start] + limit, side="right")) - 1)
            yield batch.slice(start, end - start)
            start = end


@lru_cache(maxsize=None)
def _ascii_lower() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _ascii_lower()[data]


def lower_latin(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and for the capital letters of Latin-1."""
    out = lower_ascii(data)
    if len(out) > 1:
        capital = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)
        out[1:][capital] += 32
    return out


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the maximal runs of bytes that ``inside`` (256 flags) marks; runs never cross rows."""
    if not len(data):
        e = np.zeros(0, np.int64)
        return e, e, e
    member = inside[data]
    first = member.copy()
    first[1:] &= ~member[:-1]
    last = member.copy()
    last[:-1] &= ~member[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = member[edges]
    last[edges - 1] = member[edges - 1]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def _place_codes(seed: int) -> np.ndarray:
    """A random code for each of 64 places in a word and each byte value."""
    return mix(np.arange(1, 64 * 256 + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + mix(np.array([seed + 1], dtype=np.uint64)))


_codes: dict[int, np.ndarray] = {}


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of non-empty words: sums of a code for each byte at its place.

    Unlike polynomials modulo 2^64, for which patterned words of 1024 bytes collide, different words meet by chance alone.
    """
    if not len(start):
        return np.zeros(0, np.uint64)
    codes = _codes.setdefault(seed, _place_codes(seed)) if seed < 4 else _place_codes(seed)
    size = end - start
    head = np.cumsum(size) - size
    place = (np.arange(size.sum(), dtype=np.int64) - np.repeat(head, size)).astype(np.int32)
    value = codes[(place & 63) << 8 | data[np.repeat(start - head, size) + np.arange(len(place))]]
    far = np.flatnonzero(place >= 64)
    if len(far):
        value[far] = mix(value[far] ^ (place[far] >> 6).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return mix(np.add.reduceat(value, head) + size.astype(np.uint64))
