"""Vectorised kernels over the bytes of many texts at once.

A span is hashed in pieces of eight bytes: each piece is mixed under a key of its own place, the mixed pieces are
summed, and the sum is mixed with the length.  Mixing is not linear, so no pattern of symbols cancels out for all
texts as it would in a polynomial modulo a power of two.  ``k`` picks one of two independent sets of keys; both
together are a hash of 128 bits.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; being ASCII, both rules hold on UTF-8 bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_MULT = np.random.default_rng(20240229).integers(1, 1 << 63, 16, dtype=np.int64).astype(U) | U(1)
_SEED = (U(0x243F6A8885A308D3), U(0x13198A2E03707344))

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], U)  # masks of the first k bytes of eight


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column, nulls as empty, and the n + 1 offsets of the texts."""
    col = pc.fill_null(col, "").cast(pa.large_string())
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if n and col.buffers()[2] is not None and col.buffers()[2].size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros past the end."""
    padded = np.zeros(len(buf) + 16, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray((len(buf) + 9,), "<u8", padded, strides=(1,))


def pieces(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of spans longer than eight bytes: which they are, and start, length and number of their pieces after the first."""
    size = ends - starts
    long = np.flatnonzero(size > 8)
    more = (size[long] - 1) >> 3
    of = np.repeat(np.arange(len(long)), more)
    place = np.arange(len(of)) - np.repeat(np.cumsum(more) - more, more) + 1
    at = starts[long][of] + 8 * place
    return long, at, np.minimum(ends[long][of] - at, 8), place


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int = 0, fold: bool = True) -> np.ndarray:
    """Hash of each span buf[start:end], A-Z lower-cased if fold; k picks one of two independent sets of keys."""
    wide = eights(LOWER[buf] if fold else buf)
    size = ends - starts
    h = mix((wide[starts] & _FIRST[np.minimum(size, 8)]) ^ _SEED[k])
    long, at, left, place = pieces(starts, ends)
    if len(long):
        part = mix((wide[at] & _FIRST[left]) * _MULT[13 - k] ^ mix(place.astype(U) + _SEED[k]))
        first = np.flatnonzero(place == 1)
        h[long] += np.add.reduceat(part, first)
    return mix(h + size.astype(U) * _MULT[15 - k])


def same_bytes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> bool:
    """Whether each span has the very bytes of the span whose number stands in other."""
    size = ends - starts
    if (size != size[other]).any():
        return False
    wide = eights(buf)
    first = wide[starts] & _FIRST[np.minimum(size, 8)]
    if (first != first[other]).any():
        return False
    _, at, left, _ = pieces(starts, ends)
    shift = np.repeat((starts[other] - starts)[size > 8], ((size - 1) >> 3)[size > 8])
    return bool(((wide[at] & _FIRST[left]) == (wide[at + shift] & _FIRST[left])).all())


def word_spans(buf: np.ndarray, off: np.ndarray, apart: np.ndarray = SPACE, begin: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and the n + 1 offsets of the texts into them.

    apart: bytes between words; begin: places at which a word begins even if nothing stands before it.
    """
    inner = ~apart[buf]
    first = inner.copy()
    first[1:] &= ~inner[:-1]
    last = inner.copy()
    last[:-1] &= ~inner[1:]
    if begin is not None:
        first[begin] |= inner[begin]
        last[begin[begin > 0] - 1] |= inner[begin[begin > 0] - 1]
    cut = off[(off > 0) & (off < len(buf))]
    first[cut] |= inner[cut]
    last[cut - 1] |= inner[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def shingles(col: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, the n + 1 offsets of the texts into them, word counts.

    A text of fewer words than ``size`` has one shingle, its whole sequence; one without words has none.
    """
    buf, off = flat(col)
    starts, ends, at = word_spans(buf, off)
    w = span_hash(buf, starts, ends)
    n = np.diff(at)
    full = np.maximum(n - size + 1, (n > 0).astype(n.dtype))
    to = np.concatenate(([0], np.cumsum(full)))
    begin = np.repeat(at[:-1] - to[:-1], full) + np.arange(to[-1])
    count = np.minimum(np.repeat(n, full), size)
    padded = np.concatenate((w, np.zeros(size, U)))
    h = count.astype(U) * _MULT[14]
    for j in range(size):
        h += np.where(count > j, padded[begin + j] * _MULT[j], U(0))
    h = mix(h)
    for a, b in zip(to[:-1], to[1:]):
        if b - a > 1:
            h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = h[1:] != h[:-1]
    keep[to[:-1][full > 0]] = True
    return h[keep], np.concatenate(([0], np.cumsum(keep)))[to], n


def segment_sum(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of values[off[i]:off[i+1]] for each i, empty segments included."""
    sums = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=sums[1:])
    return sums[off[1:]] - sums[off[:-1]]


def code_points(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=sums[1:])
    return sums[ends] - sums[starts]


def strings(buf: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(np.ascontiguousarray(off, np.int64)), pa.py_buffer(np.ascontiguousarray(buf)))
