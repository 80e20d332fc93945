"""Whole texts as flat byte arrays: helpers for the operators that run in Arrow batches.

A batch of documents becomes one ``uint8`` array plus offsets, so words, windows and
hashes are found with a handful of array operations per batch rather than per word.
Batches are cut by bytes (``TASK_BYTES``), never by rows of a text: a text longer than
the bound is a batch of its own and is still processed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once in a Python worker (a single longer text is taken whole).
TASK_BYTES = 4 << 20

_U = np.uint64
_R = _U(0x9E3779B97F4A7C15 | 1)

SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[ord("A"): ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: Bytes whose places are mixed at once.
_MIX_BYTES = 1 << 16
_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _R)


def slices(batches: Iterator[pa.RecordBatch], text_col: str, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one holds at most ``most`` bytes of text (or one text)."""
    most = most or TASK_BYTES
    for b in batches:
        if not b.num_rows:
            continue
        _, off = flat(b.column(b.schema.get_field_index(text_col)))
        lo = 0
        while lo < b.num_rows:
            hi = int(np.searchsorted(off, off[lo] + most, side="right")) - 1
            hi = min(max(hi, lo + 1), b.num_rows)
            yield b.slice(lo, hi - lo)
            lo = hi


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if off is None or not len(col):
        return np.empty(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    o = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset: col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[o[0]: o[-1]] if data is not None else np.empty(0, np.uint8)
    return buf, o - o[0]


def ids(col: pa.Array) -> np.ndarray:
    """Integer ids of a column without nulls."""
    return col.cast(pa.int64()).to_numpy(zero_copy_only=False)


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document index of every word ``[^\\x20\\x09-\\x0D]+``."""
    if not len(buf):
        z = np.empty(0, np.int64)
        return z, z, z
    space = SPACES[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    before = np.empty(len(buf), bool)
    before[0], before[1:] = True, space[:-1]
    after = np.empty(len(buf), bool)
    after[-1], after[:-1] = True, space[1:]
    starts = np.flatnonzero(~space & (before | edge[:-1]))
    ends = np.flatnonzero(~space & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of each byte span (spans in order, none overlapping).

    The sum of a mixed number for every (byte, place in the span): unlike a polynomial modulo
    2^64 it has no texts that always collide (a Thue-Morse word and its complement do there).
    Cost is per byte, not per span; the mixing runs over blocks that stay in the cache."""
    if not len(starts):
        return np.empty(0, np.uint64)
    value = _BYTE_VALUES[_ASCII_LOWER] if lower else _BYTE_VALUES
    total = np.zeros(len(buf) + 1, np.uint64)
    for lo in range(0, len(buf), _MIX_BYTES):
        hi = min(lo + _MIX_BYTES, len(buf))
        a, b = np.searchsorted(starts, (lo, hi), side="right")
        first = starts[max(a - 1, 0): max(b, 1)]  # spans that may reach into [lo, hi)
        own = np.repeat(first, np.diff(np.concatenate([[lo], np.maximum(first[1:], lo), [hi]])))
        place = (np.arange(lo, hi) - own).astype(np.uint64)  # before the first span: never summed
        total[lo + 1: hi + 1] = mix(value[buf[lo:hi]] ^ place * _R)
    np.cumsum(total, out=total)
    return mix((total[ends] - total[starts]) + (ends - starts).astype(np.uint64) * _R)


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive hashes (``len(h) - n + 1`` of them)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.full(m, _U(n), np.uint64)
    for k in range(n):
        out = out * _R + h[k: k + m]
        out ^= out >> _U(29)
    return mix(out)


def code_points(buf: np.ndarray) -> np.ndarray:
    """1 at every byte that starts a UTF-8 code point."""
    return (buf & 0xC0) != 0x80


def counts(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` in each document."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]
