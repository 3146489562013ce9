"""Vectorised text kernels shared by the training-data operators.

Spark hands a task Arrow batches; these functions work on the bytes of a whole batch at once with
numpy, so no Python code runs per word.  Texts are UTF-8 bytes laid end to end in ``buf``; document
``i`` is ``buf[offs[i]:offs[i + 1]]``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text worked on at once; bounds the temporaries of a Python worker.
SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, U64), np.ones(1, U64)]

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Byte classes of the splitters: 0 white space, 1 letter, 2 digit, 3 other, 4 needs the library's own splitter.
CLASS = np.full(256, 4, np.uint8)
CLASS[33:127] = 3
CLASS[48:58] = 2
CLASS[65:91] = CLASS[97:123] = 1
CLASS[[9, 10, 11, 12, 13, 32]] = 0
CLASS[39] = 4  # an apostrophe may start a contraction


def batch_text(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes; a longer document stands alone."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base modulo 2**64, and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, U64)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=U64)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole word."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    c = np.zeros(len(buf) + 1, U64)
    np.cumsum((buf.astype(U64) + U64(1)) * powers(len(buf) + 1)[0][: len(buf)], out=c[1:])
    return c


#: Spans of more bytes than this are hashed by BLAKE2.
LONG_SPAN = 256
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
_STEP = U64(0xD6E8FEB86659FD93)


def eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on (and at the end) as one little-endian number, zeros beyond the end."""
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    return np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))


def lead(w: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """First bytes, eight at most, of spans of ``n`` bytes; ``w``: the text's ``eights``."""
    return w[starts] & _LOW_BYTES[np.minimum(n, 8)]


def tail(w: np.ndarray, ends: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Last eight bytes of spans longer than eight, else 0.  With the length, lead and tail are all of a span of at most 16."""
    return np.where(n > 8, w[np.maximum(ends - 8, 0)], U64(0))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every span, a function of the span's bytes alone: eight bytes at a time, with a full mix after each."""
    w, n = eights(buf), ends - starts
    h = mix((lead(w, starts, n) + U64(1)) * U64(_BASE) + n.astype(U64) * _STEP)
    more, at = np.flatnonzero((n > 8) & (n <= LONG_SPAN)), 8
    while len(more):
        h[more] = mix((h[more] ^ lead(w, starts[more] + at, n[more] - at)) * _STEP + U64(at))
        more, at = more[n[more] > at + 8], at + 8
    for i in np.flatnonzero(n > LONG_SPAN):
        h[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


_SECOND = 0xC2B2AE3D27D4EB4F
_second: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def window_hashes(buf: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes, by different bases, of spans of one width in ascending order. The width should be below 1,000 bytes
    (longer words over few letters can agree modulo a power of two, whatever the base)."""
    if len(buf) > 2 * SLICE_BYTES:  # a long document, in parts
        cut = np.searchsorted(starts, np.arange(0, len(buf) + SLICE_BYTES, SLICE_BYTES))
        parts = [window_hashes(buf[k * SLICE_BYTES : (k + 1) * SLICE_BYTES + width], starts[a:b] - k * SLICE_BYTES, width) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, U64), np.zeros(0, U64))
    out, n = [], len(buf)
    text = buf.astype(U64) + U64(1)
    if len(_second[0]) < n + 1:
        size = max(n + 1, SLICE_BYTES + 1)
        for i, base in enumerate((_SECOND, pow(_SECOND, -1, 1 << 64))):
            _second[i] = np.cumprod(np.concatenate((np.ones(1, U64), np.full(size - 1, base, U64))), dtype=U64)
    for up, down in (powers(n + 1), _second):
        c = np.zeros(n + 1, U64)
        np.cumsum(text * up[:n], out=c[1:])
        out.append(mix((c[starts + width] - c[starts]) * down[starts]))
    return out[0], out[1]


def same_bytes(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether spans of ``n`` bytes (one at least) of two texts are equal."""
    if len(n) == 0:
        return np.zeros(0, bool)
    begin = np.cumsum(n) - n
    at = np.arange(int(n.sum())) - np.repeat(begin, n)
    return np.logical_and.reduceat(a[np.repeat(a_at, n) + at] == b[np.repeat(b_at, n) + at], begin)


def doc_starts(buf_len: int, offs: np.ndarray) -> np.ndarray:
    first = np.zeros(buf_len + 1, bool)
    first[offs] = True
    return first


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs without ASCII white space, and for each document the index of its first word."""
    if len(buf) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    solid = ~IS_SPACE[buf]
    first = doc_starts(len(buf), offs)
    left = solid.copy()
    left[1:] &= ~solid[:-1] | first[1:-1]
    right = solid.copy()
    right[:-1] &= ~solid[1:] | first[1:-1]
    starts = np.flatnonzero(left)
    return starts, np.flatnonzero(right) + 1, np.searchsorted(starts, offs)


def byte_classes(buf: np.ndarray) -> np.ndarray:
    """Classes of the bytes; two-byte Latin letters (lead byte C3) count as letters."""
    c = CLASS[buf]
    lead = np.flatnonzero(buf == 0xC3)
    lead = lead[lead + 1 < len(buf)]
    tail = buf[lead + 1]
    lead = lead[(tail >= 0x80) & (tail != 0x97) & (tail != 0xB7)]
    c[lead] = c[lead + 1] = 1
    angle = np.flatnonzero(buf[:-1] == 0x3C)
    c[angle[buf[angle + 1] == 0x7C]] = 4  # "<|" may open a special token
    return c


def doc_any(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[offs[1:]] > total[offs[:-1]]


def split_spaced(buf: np.ndarray, c: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pre-tokens that tile the text: a run of one class, with one blank before it; all but the last of several white spaces stand alone."""
    n = len(buf)
    first = doc_starts(n, offs)[:n]
    prev = np.concatenate(([9], c[:-1])).astype(np.uint8)
    run = (c != prev) | first
    solid = run & (c != 0)
    cut = run.copy()
    after = np.flatnonzero(solid & ~first & (prev == 0))
    cut[after - 1] = True
    cut[after[buf[after - 1] == 32]] = False
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], n)


def split_dropped(buf: np.ndarray, c: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pre-tokens without white space: letter runs, single digits, runs of other signs."""
    n = len(buf)
    first = doc_starts(n, offs)[:n]
    prev = np.concatenate(([9], c[:-1])).astype(np.uint8)
    run = (c != prev) | first | (c == 2)
    starts = np.flatnonzero(run)
    ends = np.append(starts[1:], n)
    keep = c[starts] != 0
    return starts[keep], ends[keep]


def split_pieces(buf: np.ndarray, c: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pre-tokens that tile the text: each starts at a document's start, a run of blanks or a line feed."""
    n = len(buf)
    first = doc_starts(n, offs)[:n]
    blank = buf == 32
    cut = blank.copy()
    cut[1:] &= ~blank[:-1]
    cut |= (buf == 10) | first
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], n)
