"""Vectorised work on the UTF-8 bytes of a batch of texts (numpy, inside tasks).

A batch is one byte array plus the offsets of its texts, taken from Arrow
without copying. Words and pieces are spans of that array, hashed all at once:
``chunk_hash`` chains their 8-byte chunks through a bijective mix, whatever
their bytes. ``prefix_hash`` and ``span_hash`` (a polynomial modulo 2**64) are
for short sliding windows only: they collide on some long periodic strings.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import xxhash

#: Odd multipliers of the polynomial; a second one gives an independent hash.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, np.ndarray] = {}

#: [\x20\x09-\x0D]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
#: Bytes of a span that are mixed 8 at a time; longer spans go to xxh3 one by one.
CHAINED = 64
_KEPT_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def tidy(run):
    """``run`` for mapInArrow, after which the worker, which is kept for later
    tasks, hands the memory it has freed back to the machine."""
    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):   # another C library
            pass

    return wrapped


def column_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset:col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def slices(offsets: np.ndarray, size: int = 8 << 20):
    """Runs (i, j) of whole texts of about ``size`` bytes; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit over all 64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64, kept for the next batch."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        p = np.full(max(n, 1 << 20), base, np.uint64)
        p[0] = 1
        _POWERS[base] = np.multiply.accumulate(p)
    return _POWERS[base]


def prefix_hash(buf: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix sums of the polynomial: element i covers buf[:i]."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _powers(BASES[which], len(buf))[:len(buf)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hash of every span; equal bytes have equal hashes wherever they stand."""
    inverse = _powers(pow(BASES[which], -1, 1 << 64), len(prefix))
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def chunk_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every span; equal bytes have equal hashes wherever they
    stand. Spans of one length up to 8 bytes never share a hash."""
    wide = np.ndarray(len(buf) + 1, "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,))
    size = ends - starts
    h = mix(size.astype(np.uint64) * np.uint64(BASES[0]))
    here = np.flatnonzero((size > 0) & (size <= CHAINED))
    for at in range(0, CHAINED, 8):
        left = size[here] - at
        h[here] = mix(h[here] ^ (wide[starts[here] + at] & _KEPT_BYTES[np.minimum(left, 8)]))
        here = here[left > 8]
        if not len(here):
            break
    for i in np.flatnonzero(size > CHAINED).tolist():
        h[i] = xxhash.xxh3_64_intdigest(buf[starts[i]:ends[i]])
    return h


def words(buf: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words, runs of bytes that are not ``apart``
    (by default [^\\x20\\x09-\\x0D]+); none crosses a text."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~apart[buf]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | first[1:n]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | first[1:n]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def counts_per_text(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the ascending ``starts`` lie in each text."""
    return np.diff(np.searchsorted(starts, offsets))
