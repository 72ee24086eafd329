"""Vectorised text work on Arrow buffers: words, shingles and lines as 64-bit hashes, without Python strings.

A word is a maximal run of ASCII letters, digits and non-ASCII characters. Hashes are polynomials modulo 2**64
over randomised byte values, taken from prefix sums and then mixed, so that every span costs O(1).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
BYTE = np.random.default_rng(20_011).integers(1, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
SLICE_BYTES = 1 << 18
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: U, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for later calls."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + 1), base, U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if len(have) <= SLICE_BYTES + 1:  # longer ones, of single long texts, are not kept
            _powers[int(base)] = have
    return have[:n]


def flat(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after another, and len+1 offsets; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.utf8_lower(texts)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def parts(texts: pa.Array, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about SLICE_BYTES, so that temporaries stay small and a batch is never copied as a whole: first row, end row,
    bytes, offsets."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_BYTES, "right")) - 1)
        yield at, end, *flat(texts.slice(at, end - at), lower)
        at = end


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function over batches; when a task ends, the worker, which is kept for later tasks, gives freed memory back."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def give_back() -> None:
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def spans(flags: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True, none of which crosses an offset."""
    if not len(flags):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = flags.copy()
    begin[1:] &= ~flags[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < len(flags)]
    begin[cut] = flags[cut]
    close = flags.copy()
    close[:-1] &= ~flags[1:]
    cut = cut[cut > 0] - 1
    close[cut] = flags[cut]
    return np.flatnonzero(begin), np.flatnonzero(close) + 1


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span; values are 64-bit already."""
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(BASE, len(values)), out=sums[1:])
    got = (sums[ends] - sums[starts]) * powers(INVERSE, len(values) + 1)[starts]
    return mix(got + (ends - starts).astype(U))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the offsets of each row's words among them."""
    starts, ends = spans(WORD[data], offsets)
    return span_hashes(BYTE[data], starts, ends), np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """For each row the hashes of its runs of `width` words, in order; a shorter row has one shingle of all its words."""
    n = len(hashes)
    runs = np.zeros(max(0, n - width + 1), U)
    for k in range(width if len(runs) else 0):
        runs += hashes[k : n - width + 1 + k] * powers(BASE, width + 1)[k + 1]
    runs = mix(runs)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(runs[a : b - width + 1])
        elif b > a:
            out.append(mix((hashes[a:b] * powers(BASE, width + 1)[1 : b - a + 1]).sum(keepdims=True) + U(b - a)))
        else:
            out.append(runs[:0])
    return out
