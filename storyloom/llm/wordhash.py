"""Word hashes of whole Arrow text columns, without a Python object per word.

A word is a run of bytes other than ASCII white space, after lower-casing A-Z:
``[^\\x20\\x09-\\x0D]+``.  UTF-8 bytes above 0x7F never count as white space, so working on
bytes gives the same words as working on characters.  A word's hash is the polynomial
``sum(T[b_i] * P**i)`` modulo 2**64, from differences of one running sum over the buffer, then
mixed.  It does not depend on where the word stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]
#: Bytes of text handled at once; a longer text is handled alone.
CHUNK = 1 << 19


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK + (CHUNK >> 2))
        for k, base in enumerate((_P, _P_INV)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the MurmurHash3 finaliser, public domain)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def text_chunks(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets): the UTF-8 bytes of runs of rows; a null is empty."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    row0 = 0
    for part in parts:
        if len(part) == 0:
            continue
        part = part.cast(pa.large_string())
        _, offs, data = part.buffers()
        offsets = np.frombuffer(offs, np.int64)[part.offset : part.offset + len(part) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        at = 0
        while at < len(part):
            end = int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1
            end = min(max(end, at + 1), len(part))
            lo, hi = offsets[at], offsets[end]
            yield row0 + at, row0 + end, raw[lo:hi], offsets[at : end + 1] - lo
            at = end
        row0 += len(part)


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and the end): byte positions of the words."""
    n = len(raw)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True  # a text's start
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets, side="left")


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each span of bytes, A-Z read as a-z."""
    if len(starts) == 0:
        return np.zeros(0, U64)
    up, down = _power_tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, U64)
    np.cumsum(_BYTE_LOWER[raw] * up[: len(raw)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts])


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, first word of each text and the end)."""
    starts, ends, first = words_of(raw, offsets)
    return hash_spans(raw, starts, ends), first


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position; shorter by n - 1 than the input."""
    if len(words) < n:
        return np.zeros(0, U64)
    out = np.zeros(len(words) - n + 1, U64)
    for k in range(n):
        out = mix64(out * U64(0x9FB21C651E98DF25) + words[k : len(words) - n + 1 + k] + U64(k + 1))
    return out


def doc_of(first: np.ndarray) -> np.ndarray:
    """The index of the text that each word belongs to."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def list_array(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """An Arrow list column from flat values."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
