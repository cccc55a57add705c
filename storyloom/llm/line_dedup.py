"""Fuzzy line deduplication.

A line is what stands between line feeds.  Its normal form is its words (runs of ASCII letters and digits and of
characters above U+007F, A-Z lower-cased) joined by single spaces; a line without words is blank.

1. Each text gives, for each line that isn't blank, a 64-bit hash of the normal form, its length in characters and its SimHash:
   each word votes on each bit, short words with fewer votes, as they are common and say little.  Lines of one normal form are grouped at once, with partial aggregation, to their first occurrence.
2. The SimHash is cut into blocks; lines that agree in a whole block are candidates (pigeonhole: SimHashes that differ in fewer bits
   than there are blocks agree in one).  The width of a block follows the logarithm of the number of distinct lines, so buckets
   do not grow with it, and the number of blocks grows by ``BLOCK_GROWTH`` for each further bit, which holds recall.
3. Candidates whose lengths fit and whose SimHashes differ in at most ``distance`` of all bits are compared nearest first (``buckets``),
   and linked if the normal forms' edit similarity, ``1 - levenshtein / longer``, is ``similarity`` or more: over characters, or over
   words where a line has more than ``LONG`` characters.
4. Of each connected group the first occurrence (smallest doc_id, then hash of the text, then line number) is kept.  Kept lines are
   sent to their documents; removed ones, of which a common line may have very many, are not moved at all.

Rows: null text stays null, blank lines stay, a row of null doc_id stays whole and takes no part.  Rows repeated with one
doc_id and text are one document, and each such row keeps the same lines; different texts of one doc_id are documents of their own.
Ties cannot occur between different lines.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import parts
from .buckets import SIZE_BITS, link_buckets
from .links import partitions_for
from .shared_store import Store, keep_heap, release_memory
from .wordhash import U64, hash_spans, list_array, mix64, text_chunks

SIMILARITY = 0.8
#: Least bits of a block, the number of blocks at that width and the growth of that number with each further bit.
BLOCK_BITS, BLOCKS, BLOCK_GROWTH = 16, 16, 1.17
#: Lines that a block's buckets hold on average, at most, as a power of two.
BUCKET_POWER = 6
#: Share of the SimHash's bits in which two lines may differ to be compared.
DISTANCE = 0.27
#: Bytes up to which a word is short, and the votes of a longer and of a short word.
SHORT_WORD, VOTES = 3, (5, 2)
#: Words whose votes fit a byte together.
SEGMENT = 51
#: Characters of a line beyond which edits are counted over words.
LONG = 10_000
#: Pairs of like lengths that are worth comparing together, cells of their tables at a time, and characters of the lines.
FEW_PAIRS, CELLS, SHORT_LINE = 32, 1 << 17, 4096
#: Characters of pairs that a task gathers before it compares them.
HELD = 4 << 20
#: Blocks that are shuffled together.
BLOCKS_AT_ONCE = 4
#: Ids that may be sent to every executor (16 bytes each).
BROADCAST_IDS = 200_000
_WORDLESS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_part_of_word = re.compile("[0-9A-Za-z\u0080-\U0010ffff]").search
_PART = np.ones(256, bool)
_PART[:128] = [chr(b).isalnum() for b in range(128)]
#: Of each byte the votes on its bits, a byte for each bit; first those of a longer word, then of a short one.
_VOTES = np.concatenate([np.unpackbits(np.arange(256, dtype=np.uint8)).view(U64) * U64(v) for v in VOTES])
#: Bytes of a normal form that are not characters of words as spaces, A-Z as a-z.
_SPACED = bytes(b + 32 * (65 <= b <= 90) if _PART[b] else 32 for b in range(256))


def line_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First byte of each line; a text that has bytes starts one."""
    at = np.unique(np.concatenate([offsets, np.flatnonzero(raw == 0x0A) + 1]))
    return at[: np.searchsorted(at, len(raw))]


def line_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the words, the line of each, first byte of each line, bytes of the words)."""
    n = len(raw)
    line_at = line_starts(raw, offsets)
    if n == 0:
        return np.zeros(0, U64), np.zeros(0, np.int64), line_at, np.zeros(0, np.int64)
    inside = np.frombuffer(raw.tobytes().translate(_PART.tobytes()), bool)
    edges = offsets[offsets < n]
    first = inside.copy()
    first[1:] = inside[1:] > inside[:-1]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] = inside[:-1] > inside[1:]
    edges = edges[edges > 0] - 1
    last[edges] = inside[edges]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    line = np.repeat(np.arange(len(line_at)), np.diff(np.searchsorted(begin, line_at), append=len(begin)))
    return hash_spans(raw, begin, end), line, line_at, end - begin


def line_features(raw: np.ndarray, offsets: np.ndarray, words64: int) -> tuple[np.ndarray, ...]:
    """(text, line number, hash, characters of the normal form, SimHash: a row of ``words64`` 64-bit words) of each line that has words."""
    words, line, line_at, size = line_words(raw, offsets)
    if len(words) == 0:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(U64), none, np.zeros((0, words64), U64)
    first = np.flatnonzero(np.diff(line, prepend=-1))
    count = np.diff(first, append=len(line))
    nth = np.arange(len(line)) - np.repeat(first, count)
    h = mix64(np.add.reduceat(mix64(words + mix64(np.arange(count.max()).astype(U64))[nth]), first) + count.astype(U64))
    length = np.add.reduceat(size, first) + count - 1
    inner = np.flatnonzero((raw & 0xC0) == 0x80)  # bytes that go on with a character
    if len(inner):
        ends = np.append(line_at[1:], len(raw))
        length -= np.searchsorted(inner, ends[line[first]]) - np.searchsorted(inner, line_at[line[first]])
    short = size <= SHORT_WORD
    half = np.add.reduceat(np.where(short, VOTES[1], VOTES[0]), first)
    # A byte of a hash becomes eight bytes of a bit's votes each, as one integer, and the integers of up to SEGMENT words are added at once.
    pieces = -(-count // SEGMENT)
    cuts = np.repeat(first, pieces) + SEGMENT * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    part_of = np.cumsum(pieces) - pieces
    sims = np.empty((len(first), words64), U64)
    a = 0
    while a < len(first):  # bounded: some ten thousand words at a time, or one line
        z = max(a + 1, int(np.searchsorted(first, first[a] + 16_384)))
        begin, stop = first[a], first[z] if z < len(first) else len(words)
        p, q = part_of[a], part_of[z] if z < len(first) else len(cuts)
        table = short[begin:stop] * np.int64(256)
        ones = np.empty((q - p, 8), U64)
        for w in range(words64):
            hashed = words[begin:stop] if w == 0 else mix64(words[begin:stop] + U64(w * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            octets = hashed.view(np.uint8).reshape(-1, 8)
            for k in range(8):
                ones[:, k] = np.add.reduceat(_VOTES.take(octets[:, k] + table), cuts[p:q] - begin)
            votes = ones.view(np.uint8)
            if q - p > z - a:
                votes = np.add.reduceat(votes, part_of[a:z] - p, axis=0, dtype=np.int64)
            sims[a:z, w] = np.packbits(2 * votes.astype(np.int64) > half[a:z, None], axis=1).view(U64).ravel()
        a = z
    text = np.searchsorted(offsets, line_at[line[first]], side="right") - 1
    top = np.searchsorted(line_at, offsets[text], side="left")
    return text, line[first] - top, h, length, sims


def sketch_shape(lines: int) -> tuple[int, int, int]:
    """(bits of a block, blocks, blocks in each 64-bit word) for so many distinct lines."""
    bits = min(60, max(BLOCK_BITS, math.ceil(math.log2(max(lines, 1))) - BUCKET_POWER))
    return bits, math.ceil(BLOCKS * BLOCK_GROWTH ** (bits - BLOCK_BITS)), 64 // bits


def _line_feeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text -> n: how many lines the rows have, in any number of rows."""
    for batch in batches:
        n = sum(int(np.count_nonzero(raw == 0x0A)) for _, _, raw, _ in text_chunks(batch.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array([n + len(batch)], pa.int64())], names=["n"])


def first_of_each(ids: np.ndarray, at: tuple[np.ndarray, ...]) -> np.ndarray:
    """Of each id the row whose ``at`` (least significant column first) is smallest."""
    order = np.lexsort((*at, ids))
    return order[np.flatnonzero(np.diff(ids[order], prepend=~ids[order[:1]]))] if len(order) else order


def _features(batches: Iterator[pa.RecordBatch], words64: int, n: int) -> Iterator[pa.RecordBatch]:
    """doc_id, th, text -> id, doc_id, th, line, size and sketch of the first of equal lines, in parts by id."""
    keep_heap()
    held: list[list[np.ndarray]] = []
    waiting = 0

    def dealt() -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*held)]
        first = first_of_each(columns[0], (columns[3], columns[2], columns[1]))
        columns = [c[first] for c in columns]
        return parts.packed((mix64(columns[0].view(U64)) % U64(n)).astype(np.int32), columns)

    for batch in batches:
        ids, hashes = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        for lo, _, raw, offsets in text_chunks(batch.column(2)):
            text, line, h, length, sims = line_features(raw, offsets, words64)
            if len(h):
                held.append([h.view(np.int64), ids[lo + text], hashes[lo + text], line, length, sims])
                waiting += sum(c.nbytes for c in held[-1])
            if waiting >= HELD:
                yield dealt()
                held, waiting = [], 0
    if held:
        yield dealt()
    release_memory()


#: Columns of a packed table of lines: id, doc_id, th, line, size, sketch.
_LINE = [np.int64, np.int64, np.int64, np.int64, np.int64, U64]


def _first_lines(batches: Iterator[pa.RecordBatch], words64: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``_features`` sorted by part -> the first line of each id, packed."""
    keep_heap()
    for k, columns in enumerate(parts.unpacked(batches, _LINE)):
        columns[5] = columns[5].reshape(-1, words64)
        first = first_of_each(columns[0], (columns[3], columns[2], columns[1]))
        # Each part stays one; only its rows' number matters from here on.
        yield parts.packed(np.full(len(first), k, np.int32), [c[first] for c in columns])
    release_memory()


def _flat(batches: Iterator[pa.RecordBatch], sketches: bool) -> Iterator[pa.RecordBatch]:
    """Packed lines -> id, at, size, or id, size, sketch."""
    for batch in batches:
        for columns in parts.unpacked(iter([batch]), _LINE if not sketches else [np.int64, np.int64, U64]):
            ids = pa.array(columns[0])
            if sketches:
                values = columns[2].view(np.int64)
                yield pa.RecordBatch.from_arrays([ids, pa.array(columns[1]), list_array(values, np.full(len(ids), len(values) // len(ids)))], names=["id", "size", "sketch"])
            else:
                at = pa.StructArray.from_arrays([pa.array(columns[1]), pa.array(columns[2]), pa.array(columns[3].astype(np.int32))], names=["doc_id", "th", "line"])
                yield pa.RecordBatch.from_arrays([ids, at, pa.array(columns[4])], names=["id", "at", "size"])
    release_memory()


def _by_component(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """component, doc_id, th, line -> the same, in parts by component."""
    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)]
        yield parts.packed((mix64(columns[0].view(U64)) % U64(n)).astype(np.int32), columns)
    release_memory()


def _first_by_text(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``_by_component`` sorted by part -> the first line of each component: doc_id, th, line, in parts by text."""
    for component, *at in parts.unpacked(batches, [np.int64] * 4):
        first = first_of_each(component, tuple(reversed(at)))
        doc_id, th, line = (c[first] for c in at)
        yield parts.packed((mix64(mix64(doc_id.view(U64)) + th.view(U64)) % U64(n)).astype(np.int32), [doc_id, th, line])
    release_memory()


def _kept_of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_first_by_text`` sorted by part -> doc_id, th, kept: the numbers of the lines that a text keeps."""
    for doc_id, th, line in parts.unpacked(batches, [np.int64] * 3):
        order = np.lexsort((line, th, doc_id))
        doc_id, th, line = doc_id[order], th[order], line[order]
        first = np.flatnonzero(np.append(True, (doc_id[1:] != doc_id[:-1]) | (th[1:] != th[:-1])))
        yield pa.RecordBatch.from_arrays([pa.array(doc_id[first]), pa.array(th[first]), list_array(line.astype(np.int32), np.diff(first, append=len(line)))], names=["doc_id", "th", "kept"])
    release_memory()


def block_values(sketch: np.ndarray, some: range, bits: int, per_word: int) -> np.ndarray:
    """A row for each block of ``some``: the block's number and its bits, as 40 bits with a sign."""
    out = np.empty((len(some), len(sketch)), np.int64)
    for row, k in zip(out, some):
        row[:] = (sketch[:, k // per_word] >> U64(k % per_word * bits) & U64((1 << bits) - 1)).view(np.int64) + (k << bits & (1 << 40) - 1)
    return out << SIZE_BITS >> SIZE_BITS


def _line_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, asked (line, id, size) -> id, norm, words: each asked line's normal form, and a character for each of its words.

    words is there for lines that a line of more than ``LONG`` characters may be similar to, norm for the others.
    Two words share a character with a chance of 1 in 40,000.
    """
    keep_heap()
    for batch in batches:
        asked = batch.column(1)
        starts, fields = asked.offsets.to_numpy(), asked.values
        lines, ids, sizes = (fields.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        for lo, hi, raw, offsets in text_chunks(batch.column(0)):
            line_at = line_starts(raw, offsets)
            ends = np.append(line_at[1:], len(raw))
            spaced = raw.tobytes().translate(_SPACED)
            top = np.searchsorted(line_at, offsets[:-1], side="left")
            span = slice(starts[lo], starts[hi])
            at = np.repeat(top, np.diff(starts[lo : hi + 1])) + lines[span]
            norms, symbols = [], []
            for k, size in zip(at, sizes[span]):
                norm = spaced[line_at[k] : ends[k]].split()
                norms.append(b" ".join(norm).decode() if size <= LONG else None)
                symbols.append(None)
                if 2 * size > LONG:
                    joined = np.frombuffer(b"".join(norm), np.uint8)
                    edges = np.cumsum([0, *map(len, norm)])
                    symbols[-1] = (hash_spans(joined, edges[:-1], edges[1:]) % U64(40_000) + U64(0x100)).astype("<u2").tobytes().decode("utf-16-le")
            yield pa.RecordBatch.from_arrays([pa.array(ids[span]), pa.array(norms, pa.string()), pa.array(symbols, pa.string())], names=["id", "norm", "words"])
    release_memory()


def edits(a: str, b: str, most: int | None = None) -> int:
    """Levenshtein distance, by bit vectors in one integer of a bit for each character; any larger number than ``most`` where it is more than that."""
    low = 0
    for x, y in zip(a, b):
        if x != y:
            break
        low += 1
    high = 0
    for x, y in zip(reversed(a[low:]), reversed(b[low:])):
        if x != y:
            break
        high += 1
    a, b = a[low : len(a) - high], b[low : len(b) - high]
    if not a or not b:
        return len(a) + len(b)
    if len(a) < len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full, top, score = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    up, down = full, 0  # where the distance rises or falls by one from a character of a to the next
    # Each character of b lowers the distance by one at most.
    spare = len(a) + len(b) if most is None else most + len(b)
    for c in b:
        spare -= 1
        equal = places.get(c, 0)
        steps = (((equal & up) + up) ^ up) | equal | down
        rise, fall = down | (full & ~(steps | up)), up & steps
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        if score > spare:
            return score - spare + most
        rise = rise << 1 | 1
        up, down = (fall << 1 | ~(equal | down | rise)) & full, rise & (equal | down) & full
    return score


def edit_bound(a: list[str], b: list[str]) -> int:
    """An upper bound of the distance of two texts, from an alignment of their words that looks one word ahead."""
    i = j = cost = 0
    m, n = len(a), len(b)
    while i < m and j < n:
        x, y = a[i], b[j]
        if x != y:
            if i + 1 < m and a[i + 1] == y and not (j + 1 < n and a[i + 1] == b[j + 1]):
                cost += len(x) + 1
                i += 1
                continue
            if j + 1 < n and b[j + 1] == x and not (i + 1 < m and a[i + 1] == b[j + 1]):
                cost += len(y) + 1
                j += 1
                continue
            cost += max(len(x), len(y))
        i += 1
        j += 1
    return cost + sum(map(len, a[i:])) + m - i + sum(map(len, b[j:])) + n - j


def within(a: list[str], b: list[str], most: np.ndarray) -> np.ndarray:
    """Which pairs have a Levenshtein distance of at most ``most``; a text of a is no longer than that of b, and all lengths are alike.

    All pairs go through their tables together, one diagonal i + j = s after another, near the line on which a path of ``most`` edits stays.
    A cell holds its distance less s: a step to the side keeps it, one along both texts takes 1 from it, or 2 where the characters are equal.
    """
    m, n = np.array([*map(len, a)]), np.array([*map(len, b)])
    d = n - m
    high, low = (int(x.max() + 1) // 2 * 2 for x in ((most + d) // 2, (most - d) // 2))  # j - i is from -low to high
    end = m + n
    x, y = (np.array(texts, np.str_).view(np.uint32).reshape(len(texts), -1).T for texts in (a, b))
    kind = np.uint16 if max(x.max(), y.max()) < 1 << 16 else np.uint32
    top, left, right = int(end.max()) // 2 + low // 2 + 3, low // 2 + 1, int(end.max()) // 2 + high // 2 + 3
    # Character i of a in row top - i, character j of b in row left + j; fillers differ.
    rows, columns = np.zeros((top + high // 2 + 2, len(a)), kind), np.ones((left + right, len(a)), kind)
    rows[top - len(x) : top] = x[::-1]
    columns[left + 1 : left + 1 + len(y)] = np.where(y == 0, 1, y)
    cells = [np.zeros(((high + low) // 2 + 1 - p, len(a)), np.int16) for p in (0, 1)]  # of even and of odd s
    off = [np.arange(-low + p, high + 1 - p, 2)[:, None] for p in (0, 1)]
    at, found = np.arange(len(a)), np.zeros(len(a), bool)
    for s in range(1, int(end.max()) + 1):
        p = s & 1
        own, other = cells[p], cells[1 - p]
        i, j = (s + low - p) // 2, (s - low + p) // 2
        own -= 1
        np.subtract(own, rows[top - i : top - i + len(own)] == columns[left + j : left + j + len(own)], out=own)
        for mine, beside in ((own, other[:-1]), (own, other[1:])) if p else ((own[1:], other), (own[:-1], other)):
            np.minimum(mine, beside, out=mine)
        if s <= high:
            own[(s + low - p) // 2 :] = 0  # before the first character of a
        if s <= low:
            own[: (low - s - p) // 2 + 1] = 0  # before that of b
        done = np.flatnonzero(end == s)
        found[at[done]] = own[(d[done] + low - p) // 2, done] + s <= most[done]
        if s % 64 == 0:  # pairs that can't end near enough go
            least = np.minimum(*[(cells[k] + np.abs(off[k] - d)).min(0) + s - (k != p) for k in (0, 1)])
            stay = np.flatnonzero((least <= most) & (end > s))
            if len(stay) == 0:
                break
            if len(stay) < 0.8 * len(at):
                at, d, end, most = at[stay], d[stay], end[stay], most[stay]
                rows, columns, *cells = (np.ascontiguousarray(t[:, stay]) for t in (rows, columns, *cells))
    return found


def near_texts(a: list[str], b: list[str], similarity: float) -> np.ndarray:
    """Which pairs of texts are similar: many pairs of like lengths together, first those with half of the edits allowed; the others one by one."""
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b)]
    m, n = np.array([len(x) for x, _ in pairs], np.int64), np.array([len(y) for _, y in pairs], np.int64)
    most = ((1 - similarity + 1e-9) * n).astype(np.int64)
    found = (n == 0) & (m == 0)
    for share in (2, 1):
        left = np.flatnonzero(~found & (m > 0) & (n - m <= most // share))
        left, at = left[np.argsort(n[left], kind="stable")], 0
        while at < len(left):
            size = n[left[at]]
            end = min(int(np.searchsorted(n[left], size + size // 4 + 4, side="right")), at + max(FEW_PAIRS, CELLS // int(size // 4 + 4)))
            some = left[at:end]
            x, y = ([pairs[k][side] for k in some] for side in (0, 1))
            if len(some) >= FEW_PAIRS and size <= SHORT_LINE:
                found[some] = within(x, y, most[some] // share)
            elif share == 1:
                found[some] = [edits(u, v, k) <= k for u, v, k in zip(x, y, most[some].tolist())]
            at = end
    return found


def _similar(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """a, b, two normal forms, two strings of a character for each word -> the pairs that are similar."""
    held: list[tuple[int, int, str, str]] = []
    waiting = 0

    def rows(pairs: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def compared() -> pa.RecordBatch:
        keep = near_texts([r[2] for r in held], [r[3] for r in held], similarity)
        return rows([held[k] for k in np.flatnonzero(keep)])

    for batch in batches:
        near = []
        for a, b, x, y, wx, wy in zip(*[c.to_pylist() for c in batch.columns]):
            if x is None or y is None:
                x, y = wx, wy
            most = int((1 - similarity + 1e-9) * max(len(x), len(y)))
            if abs(len(x) - len(y)) > most:
                continue
            if edit_bound(x.split(" "), y.split(" ")) <= most:
                near.append((a, b))
            else:  # the few that need the exact distance wait for others of their length
                held.append((a, b, x, y))
                waiting += len(x) + len(y)
        yield rows(near)
        if waiting >= HELD:
            yield compared()
            held, waiting = [], 0
    if held:
        yield compared()
    release_memory()


def smallest_partner(sizes: np.ndarray, similarity: float) -> np.ndarray:
    """The least length of a line that a line of this length may be similar to."""
    return sizes - np.floor((1 - similarity + 1e-9) * sizes).astype(np.int64)


def similar_lines(pairs: DataFrame, lines: DataFrame, texts: DataFrame, similarity: float, store: Store) -> DataFrame:
    """The pairs (a, b) whose normal forms are similar; only those lines' texts are read.  texts: one row for each doc_id and th."""
    ids = store.write(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
    asked = lines.select("id", "at", "size").join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi").groupBy("at.doc_id", "at.th").agg(F.collect_list(F.struct("at.line", "id", "size")).alias("asked"))
    asked = store.write(asked, "asked")
    held = asked.select("doc_id", "th")
    rows = texts.join(F.broadcast(held) if held.count() <= BROADCAST_IDS else held, ["doc_id", "th"], "left_semi")
    norms = store.write(rows.join(asked, ["doc_id", "th"]).select("text", "asked").mapInArrow(_line_strings, "id long, norm string, words string"), "norms")
    store.settle()
    text = lambda s: norms.select(F.col("id").alias(s), F.col("norm").alias(f"{s}_norm"), F.col("words").alias(f"{s}_words"))
    both = pairs.join(text("a"), "a").join(text("b"), "b").select("a", "b", "a_norm", "b_norm", "a_words", "b_words")
    found = store.write(both.mapInArrow(partial(_similar, similarity=similarity), "a long, b long"), "links")
    store.free(norms, asked, ids)
    store.settle()
    return found


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, text, kept (line numbers) -> row, text without the removed lines, n_lines, n_removed."""
    for batch in batches:
        texts, lines, removed = [], [], []
        for text, kept, whole in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
            own = rows = [] if text is None else text.split("\n")
            if not whole:
                stay = set(kept or ())
                own = [x for k, x in enumerate(rows) if k in stay or not _part_of_word(x)]
            lines.append(len(rows)), removed.append(len(rows) - len(own))
            texts.append(None if text is None else "\n".join(own))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(removed, pa.int64())], names=["__row", "__text", "__lines", "__removed"])
    release_memory()


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with text_col deduplicated, and __lines (lines before) and __removed (lines taken away)."""
    spark = docs.sparkSession
    store = Store(spark, "lines")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null and text is not null").withColumn("th", F.xxhash64("text"))
    # An upper bound of the distinct lines sets the shape of the SimHash; it counts line feeds, no words.
    most = texts.select("text").mapInArrow(_line_feeds, "n long").agg(F.sum("n")).first()[0]
    bits, blocks, per_word = sketch_shape(most or 1)
    words64 = -(-blocks // per_word)
    n, n_parts = partitions_for(docs), parts.parts_for(docs, most or 1)
    found = texts.select("doc_id", "th", "text").mapInArrow(partial(_features, words64=words64, n=n_parts), parts.schema(6))
    found = found.repartition(n, "part").sortWithinPartitions("part").mapInArrow(partial(_first_lines, words64=words64), parts.schema(6))
    all_lines = store.write(found, "lines")
    sketches = all_lines.select("part", "c0", "c4", "c5")
    lines = all_lines.mapInArrow(partial(_flat, sketches=False), "id long, at struct<doc_id: long, th: long, line: int>, size long")
    store.settle()
    mask = F.lit((1 << bits) - 1).cast("long")
    block = lambda k: F.shiftrightunsigned(F.element_at("sketch", k // per_word + 1), k % per_word * bits).bitwiseAND(mask)
    keys = [F.shiftleft(block(k) + F.lit(k << bits & (1 << 40) - 1).cast("long"), SIZE_BITS) for k in range(blocks)]

    def rows_of(ids: DataFrame | None) -> DataFrame:
        own = sketches.mapInArrow(partial(_flat, sketches=True), "id long, size long, sketch array<long>")
        own = own if ids is None else own.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")
        return own.select(F.explode(F.array(*keys)).alias("key"), "id", "size", "sketch")

    some = [range(k, min(k + BLOCKS_AT_ONCE, blocks)) for k in range(0, blocks, BLOCKS_AT_ONCE)]
    buckets = [partial(block_values, some=x, bits=bits, per_word=per_word) for x in some]
    distance = int(DISTANCE * 64 * words64)
    # Texts are sorted out by their hashes only where some row is there twice.
    twice = lambda rows, *by: not rows.groupBy(*by).count().filter("count > 1").isEmpty()
    once = texts.dropDuplicates(["doc_id", "th"]) if twice(docs.filter(F.col(id_col).isNotNull()), id_col) and twice(texts, "doc_id", "th") else texts
    limit = (partial(smallest_partner, similarity=similarity), lambda low, high: distance)
    labels = link_buckets([rows_of], limit, lambda pairs: similar_lines(pairs, lines, once, similarity, store), store, table=(sketches, buckets, BLOCKS_AT_ONCE * (most or 1)))
    named = lines.select("id", "at").join(labels, "id", "left").select(F.coalesce("component", "id"), "at.doc_id", "at.th", "at.line")
    dealt = lambda df, step, to: df.mapInArrow(partial(step, n=n_parts), to).repartition(n, "part").sortWithinPartitions("part")
    first = dealt(dealt(named, _by_component, parts.schema(4)), _first_by_text, parts.schema(3))
    kept = store.write(first.mapInArrow(_kept_of_texts, "doc_id long, th long, kept array<int>"), "kept")
    store.keep_only(kept)
    store.settle()
    whole = docs.select(F.struct(F.lit(1).alias("__one"), *[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("__row"), F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    # The kept lines are the small side: the texts need not be sorted.
    joined = whole.join(kept.hint("shuffle_hash"), (F.col("__id") == F.col("doc_id")) & (F.xxhash64("__text") == F.col("th")), "left").select("__row", "__text", "kept", F.col("__id").isNull().alias("whole"))
    row_type = whole.schema["__row"].dataType.simpleString()
    out = joined.mapInArrow(_rebuild, f"__row {row_type}, __text string, __lines long, __removed long")
    return out.select(*[(F.col("__text") if c == text_col else F.col("__row").getField(c)).alias(c) for c in docs.columns], "__lines", "__removed")


def keep_deduplicated(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents with their repeated lines removed; one that loses every line with words goes.  Columns as before."""
    out = dedup_lines(docs, similarity).filter((F.col("__removed") == 0) | F.col("text").rlike(_WORDLESS)).drop("__lines", "__removed")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
