"""Word-piece counts by a linear longest-match automaton.

The vocabulary is a trie with two roots: pieces that begin a word, and pieces that go on within one.  A node's failure link
leads to where matching goes on after its longest pieces are popped, and ``pops`` holds how many pieces that is, so a word's
greedy longest-match length is found in one pass over its bytes without building a piece (Song et al., "Fast WordPiece
Tokenization", 2021).  A word that cannot be cut into pieces counts as one unknown piece.

Words are runs of characters other than ASCII white space.  Counts are remembered for each distinct word of a worker.

Rows: a null or empty text has no words.  Repeated rows are counted each on its own.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared_store import bounded_batches

#: Distinct words that a worker remembers.
MEMORY = 300_000


class PieceAutomaton:
    """Failure links and popped-piece counts over a trie of bytes."""

    def __init__(self, first: Iterable[bytes], within: Iterable[bytes]):
        self.go: dict[int, int] = {}  # node * 256 + byte -> node
        self.fail, self.pops = [-1, -1], [0, 0]
        parent, byte, is_piece = [-1, -1], [-1, -1], [False, False]
        order: list[tuple[int, int]] = []  # (depth, node)
        for root, pieces in ((0, first), (1, within)):
            for piece in sorted(pieces):
                at = root
                for depth, b in enumerate(piece):
                    nxt = self.go.get(at << 8 | b)
                    if nxt is None:
                        nxt = self.go[at << 8 | b] = len(parent)
                        parent.append(at), byte.append(b), is_piece.append(False)
                        self.fail.append(-1), self.pops.append(0)
                        order.append((depth, nxt))
                    at = nxt
                if piece:
                    is_piece[at] = True
        for _, v in sorted(order):
            if is_piece[v]:
                self.fail[v], self.pops[v] = 1, 1
                continue
            u, b = parent[v], byte[v]
            z, popped = self.fail[u], self.pops[u]
            while z >= 0 and z << 8 | b not in self.go:
                z, popped = self.fail[z], popped + self.pops[z]
            if z >= 0:
                self.fail[v], self.pops[v] = self.go[z << 8 | b], popped

    def count(self, word: bytes) -> int:
        """Pieces of a word; 0 if it cannot be cut."""
        go, fail, pops = self.go, self.fail, self.pops
        at = n = 0
        for b in word:
            nxt = go.get(at << 8 | b)
            while nxt is None:
                n += pops[at]
                at = fail[at]
                if at < 0:
                    return 0
                nxt = go.get(at << 8 | b)
            at = nxt
        while at != 1:
            if at < 0 or at == 0:
                return 0
            n += pops[at]
            at = fail[at]
        return n


def byte_level_pieces(path: str) -> tuple[list[bytes], list[bytes]]:
    """(first, within) pieces of a byte-level vocabulary file; the first ones hold the space before a word."""
    from .packing import _byte_letters

    letters = _byte_letters()
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    pieces = [bytes(letters[c] for c in p) for p in vocab if all(c in letters for c in p)]
    spaces = set(b" \t\n\x0b\x0c\r")
    first = [p for p in pieces if p[:1] == b" " and not spaces & set(p[1:])]
    return first, [p for p in pieces if p and not spaces & set(p)]


class _Known(dict):
    def __init__(self, automaton: PieceAutomaton, lead: bytes):
        self.automaton, self.lead, self.unknown = automaton, lead, set()

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(self.lead + word)
        if not n:
            self.unknown.add(word)
        self[word] = n or 1
        return self[word]


def _count(batches: Iterator[pa.RecordBatch], automaton, lead: bytes) -> Iterator[pa.RecordBatch]:
    known = _Known(automaton.value, lead)
    for batch in batches:
        words_n, pieces_n, unknown_n = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
        for k, text in enumerate(batch.column(batch.num_columns - 1)):
            words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
            words_n[k], pieces_n[k] = len(words), sum(map(known.__getitem__, words))
            if known.unknown:
                unknown_n[k] = sum(map(known.unknown.__contains__, words))
            if len(known) > MEMORY:
                known.clear()
                known.unknown.clear()
        keep = [batch.column(k) for k in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(words_n), pa.array(pieces_n), pa.array(unknown_n)], names=[*batch.schema.names[:-1], "n_words", "n_tokens", "n_unknown"])


def count_pieces(docs: DataFrame, first: Iterable[bytes], within: Iterable[bytes], lead: bytes = b"", keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """keep columns, n_words, n_tokens, n_unknown of every row; ``lead`` stands before each word."""
    bounded_batches(docs.sparkSession)
    automaton = docs.sparkSession.sparkContext.broadcast(PieceAutomaton(first, within))  # the vocabulary: its size does not depend on the data
    kept = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != "__text")
    return kept.mapInArrow(partial(_count, automaton=automaton, lead=lead), f"{fields}, n_words long, n_tokens long, n_unknown long")
