"""Packing of tokenised documents into sequences by minimum bin slack.

A document is its token ids and one end id.  It is cut at multiples of the capacity, so all pieces but its
last fill a sequence each; what remains is a piece of 1 to capacity - 1 ids.

1. Remaining lengths are counted in Spark: at most ``capacity`` rows, whatever the input.
2. The plan works on those counts alone.  It takes the longest length left, and a bitset subset-sum
   dynamic programme over the other lengths (bounded by their counts, in binary parts) finds
   the fill with the least padding; backtracking through the stored bitsets gives how many pieces of
   each length it takes.  The window is repeated as often as the counts allow.  Every window uses up
   some length or more than halves it, so the plan has at most about 3 x capacity windows, which bounds
   both the driver's work and the table that is broadcast.
3. Pieces are numbered within their length by salted buckets (no length, however common, is numbered in
   one task) and looked up in the plan.

A sequence is padded to the capacity unless its length is a power of two; such lengths cost nothing.

Rows: a null or empty text is the end id alone.  Equal rows are packed one by one.  An empty table has no pieces.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F

from .shared_store import Store, release_memory
from .wordhash import list_array

CAPACITY = 1024
END_ID = 0


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteTokenizer:
    """Ids of a ``tokenizers`` file.

    Where the file is a byte-level BPE whose ids follow the order of its merges, the same ids come several times
    faster from ``tiktoken`` over the file's own vocabulary.  That is used for texts of scripts on which the two
    libraries' Unicode tables cannot differ and which hold none of the file's added tokens; others go through ``tokenizers``.
    """

    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    ODD = regex.compile(r"[^\x00-ɏͰ-ͽΆ-ώЀ-џ‐-‧‰-⁞€ぁ-ゖァ-ヺ一-龥]|[\x85\x1C-\x1F]")

    def __init__(self, file: bytes):
        self.file, self._slow, self.fast = file, None, None
        said = json.loads(file)
        added = [x["content"] for x in said.get("added_tokens") or []]
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        model = said.get("model", {})
        vocab, merges = model.get("vocab", {}), model.get("merges") or []
        letters = _byte_letters()
        plain = model.get("type", "BPE") == "BPE" and (said.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not said["pre_tokenizer"].get("add_prefix_space") and said["pre_tokenizer"].get("use_regex", True) and not said.get("normalizer")
        joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
        order = [vocab.get(x, -1) for x in joined]
        if plain and order and all(a < b for a, b in zip(order, order[1:])) and all(set(x) <= set(letters) for x in joined):
            import tiktoken

            ranks = {bytes(letters[c] for c in t): vocab[t] for t in [*letters, *joined] if t in vocab}
            self.fast = tiktoken.Encoding("file", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @property
    def slow(self):
        """The file's own tokenizer, loaded when a text needs it."""
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_str(self.file.decode())
        return self._slow

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and not self.ODD.search(text) and not (self.added and self.added.search(text)):
            return np.array(self.fast.encode_ordinary(text), dtype="<u4")
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")


def _pieces(batches: Iterator[pa.RecordBatch], file, capacity: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    t = ByteTokenizer(file.value)
    end = np.array([end_id], dtype="<u4")
    for batch in batches:
        ids = batch.column(0)
        for at in range(0, batch.num_rows, 256):
            row, start, length, crc, total, held = [], [], [], [], [], []
            for k, text in enumerate(batch.column(1).slice(at, 256)):
                whole = np.concatenate([t.ids(text.as_py() or ""), end])
                view = whole.tobytes()
                for s in range(0, len(whole), capacity):
                    e = min(s + capacity, len(whole))
                    row.append(at + k), start.append(s), length.append(e - s), total.append(len(whole))
                    crc.append(zlib.crc32(view[4 * s : 4 * e]))
                    if with_ids:
                        held.append(whole[s:e])
            columns = [ids.take(pa.array(row, pa.int64())), *[pa.array(x, pa.int64()) for x in (start, length, crc, total)]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(list_array(np.concatenate(held).astype(np.int32) if held else np.zeros(0, np.int32), np.array(length, int)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)
    del t
    release_memory()


def padding(length: int, capacity: int) -> int:
    """Pad ids of a sequence of so many ids."""
    return 0 if length & (length - 1) == 0 else capacity - length


def fill_window(counts: dict[int, int], seed: int, capacity: int) -> dict[int, int]:
    """How many pieces of each length go with one of length ``seed``, for the least padding (then the fullest window)."""
    room = capacity - seed
    mask = (1 << (room + 1)) - 1
    bits, steps = 1, []
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == seed), room // length if length <= room else 0)
        part = 1
        while left > 0 and not bits >> room & 1:
            take = min(part, left)
            steps.append((length, take, bits))
            bits |= (bits << (length * take)) & mask
            left -= take
            part *= 2
        if bits >> room & 1:
            break
    at = min((s for s in range(room + 1) if bits >> s & 1), key=lambda s: (padding(seed + s, capacity), -s))
    used = {seed: 1}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return used


def plan_windows(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """counts: pieces of each length -> (length, first rank, end rank, first sequence, pieces a sequence, offset)."""
    left, rank, slots, sequence = {k: v for k, v in counts.items() if v > 0}, dict.fromkeys(counts, 0), [], 0
    while left:
        used = fill_window(left, max(left), capacity)
        repeat = min(left[k] // n for k, n in used.items())
        offset = 0
        for length in sorted(used, reverse=True):
            n = used[length]
            slots.append((length, rank[length], rank[length] + n * repeat, sequence, n, offset))
            rank[length] += n * repeat
            left[length] -= n * repeat
            offset += n * length
            if not left[length]:
                del left[length]
        sequence += repeat
    return slots


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece (and ids, if asked for)."""
    spark = docs.sparkSession
    store = Store(spark, "packing")
    with open(tokenizer_path, "rb") as f:
        file = spark.sparkContext.broadcast(f.read())  # the vocabulary: its size does not depend on the data
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = kept.schema["doc_id"].dataType.simpleString()
    pieces = kept.mapInArrow(partial(_pieces, file=file, capacity=capacity, end_id=end_id, with_ids=with_ids), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = store.write(pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets))), "pieces")
    counts = store.write(pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")), "counts")
    totals = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # a row for each length up to the capacity
    slots = spark.createDataFrame(plan_windows(totals, capacity), "length long, lo long, hi long, base long, each long, at long")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = pieces.withColumn("rank", F.row_number().over(within) - 1).join(shift, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("shift"))
    s = F.broadcast(slots.withColumnRenamed("length", "slot_length"))
    placed = ranked.join(s, (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    nth = F.col("rank") - F.col("lo")
    sequence, offset = F.col("base") + F.floor(nth / F.col("each")), F.col("at") + nth % F.col("each") * F.col("length")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"), *["ids"] * with_ids)
