"""Best-fit-decreasing packing of document pieces into token sequences of bounded length.

Pieces of one length are alike, so the packing is decided on how many there are of each length (at most `capacity`
numbers) and is the same as one that takes the pieces one by one, longest first: each goes to the tightest open
sequence that has room, found by descending a segment tree over the remaining capacities, else it opens a new one.
Numbering the pieces of a length, and finding each one's place, are Spark's work.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm import tokens
from faultline.llm.common import chunks, key_type, texts_of, tidy, utf8

#: Pieces of one length are numbered in so many shares, so a length that many pieces have is not one task's.
SHARES = 64
#: Pieces that leave a task together.
TOGETHER = 4096
PIECES = "doc_id {}, piece int, start long, length long, ids_crc32 long"


class CapacityTree:
    """How many open sequences have each remaining capacity; the tightest fit in logarithmic time."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, remaining: int, n: int) -> None:
        node = self.leaves + remaining
        while node:
            self.count[node] += n
            node >>= 1

    def tightest(self, least: int) -> int:
        """The smallest remaining capacity of at least `least` that an open sequence has, or -1."""
        node = self.leaves + least
        if self.count[node]:
            return least
        while node > 1 and (node & 1 or not self.count[node + 1]):  # up to the first right neighbour that holds any
            node >>= 1
        if node <= 1:
            return -1
        node += 1
        while node < self.leaves:
            node = 2 * node if self.count[2 * node] else 2 * node + 1
        return node - self.leaves


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go: (length, first, n, sequence, each, offset) puts the n pieces of that length
    numbered from `first` into sequences from `sequence` on, `each` to a sequence, side by side from `offset`."""
    tree, open_at = CapacityTree(capacity), [deque() for _ in range(capacity + 1)]
    out, opened = [], 0

    def keep(remaining, first, n):
        if remaining and n:
            open_at[remaining].append((first, n))
            tree.add(remaining, n)

    for length in sorted(counts, reverse=True):
        first, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room < 0:
                room = capacity
                each = room // length
                sequence, n = opened, -(-left // each)
                opened += n
            else:
                each = room // length
                sequence, n = open_at[room].popleft()
                tree.add(room, -n)
                wanted = -(-left // each)
                if wanted < n:
                    open_at[room].appendleft((sequence + wanted, n - wanted))
                    tree.add(room, n - wanted)
                    n = wanted
            placed = min(left, n * each)
            out.append((length, first, placed, sequence, each, capacity - room))
            full, rest = divmod(placed, each)
            keep(room - each * length, sequence, full)
            keep(room - rest * length, sequence + full, 1 if rest else 0)
            first, left = first + placed, left - placed
    return out


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end id, cut every `capacity` tokens only.
    A null text is empty: one piece with the end id alone."""

    def run(batches):
        encoder = tokens.spaced(tokenizer)
        for batch in batches:
            types = (batch.column("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            table = lambda out, types=types: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["doc_id", "piece", "start", "length", "ids_crc32"])
            texts, keys = utf8(batch.column("text")), batch.column("doc_id").to_pylist()
            out: list[list] = [[], [], [], [], []]
            for a, b in chunks(texts):
                ids, sizes = encoder(texts[a:b])
                ends = np.cumsum(sizes)
                raw = np.insert(ids, ends, end_id).astype("<u4").tobytes()
                at = 0
                for key, size in zip(keys[a:b], (sizes + 1).tolist()):
                    for piece, start in enumerate(range(0, size, capacity)):
                        length = min(capacity, size - start)
                        for column, value in zip(out, (key, piece, start, length, zlib.crc32(raw[4 * (at + start) : 4 * (at + start + length)]))):
                            column.append(value)
                    at += size
                if len(out[0]) >= TOGETHER:
                    yield table(out)
                    out = [[], [], [], [], []]
            yield table(out)

        encoder.table.clear()  # the worker lives on

    plain = texts_of(docs)
    return plain.mapInArrow(tidy(run), PIECES.format(key_type(plain)))


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """The pieces with their sequence_id and offset. `pieces` is read three times: pass a written table.

    Columns needed: doc_id, piece, length (1 to `capacity`); others stay, but for own names of this function
    (sequence_id, offset, and the two it works with). Rows that are alike are separate pieces; an empty table
    stays empty.
    """
    taken = {"sequence_id", "offset", "_share", "_number", "_before"}
    kept = [c for c in pieces.columns if c not in taken]
    shared = pieces.select(*kept, F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SHARES)).alias("_share"))
    counts = shared.groupBy("length", "_share").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    shares = counts.select("length", "_share", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `capacity` rows at most
    moves = np.array(plan(totals, capacity), np.int64).reshape(-1, 6)
    keys = (moves[:, 0] << 44) + moves[:, 1]  # by length, then number
    order = np.argsort(keys, kind="stable")
    moves, keys = moves[order], keys[order]
    numbered = shared.join(shares, ["length", "_share"]).withColumn("_number", F.col("_before") + F.row_number().over(Window.partitionBy("length", "_share").orderBy("doc_id", "piece")) - 1)

    def run(batches):
        for batch in batches:
            length, number = batch.column("length").to_numpy(zero_copy_only=False), batch.column("_number").to_numpy(zero_copy_only=False)
            m = moves[np.searchsorted(keys, (length << 44) + number, side="right") - 1]
            k = number - m[:, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(m[:, 3] + k // m[:, 4]), pa.array(m[:, 5] + k % m[:, 4] * length)], [*kept, "sequence_id", "offset"])

    types = dict(pieces.dtypes)
    return numbered.select(*kept, "_number").mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in kept) + ", sequence_id long, offset long")


def sequences(packed: DataFrame, ids: str = "ids") -> DataFrame:
    """(sequence_id, ids): the token arrays put together, for pieces that carry theirs; a group has `capacity` tokens at most."""
    rows = F.array_sort(F.collect_list(F.struct("offset", F.col(ids).alias("ids"))))
    return packed.groupBy("sequence_id").agg(rows.alias("rows")).select("sequence_id", F.flatten(F.col("rows.ids")).alias("ids"))
