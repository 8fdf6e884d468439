"""Best-fit-decreasing packing of documents into sequences of a fixed number of tokens.

Lengths are at most the sequence length, so the plan for any number of pieces follows
from how many pieces have each length: equal lengths, and equally filled bins, are
handled as one group. A segment tree over remaining capacities finds the tightest open
bins in logarithmic time. The plan has at most some thousands of rows per length, for any
corpus; pieces take their places by their rank among those of their length.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeflow.llm.common import bounded_batches, scratch_table, texts
from cladeflow.llm.tokens import vocabulary_path, word_tokenizer

#: Rows of ranks by length and block that are broadcast; more of them meet the pieces in a shuffle.
BROADCAST_ROWS = 1_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, block int, own long"


class CapacityTree:
    """A segment tree over the capacities 0 to size: which have an open bin, and the least of at least c."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.tree = bytearray(2 * self.width)

    def set(self, capacity: int, present: bool) -> None:
        i = self.width + capacity
        self.tree[i] = present
        while i > 1:
            i >>= 1
            self.tree[i] = self.tree[2 * i] | self.tree[2 * i + 1]

    def tightest(self, capacity: int) -> int:
        """The least capacity of an open bin that is at least the one given; -1 if there is none."""
        i = self.width + capacity
        if self.tree[i]:
            return capacity
        while i > 1:
            if not i & 1 and self.tree[i + 1]:
                i += 1
                while i < self.width:
                    i = 2 * i + (not self.tree[2 * i])
                return i - self.width
            i >>= 1
        return -1


def pack_lengths(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths.

    Returns rows (length, first rank, last rank + 1, first bin, offset): the pieces of that
    length with those ranks lie in consecutive bins, each at that offset.
    """
    tree, groups, plan, bins = CapacityTree(size), {}, [], 0
    for length in sorted((x for x in counts if x > 0), reverse=True):
        left, rank = counts[length], 0
        while left:
            fit = tree.tightest(length)
            if fit < 0:
                # Several pieces of one length share a new bin: it stays the tightest until it is too full for another.
                each = size // length
                while left:
                    n_bins, stack = (left // each, each) if left >= each else (1, left)
                    for k in range(stack):
                        plan.append((length, rank, rank + n_bins, bins, k * length))
                        rank += n_bins
                    left -= n_bins * stack
                    groups.setdefault(size - stack * length, deque()).append((bins, n_bins))
                    tree.set(size - stack * length, True)
                    bins += n_bins
                break
            first, n_open = groups[fit].popleft()
            n_used = min(left, n_open)
            plan.append((length, rank, rank + n_used, first, size - fit))
            if n_used < n_open:
                groups[fit].appendleft((first + n_used, n_open - n_used))
            elif not groups[fit]:
                tree.set(fit, False)
            groups.setdefault(fit - length, deque()).append((first, n_used))
            tree.set(fit - length, True)
            left -= n_used
            rank += n_used
    return plan


def _pieces(size: int, end_id: int, path: str, keep_ids: bool, id_bytes: int):
    end = int(end_id).to_bytes(4, "little")
    names = [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * keep_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(path)
        block, seen = TaskContext.get().partitionId(), [0] * (size + 1)
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), tokenizer.ids(batch.column(1).to_pylist())):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    n = len(part) // 4
                    rows.append((doc, k, at // 4, n, zlib.crc32(part), block, seen[n], *([np.frombuffer(part, "<u4").astype(f"<u{id_bytes}").tobytes()] * keep_ids)))
                    seen[n] += 1
            columns = list(zip(*rows)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names)

    return run


def id_bytes(path: str, *others: int) -> int:
    """Bytes that hold each id of the vocabulary and the other ids: 2 or 4."""
    return 2 if max(word_tokenizer(path).tokenizer.get_vocab_size() - 1, *others) < 1 << 16 else 4


def pieces(docs: DataFrame, size: int, end_id: int, path: str, keep_ids: bool = False) -> DataFrame:
    """The pieces of every document: its ids, then the end id, cut only where they exceed a sequence.

    block is the task that made a piece, own its rank there among those of its length; both
    hold once the pieces are stored. With keep_ids, ids holds a piece's ids as little-endian
    unsigned integers of ``id_bytes`` bytes.
    """
    bounded_batches(docs.sparkSession)
    wide = id_bytes(path, end_id) if keep_ids else 4
    t = texts(docs).select("doc_id", F.col("text").cast("binary").alias("text"))
    return t.mapInArrow(_pieces(size, end_id, path, keep_ids, wide), PIECES + (", ids binary" if keep_ids else ""))


def by_slot(plan: list[tuple[int, int, int, int, int]]) -> tuple[dict[int, int], list[tuple[int, int, int, int, int, int]]]:
    """Ranks of a slot for each length, and the plan's rows (length, slot, first rank, last rank + 1, first bin, offset), once for each slot that they touch.

    A length has as many slots as plan rows, so a plan row touches two slots, and a piece meets
    two plan rows, in the mean.
    """
    of: dict[int, list] = {}
    for row in plan:
        of.setdefault(row[0], []).append(row)
    each = {length: max(1, rows[-1][2] // len(rows)) for length, rows in of.items()}
    return each, [(length, slot, lo, hi, first, at) for length, lo, hi, first, at in plan for slot in range(lo // each[length], (hi - 1) // each[length] + 1)]


def place(cut: DataFrame, size: int) -> DataFrame:
    """cut with sequence_id and offset in place of block and own; cut must be a stored table, as it is read twice.

    Pieces don't move: what they need is one row for each length and block, and the few plan
    rows of their length and slot.
    """
    spark = cut.sparkSession
    sizes = scratch_table(cut.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row per length: at most size
    plan = pack_lengths(counts, size)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")
    each, steps = by_slot(plan)
    widths = spark.createDataFrame(list(each.items()) or [(0, 1)], "length long, _each long")  # one row per length
    starts = sizes.select("length", "block", before.alias("_before")).join(F.broadcast(widths), "length")
    if sizes.count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    slots = spark.createDataFrame(steps or [(0, 0, 0, 0, 0, 0)], "length long, _slot long, lo long, hi long, bin long, offset long")
    if len(steps) <= BROADCAST_ROWS:
        slots = F.broadcast(slots)
    rank = F.col("_before") + F.col("own")
    ranked = cut.join(starts, ["length", "block"]).withColumns({"_rank": rank, "_slot": F.floor(rank / F.col("_each"))}).join(slots, ["length", "_slot"])
    kept = [c for c in cut.columns if c not in ("block", "own")]
    return ranked.filter((F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi"))).select(*kept, (F.col("bin") + F.col("_rank") - F.col("lo")).alias("sequence_id"), "offset")


def best_fit_packing(docs: DataFrame, size: int = 2048, end_id: int = 0, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs.

    Defined cases: a null text is empty and gives one piece, the end id alone; rows that
    repeat a doc_id are packed each; an empty table gives an empty result; other columns
    are ignored.
    """
    cut = scratch_table(pieces(docs, size, end_id, path or vocabulary_path("word_bpe_49k.json")), "pieces")
    return place(cut, size)
