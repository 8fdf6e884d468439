"""Dominance counting: of each point, how many lie at the same or an earlier slot and on a higher level.

Points of equal slot and level have equal counts, so they are first added up to cells. Cells in
the order of slots, and of levels downwards within a slot, are cut into range shards of bounded
size; what is above a cell comes before it in this order. A cell's count has three parts:

* cells of its own shard: a persistent segment tree over the shard's levels, one version per slot
  by path copying, answers the suffix of higher levels in the version of the cell's slot;
* cells of earlier shards that share its bucket of levels, buckets being ranges of cells in the
  order of (level, slot): the bucket's persistent tree over that order, one version per shard;
* cells of earlier shards in higher buckets: histograms over the buckets, carried from shard to
  shard, and their suffix sums.

Either order is total, so a slot or a level may spread over any number of shards or buckets.
A shard or bucket has max(SHARD_CELLS, square root of all cells) cells, hence the histograms
have no more entries than there are cells. Nothing passes the driver but a few totals.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeflow.llm.common import HOT_SHARE, scratch_table

#: Cells of a shard at least.
SHARD_CELLS = 1 << 14
#: Parts that the points without a slot or level are dealt to.
NULL_PARTS = round(1 / HOT_SHARE)
CELL = "slot long, level long, n long, w long, shard int, n_above long, w_above long"
BUCKETED = CELL + ", bucket int"


class PersistentTree:
    """Two counts by position, in a segment tree each version of which shares the nodes that it doesn't change with the version before.

    Node 0 is the empty tree. Positions of one version are added together, depth by depth.
    """

    def __init__(self, width: int, points: int):
        self.height = max(1, (width - 1).bit_length())
        room = points * (self.height + 1) + 1
        self.left, self.right = np.zeros(room, np.int64), np.zeros(room, np.int64)
        self.sums = np.zeros((room, 2), np.int64)
        self.size, self.roots = 1, [0]

    def add(self, at: np.ndarray, values: np.ndarray) -> None:
        """A new version with values (pairs) added at the positions, which ascend."""
        over, old, new = at[:0], np.array([self.roots[-1]]), at[:0]
        for depth in range(self.height + 1):
            place = at >> (self.height - depth)
            starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
            place = place[starts]
            if depth:
                parent, odd = np.searchsorted(over, place >> 1), (place & 1).astype(bool)
                old = np.where(odd, self.right[old[parent]], self.left[old[parent]])
            made = np.arange(self.size, self.size + len(place))
            self.size += len(place)
            self.left[made], self.right[made] = self.left[old], self.right[old]
            self.sums[made] = self.sums[old] + np.add.reduceat(values, starts)
            if depth:
                self.right[new[parent[odd]]] = made[odd]
                self.left[new[parent[~odd]]] = made[~odd]
            else:
                self.roots.append(self.size - 1)
            over, new = place, made

    def above(self, versions: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The sums over all positions larger than at, each in its version."""
        node, out = np.array(self.roots)[versions], np.zeros((len(at), 2), np.int64)
        for depth in range(self.height - 1, -1, -1):
            odd = ((at >> depth) & 1).astype(bool)
            out[~odd] += self.sums[self.right[node[~odd]]]
            node = np.where(odd, self.right[node], self.left[node])
        return out


def _columns(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray] | None:
    held = [b for b in batches if b.num_rows]
    if not held:
        return None
    t = pa.Table.from_batches(held)
    return {c: t.column(c).to_numpy() for c in t.column_names}


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    return list(zip(cuts[:-1], cuts[1:]))


def _batches(columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    yield from pa.table(columns).to_batches(max_chunksize=10_000)


def _in_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells in order of slot, then level downwards: what is above each within the shard."""
    c = _columns(batches)
    if c is None:
        return
    levels, at = np.unique(c["level"], return_inverse=True)
    values = np.stack([c["n"], c["w"]], axis=1)
    tree, version = PersistentTree(len(levels), len(at)), np.empty(len(at), np.int64)
    for k, (lo, hi) in enumerate(_runs(c["slot"])):
        tree.add(at[lo:hi][::-1], values[lo:hi][::-1])
        version[lo:hi] = k + 1
    above = tree.above(version, at)
    yield from _batches(c | {"shard": np.full(len(at), TaskContext.get().partitionId(), np.int32), "n_above": above[:, 0], "w_above": above[:, 1]})


def _in_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells in order of level, then slot: adds what is above each in the same bucket and in earlier shards."""
    c = _columns(batches)
    if c is None:
        return
    n = len(c["shard"])
    by_shard = np.argsort(c["shard"], kind="stable")
    values = np.stack([c["n"], c["w"]], axis=1)
    tree, version = PersistentTree(n, n), np.empty(n, np.int64)
    for k, (lo, hi) in enumerate(_runs(c["shard"][by_shard])):
        own = by_shard[lo:hi]
        version[own] = k
        tree.add(own, values[own])
    above = tree.above(version, np.arange(n))
    yield from _batches(c | {"n_above": c["n_above"] + above[:, 0], "w_above": c["w_above"] + above[:, 1], "bucket": np.full(n, TaskContext.get().partitionId(), np.int32)})


def above_cells(cells: DataFrame) -> DataFrame:
    """Of distinct cells slot, level, n, w (all long, none null): slot, level, n, n_above, w_above."""
    spark = cells.sparkSession
    cells = scratch_table(cells.select("slot", "level", "n", "w"), "cells")
    total = cells.count()
    if not total:
        return cells.select("slot", "level", "n", F.lit(0).cast("long").alias("n_above"), F.lit(0).cast("long").alias("w_above"))
    parts = ceil(total / max(SHARD_CELLS, isqrt(total)))
    order = [F.col("slot"), F.col("level").desc()]
    shards = scratch_table(cells.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_in_shard, CELL), "shards")
    order = [F.col("level"), F.col("slot")]
    bucketed = scratch_table(shards.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_in_bucket, BUCKETED), "buckets")
    n_shards, n_buckets = bucketed.agg(F.max("shard"), F.max("bucket")).first()
    n_shards, n_buckets = n_shards + 1, n_buckets + 1
    carried = ["n", "w"]
    empty = spark.range(n_shards * n_buckets).select((F.col("id") / n_buckets).cast("int").alias("shard"), (F.col("id") % n_buckets).cast("int").alias("bucket"), *(F.lit(0).cast("long").alias(c) for c in carried))
    histogram = bucketed.select("shard", "bucket", *carried).unionByName(empty).groupBy("shard", "bucket").agg(*(F.sum(c).alias(c) for c in carried))
    earlier = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    higher = Window.partitionBy("shard").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    histogram = histogram.select("shard", "bucket", *(F.sum(c).over(earlier).alias(c) for c in carried))
    histogram = histogram.select("shard", "bucket", *(F.coalesce(F.sum(c).over(higher), F.lit(0)).alias(f"{c}_higher") for c in carried))
    return bucketed.join(histogram, ["shard", "bucket"]).select("slot", "level", "n", *((F.col(f"{c}_above") + F.col(f"{c}_higher")).alias(f"{c}_above") for c in carried))


def dominance_counts(points: DataFrame, slot: Column, level: Column, weight: Column, keep: list[str]) -> DataFrame:
    """The columns keep of every row of points, with slot, level, n_above and w_above (long).

    n_above counts the points of the same or an earlier slot and a strictly higher level,
    w_above is the sum of their weights; both are 0 if there are none. Defined cases: points
    without a slot or a level are above none and have null counts; a null weight counts as 0;
    repeated rows count each; other columns, and any named like the ones above, are left out
    unless kept under another name; an empty table gives an empty result.
    """
    own = points.select(*(F.col(c) for c in keep), slot.cast("long").alias("slot"), level.cast("long").alias("level"), F.coalesce(weight.cast("long"), F.lit(0)).alias("_w"))
    here = F.col("slot").isNotNull() & F.col("level").isNotNull()
    cells = own.filter(here).groupBy("slot", "level").agg(F.count(F.lit(1)).alias("n"), F.sum("_w").alias("w"))
    above = scratch_table(above_cells(cells), "above")
    total = above.agg(F.sum("n")).first()[0] or 0
    # A cell of over HOT_SHARE of all points is copied, and its points dealt to the copies; at most its inverse of such cells exist, whose keys are broadcast.
    limit = max(1, ceil(total * HOT_SHARE))
    copies = F.ceil(F.col("n") / limit).cast("int")
    hot = above.filter(F.col("n") > limit).select("slot", "level", copies.alias("_copies"))
    parts = F.when(here, F.coalesce("_copies", F.lit(1))).otherwise(NULL_PARTS)
    dealt = own.join(F.broadcast(hot), ["slot", "level"], "left").select(*keep, "slot", "level", F.pmod(F.monotonically_increasing_id(), parts.cast("long")).cast("int").alias("_copy"))
    answers = above.select("slot", "level", F.explode(F.sequence(F.lit(0), copies - 1)).alias("_copy"), "n_above", "w_above")
    return dealt.join(answers, ["slot", "level", "_copy"], "left").select(*keep, "slot", "level", "n_above", "w_above")


def sale_slot(sales: DataFrame, column: str = "sold_at") -> Column:
    """The day of a time that stands for UTC, whatever the session's zone is."""
    kind = dict(sales.dtypes)[column]
    return F.unix_date(F.col(column).cast("date")) if kind == "timestamp_ntz" else F.floor(F.unix_seconds(F.col(column).cast("timestamp")) / 86400)


def sale_level(total: Column) -> Column:
    """Tens of units of a total, rounded to hundredths first, in double arithmetic; null for a total that is no number."""
    cents = F.lit(100.0) * total + F.lit(0.5)
    whole = F.when(F.abs(cents) < 2.0**53, F.floor(cents).cast("double")).otherwise(cents)  # larger doubles are whole
    tens = whole / F.lit(1000.0)
    return F.when(F.abs(tens) < 2.0**63, F.floor(tens))


def sales_above(sales: DataFrame) -> DataFrame:
    """sale_id, slot, level, n_sales, n_rows of every sale; a null sale_id stands for crc32 0. Other columns are ignored."""
    weight = 1 + F.crc32(F.coalesce(F.col("sale_id").cast("string"), F.lit("")).cast("binary")) % 3
    counted = dominance_counts(sales, sale_slot(sales), sale_level(F.col("total").cast("double")), weight, ["sale_id"])
    return counted.withColumnsRenamed({"n_above": "n_sales", "w_above": "n_rows"})
