"""Dealing timed families to machines: what to leave out, and an even packing.

Input is a runtime table (time, clades, genes, species, file).
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeflow.operators.prefix import with_running
from cladeflow.operators.stored import stored


def near_universal_bound(times: DataFrame, share: float = 0.8) -> float:
    """The time below which a share of the near-universal families stay: those with over 80 % of the most species."""
    most = times.agg(F.max("species")).first()[0] or 0
    got = times.filter(F.col("species") > 0.8 * most).agg(F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY time)")).first()[0]
    return float(got or 0.0)


def keep_conservative(times: DataFrame, machines: int, rounds: int = 50) -> tuple[DataFrame, float]:
    """Drop families that alone take longer than a machine's ideal share, until none does or a fifth of the near-universal ones would go."""
    bound = near_universal_bound(times)
    most = times.agg(F.max("species")).first()[0] or 0
    universal = F.col("species") > 0.8 * most
    start, n_universal = times.agg(F.sum("time"), F.sum(F.when(universal, 1).otherwise(0))).first()
    ideal = max((start or 0.0) / machines, bound)
    for _ in range(rounds):
        total, left = times.filter(F.col("time") < ideal).agg(F.coalesce(F.sum("time"), F.lit(0.0)), F.coalesce(F.sum(F.when(universal, 1).otherwise(0)), F.lit(0))).first()
        new = max(total / machines, bound)
        if new == ideal or (n_universal and 1 - left / n_universal > 0.2):
            break
        ideal = new
    return times.filter(F.col("time") < ideal), ideal


def species_time_cut(times: DataFrame, share: float) -> DataFrame:
    """Of the families with equally many species, the fastest ones that together take less than a share of their time."""
    w = Window.partitionBy("species").orderBy("time", "file").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("species")
    return times.withColumn("_part", F.sum("time").over(w) / F.sum("time").over(whole)).filter(F.col("_part") < share).drop("_part")


def keep_aggressive(times: DataFrame, keep_share: float = 0.8, step: float = 0.01) -> DataFrame:
    """The cut by species count and time that leaves no more than a share of the families, by bisection on the cut."""
    n = times.count()
    low, high = 0.0, 1.0
    while high - low > step:
        mid = (low + high) / 2
        if species_time_cut(times, mid).count() > keep_share * n:
            high = mid
        else:
            low = mid
    return species_time_cut(times, low)


def pack_list(items: list[tuple[str, float]], machines: int, rounds: int = 1000) -> list[tuple[str, int, float]]:
    """Longest first, each to the machine with the least so far; then moves and swaps between the fullest and the emptiest."""
    heap = [(0.0, k) for k in range(machines)]
    bins: list[list[tuple[float, str]]] = [[] for _ in range(machines)]
    for name, time in sorted(items, key=lambda x: (-x[1], x[0])):
        load, k = heapq.heappop(heap)
        bins[k].append((time, name))
        heapq.heappush(heap, (load + time, k))
    for _ in range(rounds):
        loads = [sum(t for t, _ in b) for b in bins]
        hi, lo = max(range(machines), key=loads.__getitem__), min(range(machines), key=loads.__getitem__)
        gap = loads[hi] - loads[lo]
        out, back = np.array([t for t, _ in bins[hi]]), np.array([0.0, *(t for t, _ in bins[lo])])
        if not len(out):
            break
        new = np.abs(gap - 2 * (out[:, None] - back[None, :]))
        i, j = np.unravel_index(int(np.argmin(new)), new.shape)
        if new[i, j] >= gap - 1e-9:
            break
        moved = bins[hi].pop(i)
        if j:
            bins[hi].append(bins[lo].pop(j - 1))
        bins[lo].append(moved)
    return [(name, k, time) for k, b in enumerate(bins) for time, name in sorted(b)]


#: The longest families, so many for each machine, are placed one by one; the rest is poured.
HEAD = 64


def deal(times: DataFrame, machines: int, head: int = HEAD, rounds: int = 1000) -> DataFrame:
    """file, cpu, time: families (file, time) dealt to machines, evenly for any number of them.

    The longest ones, head for each machine, are placed longest first and balanced by swaps:
    their number is bounded. All others, in the order of their times, are poured into what the
    machines have left below the common level: a running sum over ranges tells each family how
    much comes before it, and so where it goes. No machine is off the level by more than one
    poured family, which takes at most 1 / head of a machine's share. A null time counts as 0.
    """
    rows = times.select("file", F.coalesce(F.col("time").cast("double"), F.lit(0.0)).alias("time"))
    order = [F.desc("time"), F.asc_nulls_first("file")]
    ranked = stored(with_running(rows, order, {"_before": "time"}, "_rank"), "ranked")
    n_head = head * machines
    first = [(r["file"], r["time"]) for r in ranked.filter(F.col("_rank") <= n_head).collect()]  # head for each machine
    placed = pack_list(first, machines, rounds)
    loads_ = np.zeros(machines)
    for _, k, t in placed:
        loads_[k] += t
    rest, start = ranked.filter(F.col("_rank") > n_head).agg(F.coalesce(F.sum("time"), F.lit(0.0)), F.coalesce(F.min("_before"), F.lit(0.0))).first()
    # The level at which the room below it is what there is to pour.
    order_ = np.sort(loads_)
    room = np.arange(1, machines + 1) * order_ - np.cumsum(order_)
    k = int(np.searchsorted(room, rest, side="right"))
    level = (rest + order_[:k].sum()) / max(k, 1)
    bounds = np.cumsum(np.maximum(level - loads_, 0.0))
    open_ = np.flatnonzero(loads_ < level) if rest > 0 else np.array([0])
    edges = bounds[open_][:-1]

    @F.pandas_udf("int")
    def machine(middle: pd.Series) -> pd.Series:
        return pd.Series(open_[np.searchsorted(edges, middle.to_numpy(), side="right")].astype("int32"))

    poured = ranked.filter(F.col("_rank") > n_head).select("file", machine(F.col("_before") - F.lit(float(start)) + F.col("time") / 2).alias("cpu"), "time")
    return times.sparkSession.createDataFrame(placed, "file string, cpu int, time double").select(F.col("file").cast(times.schema["file"].dataType).alias("file"), "cpu", "time").unionByName(poured)


def pack(times: DataFrame, machines: int = 64, policy: str = "conservative") -> DataFrame:
    """file, cpu, time: where each family goes that the policy (conservative, aggressive or all) keeps."""
    kept = {"conservative": lambda: keep_conservative(times, machines)[0], "aggressive": lambda: keep_aggressive(times), "all": lambda: times}[policy]()
    return deal(kept, machines)


def loads(packed: DataFrame) -> DataFrame:
    return packed.groupBy("cpu").agg(F.sum("time").alias("load"), F.count(F.lit(1)).alias("families"))
