"""Species trees as tables: branches, closure, ages and what is alive when."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeflow.functions.species_tree import SpeciesTree, grid, slices


def branches(spark: SparkSession, tree: SpeciesTree) -> DataFrame:
    """branch, name, label, parent, left, right, length, height, age, is_leaf, rank of every branch."""
    h, age = tree.heights(), tree.ages()
    inner = sorted(range(tree.n_leaves, tree.n), key=lambda e: age[e])
    rank = {e: k + 1 for k, e in enumerate(inner)}
    rows = [
        (e, tree.branch_name(e), tree.labels[e], *(int(x[e]) if x[e] >= 0 else None for x in (tree.parent, tree.left, tree.right)), float(tree.length[e]), float(h[e]), float(age[e]), e < tree.n_leaves, rank.get(e, 0))
        for e in range(tree.n)
    ]
    return spark.createDataFrame(rows, "branch int, name string, label string, parent int, left int, right int, length double, height double, age double, is_leaf boolean, rank int")


def taxa(spark: SparkSession, tree: SpeciesTree) -> DataFrame:
    """branch, leaves below it, and the label made of the first and the last of them."""
    rows = [(e, below, below[0] if len(below) == 1 else f"{below[0]}-{below[-1]}") for e, below in enumerate(tree.below())]
    return spark.createDataFrame(rows, "branch int, leaves array<string>, label string")


def with_missing(branch_rows: DataFrame, fractions: DataFrame) -> DataFrame:
    """Branches with the fraction of genes missing: 0 for inner branches and species not listed."""
    f = F.broadcast(fractions.select(F.col("species").alias("name"), "fraction"))
    return branch_rows.join(f, "name", "left").withColumn("fraction", F.when(F.col("is_leaf"), F.coalesce("fraction", F.lit(0.0))).otherwise(0.0))


def dated_ancestors(branch_rows: DataFrame) -> DataFrame:
    """(branch, other) of every branch and those that end before it begins: older nodes no transfer may go back to."""
    up = branch_rows.select(F.col("branch").alias("parent"), F.col("height").alias("start"))
    b = branch_rows.join(up, "parent").select("branch", "start")
    o = branch_rows.select(F.col("branch").alias("other"), "height")
    # Both sides are the branches of one tree.
    return b.join(F.broadcast(o), F.col("start") < F.col("height")).select("branch", "other")


def alive_at(branch_rows: DataFrame, times: DataFrame) -> DataFrame:
    """Branches (e, t_begin, t_end) alive at each time t_i: t_end <= t_i < t_begin.

    The range of the times is cut in 256 parts, and branches meet the times of the parts that
    they touch, so it is a join on equal parts whatever the number of times.
    """
    low, high = times.agg(F.min("t_i").cast("double"), F.max("t_i").cast("double")).first()
    if low is None:
        low = high = 0.0
    width = (high - low) / 256 or 1.0
    part = lambda c: F.least(F.greatest(F.floor((F.col(c).cast("double") - low) / width), F.lit(-1)), F.lit(257)).cast("int")
    touched = branch_rows.filter("t_end < t_begin").withColumn("_part", F.explode(F.sequence(part("t_end"), part("t_begin"))))
    met = touched.join(times.withColumn("_part", part("t_i")), "_part")
    return met.filter((F.col("t_end") <= F.col("t_i")) & (F.col("t_i") < F.col("t_begin"))).drop("_part")


def slice_table(spark: SparkSession, tree: SpeciesTree, step: float = 0.005, least: int = 3) -> DataFrame:
    """rank, t_i, time, dt and the branches alive of every sub-slice."""
    rows = []
    for rank, (lo, hi, alive) in enumerate(slices(tree)):
        t = grid(lo, hi, step, least)
        rows += [(rank, i, float(t[i]), float(t[i + 1] - t[i]), [int(b) for b in alive]) for i in range(len(t) - 1)]
    return spark.createDataFrame(rows, "rank int, t_i int, time double, dt double, branches array<int>")


def event_probabilities(branch_rows: DataFrame, delta: float, tau: float, lambda_: float) -> DataFrame:
    """p_s, p_d, p_t, p_l of each branch at rates times its multipliers, where it has any."""
    m = lambda c: F.col(c) if c in branch_rows.columns else F.lit(1.0)
    d, t, l = F.lit(delta) * m("rm_delta"), F.lit(tau) * m("rm_tau"), F.lit(lambda_) * m("rm_lambda")
    total = 1 + d + t + l
    return branch_rows.withColumns({"p_s": 1 / total, "p_d": d / total, "p_t": t / total, "p_l": l / total})


def genes_to_species(leaves: DataFrame, branch_rows: DataFrame, separators: str = "_@", field: int = 0) -> tuple[DataFrame, DataFrame]:
    """Leaves (family, leaf) with their species, and those whose species the tree lacks."""
    import re

    parts = F.split("leaf", "[" + re.escape(separators) + "]+")
    name = F.array_join(F.slice(parts, F.lit(2), F.size(parts)), "_") if field == -1 else F.element_at(parts, field + 1)
    mapped = leaves.withColumn("species", name)
    known = F.broadcast(branch_rows.filter("is_leaf").select(F.col("name").alias("species")))
    return mapped, mapped.join(known, "species", "left_anti")
