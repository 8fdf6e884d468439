"""Best and random trees of clade tables as joins over splits, a clade a row, for tables of any size.

The best tree of a clade follows from those of smaller clades, so one job a size serves all
families. Random trees start from a clade drawn by count and grow downwards, all trees a step
at a time: a clade's splits lie in an alias table of equal slots, so a draw is one equi-join
and a comparison, whatever the number of splits. Draws depend on the seed, the family, the
tree and the clade alone. ``ccp.best_trees`` and ``ccp.random_trees`` do the same with a
family a row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeflow.functions.clade_table import unpack_mask
from cladeflow.operators import ccp, splits
from cladeflow.operators.stored import shared_path, stored
from cladeflow.operators.undated_levels import leaf_clades

BEST = "family string, clade binary, log_p double, text string"


def _number(x: Column) -> Column:
    return F.round(x, 6).cast("string")


def _lengths(facts: DataFrame, fams: DataFrame) -> DataFrame:
    """family, clade, length: the mean branch length of every clade."""
    b = splits.bips(facts).join(fams.select("family", "observations"), "family")
    n = F.when(F.col("size") == 1, F.col("observations")).otherwise(F.coalesce("cnt", "observations"))
    return b.select("family", "clade", (F.col("bl_sum") / n).alias("length"))


def best_trees(facts: DataFrame, fams: DataFrame) -> DataFrame:
    """family, newick, log_p: the tree of greatest probability that the splits give, with supports and mean branch lengths.

    A label is the share of its split among all splits of its clade, each with its best parts;
    that of the root the share of its branch. Ties go to the split whose first part comes first.
    A family of one or two leaves has its only tree.
    """
    spark, path = facts.sparkSession, shared_path(facts.sparkSession, "best-trees")
    fams, facts = stored(fams.select("family", "n_leaves", "leaves", "observations"), "families"), stored(facts, "facts")
    lengths = stored(_lengths(facts, fams), "lengths")
    every = stored(ccp.split_probabilities(facts, fams).select("family", "size", "clade", "left", "right", F.log("p_dip").alias("log_p")), "splits")
    leaves = leaf_clades(fams).join(lengths, ["family", "clade"], "left").select("family", "clade", F.lit(0.0).alias("log_p"), F.concat("gene", F.lit(":"), _number(F.coalesce("length", F.lit(0.0)))).alias("text"))
    leaves.write.parquet(f"{path}/size=1")
    done = [1]

    def sides(rows: DataFrame) -> DataFrame:
        best = spark.read.schema(BEST).parquet(*(f"{path}/size={k}" for k in done))
        for c in ("left", "right"):
            rows = rows.join(best.select("family", F.col("clade").alias(c), F.col("log_p").alias(f"_{c}"), F.col("text").alias(f"_{c}_text")), ["family", c])
        return rows.withColumn("_v", F.col("log_p") + F.col("_left") + F.col("_right"))

    first = F.struct(F.round(-F.col("_v"), 9).alias("v"), "left")  # a tree has the same probability from each of its branches, up to rounding
    share = 1 / F.aggregate("_all", F.lit(0.0), lambda s, v: s + F.exp(v - F.col("log_p")))
    pick = [F.max("_v").alias("log_p"), F.collect_list("_v").alias("_all"), F.min_by(F.concat(F.lit("("), "_left_text", F.lit(","), "_right_text", F.lit(")")), first).alias("_text")]
    for size in sorted(r[0] for r in every.select("size").distinct().collect()):  # sizes are at most the leaves of a family
        got = sides(every.filter(F.col("size") == size)).groupBy("family", "clade").agg(*pick)
        got = got.join(lengths, ["family", "clade"], "left")
        text = F.concat("_text", _number(share), F.lit(":"), _number(F.coalesce("length", F.lit(0.0))))
        got.select("family", "clade", "log_p", text.alias("text")).write.parquet(f"{path}/size={size}")
        done.append(size)
    roots = ccp.clade_probabilities(facts, fams).filter("cnt > 0 AND n_leaves > 2").select("family", F.col("clade").alias("left"), F.col("other").alias("right"), F.log("p_bip").alias("log_p"))
    top = sides(roots).groupBy("family").agg(*pick, F.min_by("left", first).alias("clade")).join(lengths, ["family", "clade"], "left")
    text = F.concat("_text", _number(2 * share), F.lit(":"), _number(F.least(F.coalesce("length", F.lit(0.0)), F.lit(0.99))), F.lit(";"))
    few = leaf_clades(fams.filter("n_leaves <= 2")).join(lengths, ["family", "clade"], "left").withColumn("t", F.concat("gene", F.lit(":"), _number(F.coalesce("length", F.lit(0.0)))))
    few = few.groupBy("family", "n_leaves").agg(F.array_join(F.array_sort(F.collect_list("t")), ",").alias("t"), F.min("gene").alias("gene"))
    few = few.select("family", F.when(F.col("n_leaves") == 1, F.concat("gene", F.lit(";"))).otherwise(F.concat(F.lit("("), "t", F.lit(");"))).alias("newick"), F.lit(0.0).alias("log_p"))
    return top.select("family", text.alias("newick"), "log_p").unionByName(few)


ALIAS = "family string, clade binary, slot int, slots int, keep double, left binary, right binary, other_left binary, other_right binary"


def _alias(pdf: pd.DataFrame) -> pd.DataFrame:
    """Equal slots for the options of one clade: each holds its own option below keep, and another above it."""
    pdf = pdf.sort_values("left", ignore_index=True)
    n = len(pdf)
    p = pdf["p"].to_numpy() / pdf["p"].sum() * n
    keep, other = np.ones(n), np.arange(n)
    small, large = [k for k in range(n) if p[k] < 1], [k for k in range(n) if p[k] >= 1]
    while small and large:
        s, l = small.pop(), large[-1]
        keep[s], other[s] = p[s], l
        p[l] -= 1 - p[s]
        if p[l] < 1:
            small.append(large.pop())
    left, right = pdf["left"].to_numpy(), pdf["right"].to_numpy()
    return pd.DataFrame({"family": pdf["family"], "clade": pdf["clade"], "slot": np.arange(n), "slots": n, "keep": keep, "left": left, "right": right, "other_left": left[other], "other_right": right[other]})


def alias_tables(facts: DataFrame, fams: DataFrame) -> DataFrame:
    """The slots of every clade's splits by probability, and of the root's (an empty clade) by the counts of clades."""
    inner = ccp.split_probabilities(facts, fams).select("family", "clade", "left", "right", F.col("p_dip").alias("p"))
    roots = splits.bips(facts).filter("cnt > 0 AND n_leaves > 2").select("family", F.lit(b"").alias("clade"), F.col("clade").alias("left"), F.col("other").alias("right"), F.col("cnt").alias("p"))
    return inner.unionByName(roots).groupBy("family", "clade").applyInPandas(_alias, ALIAS)  # a group is the splits of one clade


def random_splits(facts: DataFrame, fams: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """family, tree_no, clade, left, right: the splits of n trees of each family drawn from its table; the root's clade is empty.

    Families of one or two leaves have no splits.
    """
    tables = stored(alias_tables(facts, fams).repartition("family", "clade"), "alias")
    sizes = tables.filter("slot = 0").select("family", "clade", "slots")
    uniform = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "family", "tree_no", "clade"), F.lit(1 << 52)) / float(1 << 52)
    now = fams.filter("n_leaves > 2").select("family", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("tree_no"), F.lit(b"").alias("clade"))
    path, step = shared_path(facts.sparkSession, "random-trees"), 0
    drawn = "family string, tree_no long, clade binary, left binary, right binary"
    while True:
        placed = now.join(sizes, ["family", "clade"]).select("family", "tree_no", "clade", F.floor(uniform(1) * F.col("slots")).cast("int").alias("slot"), uniform(2).alias("_u"))
        met = placed.join(tables, ["family", "clade", "slot"])
        own = F.col("_u") < F.col("keep")
        met = met.select("family", "tree_no", "clade", F.when(own, F.col("left")).otherwise(F.col("other_left")).alias("left"), F.when(own, F.col("right")).otherwise(F.col("other_right")).alias("right"))
        met.write.parquet(f"{path}/step={step}")
        new = facts.sparkSession.read.schema(drawn).parquet(f"{path}/step={step}")
        step += 1
        if new.isEmpty():
            break
        now = new.select("family", "tree_no", F.explode(F.array("left", "right")).alias("clade"))  # leaves have no slots, and go
    return facts.sparkSession.read.schema(drawn).parquet(*(f"{path}/step={k}" for k in range(step)))


def random_trees(facts: DataFrame, fams: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """family, tree_no, newick: n trees of each family drawn from its table, with unit branch lengths."""
    rows = random_splits(facts, fams, n, seed).groupBy("family", "tree_no").agg(F.collect_list(F.struct("clade", "left", "right")).alias("splits"))  # the splits of one tree
    met = rows.join(fams.select("family", "leaves"), "family")

    def run(batches):
        for pdf in batches:
            out = []
            for family, k, found, leaves in zip(pdf["family"], pdf["tree_no"], pdf["splits"], pdf["leaves"]):
                text = {1 << i: f"{x}:1" for i, x in enumerate(leaves)}
                for s in sorted(found, key=lambda s: unpack_mask(s["clade"]).bit_count() or len(leaves)):
                    a, b = unpack_mask(s["left"]), unpack_mask(s["right"])
                    text[a | b] = f"({text[a]},{text[b]}):1"
                out.append((family, k, text[(1 << len(leaves)) - 1].removesuffix(":1") + ";"))
            yield pd.DataFrame(out, columns=["family", "tree_no", "newick"])

    few = fams.filter("n_leaves <= 2").select("family", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("tree_no"), F.when(F.col("n_leaves") == 1, F.concat(F.col("leaves")[0], F.lit(";"))).otherwise(F.concat(F.lit("("), F.array_join(F.transform("leaves", lambda x: F.concat(x, F.lit(":1"))), ","), F.lit(");"))).alias("newick"))
    return met.mapInPandas(run, "family string, tree_no long, newick string").unionByName(few)
