"""Conditional clade probabilities: tables, scores of trees, counts, best and random trees, consensus."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.functions import newick, parsimony
from cladeflow.functions.clade_math import log_trees_with_clade, log_trees_with_split, log_unrooted
from cladeflow.functions.clade_table import pack_mask, unpack_mask
from cladeflow.operators import splits
from cladeflow.operators.stored import stored
from cladeflow.operators.reconcile import _seeded, map_families
from cladeflow.operators.splits import of_row


def clade_probabilities(facts: DataFrame, fams: DataFrame, alpha: float = 0.0) -> DataFrame:
    """p_bip of every clade seen: its share of the observations, or with alpha the share of alpha more spread over all trees."""
    b = splits.bips(facts).join(fams.select("family", "observations"), "family")
    edge = (F.col("size") == 1) | (F.col("size") == F.col("n_leaves") - 1)
    count = F.when(edge, F.col("observations")).otherwise(F.coalesce("cnt", F.lit(0.0)))
    if alpha > 0:
        prior = alpha * F.exp(log_trees_with_clade(F.col("n_leaves"), F.col("size")) - log_unrooted(F.col("n_leaves")))
        p = (count + prior) / (F.col("observations") + alpha)
    else:
        p = count / F.col("observations")
    return b.withColumn("p_bip", F.when(F.col("n_leaves") < 4, 1.0).otherwise(p))


def split_probabilities(facts: DataFrame, fams: DataFrame, alpha: float = 0.0, beta: float = 0.0) -> DataFrame:
    """p_dip of every split seen, given its clade. One join on (family, clade), along which the facts are already dealt."""
    b = splits.bips(facts).select("family", "clade", F.col("cnt").alias("clade_cnt"))
    d = splits.dips(facts).join(b, ["family", "clade"]).join(fams.select("family", "observations"), "family")
    edge = (F.col("size") == 1) | (F.col("size") == F.col("n_leaves") - 1)
    count = F.when(edge, F.col("observations")).otherwise(F.col("clade_cnt"))
    if alpha > 0 or beta > 0:
        every = log_unrooted(F.col("n_leaves"))
        flat = F.lit(beta) / (F.pow(F.lit(2.0), F.col("size") - 1) - 1)
        top = F.col("cnt") + alpha * F.exp(log_trees_with_split(F.col("n_leaves"), F.col("left_size"), F.col("right_size")) - every) + flat
        p = top / (count + alpha * F.exp(log_trees_with_clade(F.col("n_leaves"), F.col("size")) - every) + beta)
    else:
        p = F.col("cnt") / count
    return d.withColumn("p_dip", F.when(F.col("n_leaves") < 4, 1.0).otherwise(p))


TREE_SPLITS = "family string, tree_no long, n_leaves int, clade binary, left binary, right binary, size int, left_size int, right_size int, first boolean"


def tree_splits(trees: DataFrame) -> DataFrame:
    """The splits of every tree, one row each; first marks clades without the family's first leaf."""
    names_ = [c.split()[0] for c in TREE_SPLITS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for family, k, text in zip(pdf["family"], pdf["tree_no"], pdf["newick"]):
                root = newick.parse(text)
                names = sorted(root.leaf_names())
                n = len(names)
                found, _ = newick.directed_splits(root, {x: i for i, x in enumerate(names)}) if n > 2 else ([], {})
                rows += [(family, k, n, pack_mask(g, n), pack_mask(a, n), pack_mask(b, n), g.bit_count(), a.bit_count(), b.bit_count(), not g & 1) for g, a, b in found]
                if len(rows) >= splits.HELD_SPLITS:
                    yield pd.DataFrame(rows, columns=names_)
                    rows = []
            yield pd.DataFrame(rows, columns=names_)

    return trees.select(F.col("family").cast("string").alias("family"), F.col("tree_no").cast("long").alias("tree_no"), "newick").mapInPandas(run, TREE_SPLITS)


def score_trees(trees: DataFrame, facts: DataFrame, fams: DataFrame, alpha: float = 0.0, beta: float = 0.0) -> DataFrame:
    """family, tree_no, log_p: probability of trees under a table; without priors -inf if a split was never seen.

    A tree's probability is the product over its clades that lack the first leaf; pendant
    branches are certain, so this is the same from whichever branch it is read.
    """
    if alpha > 0 or beta > 0:
        return _score_with_priors(trees, facts, fams, alpha, beta)
    p = split_probabilities(facts, fams).select("family", "clade", "left", "right", "p_dip")
    met = tree_splits(trees).filter("first").join(p, ["family", "clade", "left", "right"], "left")
    each = F.when(F.col("p_dip") > 0, F.log("p_dip")).otherwise(F.lit(float("-inf")))
    return met.groupBy("family", "tree_no").agg(F.sum(each).alias("log_p"))


def _score_with_priors(trees: DataFrame, facts: DataFrame, fams: DataFrame, alpha: float, beta: float) -> DataFrame:
    """As ``score_trees``; unseen splits have what the priors give them, beta only within clades that were seen."""
    d = splits.dips(facts).select("family", "clade", "left", "right", F.col("cnt").alias("d"))
    b = splits.bips(facts).select("family", "clade", F.col("cnt").alias("b"))
    met = tree_splits(trees).filter("first").join(d, ["family", "clade", "left", "right"], "left").join(b, ["family", "clade"], "left").join(fams.select("family", "observations"), "family")
    n, size = F.col("n_leaves"), F.col("size")
    edge = (size == 1) | (size == n - 1)
    every = log_unrooted(n)
    count = F.when(edge, F.col("observations")).otherwise(F.coalesce("b", F.lit(0.0)))
    seen = F.when(edge | F.col("b").isNotNull(), F.lit(beta)).otherwise(0.0)
    top = F.coalesce("d", F.lit(0.0)) + alpha * F.exp(log_trees_with_split(n, F.col("left_size"), F.col("right_size")) - every) + seen / (F.pow(F.lit(2.0), size - 1) - 1)
    p = top / (count + alpha * F.exp(log_trees_with_clade(n, size) - every) + seen)
    each = F.when(n < 4, 0.0).when(p > 0, F.log(p)).otherwise(F.lit(float("-inf")))
    return met.groupBy("family", "tree_no").agg(F.sum(each).alias("log_p"))


def clade_share(trees: DataFrame, facts: DataFrame) -> DataFrame:
    """family, tree_no, share: of a tree's inner clades, how many the table has."""
    b = splits.bips(facts).filter("cnt > 0").select("family", "clade", F.lit(1.0).alias("_seen"))
    met = tree_splits(trees).select("family", "tree_no", "clade").join(b, ["family", "clade"], "left")
    return met.groupBy("family", "tree_no").agg(F.avg(F.coalesce("_seen", F.lit(0.0))).alias("share"))


RECOMPOSED = "family string, tree_no long, clade binary, log_p double"


def recompose(trees: DataFrame, facts: DataFrame, fams: DataFrame) -> DataFrame:
    """family, tree_no, clade, log_p: of every directed edge of every tree, the log of the product of the split probabilities within its clade.

    The splits of all trees meet the table's in one join; then a tree's splits, two for each of
    its edges, pass their products on from small clades to large ones, which runs up and down
    the tree at once. Leaves have 0; a clade with a split that was never seen has -inf.
    """
    p = split_probabilities(facts, fams).select("family", "clade", "left", "right", "p_dip")
    met = tree_splits(trees).join(p, ["family", "clade", "left", "right"], "left")
    each = F.when(F.col("p_dip") > 0, F.log("p_dip")).otherwise(F.lit(float("-inf")))
    rows = met.groupBy("family", "tree_no").agg(F.array_sort(F.collect_list(F.struct("size", "clade", "left", "right", each.alias("log_p")))).alias("splits"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for family, k, found in zip(pdf["family"], pdf["tree_no"], pdf["splits"]):
                sums: dict[bytes, float] = {}
                for s in found:
                    parts = [bytes(s["left"]), bytes(s["right"])]
                    sums[bytes(s["clade"])] = s["log_p"] + sum(sums.setdefault(x, 0.0) for x in parts)
                out += [(family, k, clade, x) for clade, x in sums.items()]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RECOMPOSED.split(", ")])

    return rows.mapInPandas(run, RECOMPOSED)


def compare(one: DataFrame, two: DataFrame) -> DataFrame:
    """Scores of both samples' trees under both samples' tables: family, sample, tree_no, log_p_one, log_p_two.

    Every tree is cut once; both tables are counted from the stored splits, and one join by
    split serves both scores.
    """
    label = lambda t, k: t.select(F.col("family").cast("string").alias("family"), (F.col("tree_no").cast("long") * 2 + k).alias("tree_no"), "newick", (F.col("weight").cast("double") if "weight" in t.columns else F.lit(1.0)).alias("weight"))
    both = label(one, 0).unionByName(label(two, 1))
    rows = tree_splits(both)
    if "weight" in [*one.columns, *two.columns]:
        rows = rows.join(both.select("family", "tree_no", "weight"), ["family", "tree_no"])
    else:
        rows = rows.withColumn("weight", F.lit(1.0))
    rows = stored(rows.withColumn("_of", F.pmod("tree_no", F.lit(2))), "compared")
    split = ["family", "clade", "left", "right"]
    d = rows.groupBy("_of", *split, "size", "n_leaves").agg(F.sum("weight").alias("cnt"))
    b = d.groupBy("_of", "family", "clade").agg(F.sum("cnt").alias("clade_cnt"))
    # Each tree has every clade that lacks one leaf.
    n = d.filter(F.col("size") == F.col("n_leaves") - 1).groupBy("_of", "family").agg((F.sum("cnt") / F.first("n_leaves")).alias("observations"))
    count = F.when(F.col("size") == F.col("n_leaves") - 1, F.col("observations")).otherwise(F.col("clade_cnt"))
    p = d.join(b, ["_of", "family", "clade"]).join(n, ["_of", "family"]).withColumn("p", F.when(F.col("n_leaves") < 4, 1.0).otherwise(F.col("cnt") / count))
    p = p.groupBy(*split).agg(*(F.max(F.when(F.col("_of") == k, F.col("p"))).alias(f"p_{name}") for k, name in enumerate(("one", "two"))))
    each = lambda c: F.when(F.col(c) > 0, F.log(c)).otherwise(F.lit(float("-inf")))
    got = rows.filter("first").join(p, split, "left").groupBy("family", "tree_no", "_of").agg(*(F.sum(each(f"p_{k}")).alias(f"log_p_{k}") for k in ("one", "two")))
    return got.select("family", F.floor(F.col("tree_no") / 2).alias("tree_no"), "log_p_one", "log_p_two", F.when(F.col("_of") == 0, "one").otherwise("two").alias("sample"))


def count_trees(tables: DataFrame) -> DataFrame:
    """family, n_trees decimal(38,0): rooted trees that the splits of each family can be put together to; null beyond 38 digits."""
    got = map_families(tables, lambda row: [(row["family"], str(of_row(row).count_trees()))], "family string, n string")
    return got.select("family", F.expr("try_cast(n as decimal(38,0))").alias("n_trees"), F.col("n").alias("digits"))


def best_trees(tables: DataFrame) -> DataFrame:
    """family, newick, p: the tree of greatest probability of each family, with supports and lengths."""
    return map_families(tables, lambda row: [(row["family"], *of_row(row).best_tree())], "family string, newick string, p double")


def random_trees(tables: DataFrame, n: int, seed: int = 0, alpha: float = 0.0, beta: float = 0.0) -> DataFrame:
    """family, tree_no, newick: n trees drawn from each family's table."""

    def run(row):
        t = of_row(row, alpha, beta)
        return [(row["family"], k, t.random_tree(_seeded(seed, row["family"], k))) for k in range(n)]

    return map_families(tables, run, "family string, tree_no long, newick string")


def prune(facts: DataFrame, fams: DataFrame, keep: list[str], separator: str = "_") -> tuple[DataFrame, DataFrame]:
    """Facts and families of fewer leaves: those whose species (the name before the separator) is listed.

    Clades are cut to the leaves kept, empty ones and whole families go, and equal ones add up.
    Lengths become 1 for each time a clade is seen.
    """
    wanted = set(keep)
    hit = F.filter("leaves", lambda x: F.split(x, separator)[0].isin(sorted(wanted)))
    left = fams.withColumn("_kept", hit).filter(F.size("_kept") > 0)
    rows = facts.drop("n_leaves").join(left.select("family", "leaves"), "family").filter("left IS NOT NULL")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            places: dict[tuple, list[int]] = {}
            for family, leaves, clade, a, b, cnt in zip(pdf["family"], pdf["leaves"], pdf["clade"], pdf["left"], pdf["right"], pdf["cnt"]):
                key = tuple(leaves)
                at = places.setdefault(key, [k for k, x in enumerate(key) if x.split(separator)[0] in wanted])
                n = len(at)
                cut = lambda m: sum(1 << i for i, k in enumerate(at) if unpack_mask(m) >> k & 1)  # noqa: E731, B023
                g, x, y = cut(clade), cut(a), cut(b)
                full = (1 << n) - 1
                if x and y and g != full:
                    x, y = min(x, y), max(x, y)
                    out.append((family, n, pack_mask(g, n), pack_mask(full ^ g, n), g.bit_count(), pack_mask(x, n), pack_mask(y, n), x.bit_count(), y.bit_count(), cnt, cnt))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in splits.FACTS.split(", ")])

    cut = rows.select("family", "leaves", "clade", "left", "right", "cnt").mapInPandas(run, splits.FACTS)
    keys = ["family", "n_leaves", "clade", "other", "size", "left", "right", "left_size", "right_size"]
    new = left.withColumn("leaves", F.col("_kept")).withColumn("n_leaves", F.size("_kept")).drop("_kept")
    return cut.groupBy(*keys).agg(F.sum("cnt").alias("cnt"), F.sum("bl").alias("bl")), new


def scored_topologies(trees: DataFrame) -> DataFrame:
    """family, newick, n_trees, share, log_p: each topology of a sample, how often it was seen and its probability under the sample's table."""
    top = splits.topologies(trees)
    fams = splits.families(trees)
    first = top.select("family", "newick", "n_trees", F.xxhash64("topology").alias("tree_no"))
    scores = score_trees(first, splits.split_facts(trees), fams)
    share = F.col("n_trees") / F.col("all_trees")
    return first.join(scores, ["family", "tree_no"]).join(fams.select("family", F.col("n_trees").alias("all_trees")), "family").select("family", "newick", "n_trees", share.alias("share"), "log_p")


def majority(facts: DataFrame, fams: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Clades, without the first leaf, in more than a share of the trees: family, clade, size, freq."""
    b = splits.bips(facts).filter("cnt > 0").join(fams.select("family", "observations"), "family")
    last_bit = F.conv(F.substring(F.hex("clade"), -1, 1), 16, 10).cast("int") % 2
    return b.filter((last_bit == 0) & (F.col("cnt") > threshold * F.col("observations"))).select("family", "clade", "size", (F.col("cnt") / F.col("observations")).alias("freq"))


def consensus(facts: DataFrame, fams: DataFrame, threshold: float = 0.5) -> DataFrame:
    """family, newick: the majority-rule tree with shares as labels, rooted beside the first leaf."""
    rows = majority(facts, fams, threshold).groupBy("family").agg(F.collect_list(F.struct("clade", "freq")).alias("clades"))
    met = fams.select("family", "leaves").join(rows, "family", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                leaves = list(row["leaves"])
                own = {unpack_mask(c["clade"]): c["freq"] for c in (row["clades"] if row["clades"] is not None else [])}
                out.append((row["family"], newick.write(_nested(leaves, own))))
            yield pd.DataFrame(out, columns=["family", "newick"])

    return met.mapInPandas(run, "family string, newick string")


def _nested(leaves: list[str], clades: dict[int, float]) -> newick.Node:
    nodes: dict[int, newick.Node] = {1 << k: newick.Node(x) for k, x in enumerate(leaves)}
    free = set(nodes)
    for g in sorted((g for g in clades if g.bit_count() > 1), key=lambda g: (g.bit_count(), g)):
        inside = [x for x in sorted(free) if x & g == x]
        node = newick.Node(label=f"{clades[g]:.6g}")
        for x in inside:
            node.add(nodes[x])
            free.discard(x)
        nodes[g] = node
        free.add(g)
    if len(free) == 1:
        return nodes[free.pop()]
    root = newick.Node()
    for x in sorted(free):
        root.add(nodes[x])
    return root


def parsimony_consensus(facts: DataFrame, fams: DataFrame) -> DataFrame:
    """family, newick, changes, bound: the tree on which the sampled clades, weighted by their counts, change least as characters.

    Small families are searched exhaustively, so their bound is the number of changes; larger
    ones by a ratchet, with a bound that no tree is below.
    """
    rows = splits.bips(facts).filter("cnt > 0").groupBy("family").agg(F.collect_list(F.struct("clade", "cnt")).alias("clades"))
    met = fams.select("family", "leaves").join(rows, "family", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                own = {unpack_mask(c["clade"]): c["cnt"] for c in (row["clades"] if row["clades"] is not None else [])}
                root, cost = parsimony.consensus(list(row["leaves"]), own)
                out.append((row["family"], newick.write(root), cost, parsimony.bound(list(row["leaves"]), own, cost)))
            yield pd.DataFrame(out, columns=["family", "newick", "changes", "bound"])

    return met.mapInPandas(run, "family string, newick string, changes double, bound double")


def robinson_foulds(trees: DataFrame) -> DataFrame:
    """family, one, two, distance for the consecutive trees of each family: half the clades that only one of both has."""
    rows = tree_splits(trees).select("family", "tree_no", "clade")
    nxt = rows.select("family", (F.col("tree_no") - 1).alias("tree_no"), "clade", F.lit(1).alias("_b"))
    both = rows.withColumn("_a", F.lit(1)).join(nxt, ["family", "tree_no", "clade"], "full")
    g = both.groupBy("family", "tree_no").agg(F.sum(F.when(F.col("_a").isNull() | F.col("_b").isNull(), 1).otherwise(0)).alias("_d"), F.max("_a").alias("_x"), F.max("_b").alias("_y"))
    return g.filter("_x = 1 AND _y = 1").select("family", F.col("tree_no").alias("one"), (F.col("tree_no") + 1).alias("two"), (F.col("_d") / 2).alias("distance"))


def support(tree: DataFrame, samples: DataFrame) -> DataFrame:
    """Share of the sampled trees of a family that have each clade of its tree."""
    n = samples.groupBy("family").agg(F.count(F.lit(1)).alias("_n"))
    seen = tree_splits(samples).groupBy("family", "clade").agg(F.count(F.lit(1)).alias("_c"))
    own = tree_splits(tree).select("family", "tree_no", "clade")
    return own.join(seen, ["family", "clade"], "left").join(n, "family").select("family", "tree_no", "clade", (F.coalesce("_c", F.lit(0)) / F.col("_n")).alias("support"))
