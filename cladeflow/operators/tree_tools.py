"""Trees as node tables and column functions that edit trees."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructType

from cladeflow.functions import newick
from cladeflow.functions.clade_table import rooted_topologies
from cladeflow.functions.species_tree import coalescent_lengths, read_species_tree
from cladeflow.operators import ccp
from cladeflow.operators.batches import over_batches

NODES = "family string, tree_no long, node int, parent int, name string, label string, length double, is_leaf boolean, depth double, level int, path array<int>, tags map<string,string>"

#: Node rows, or names in lists of leaves, that a task holds before it hands them on; one tree's are held at once.
HELD_ROWS, HELD_NAMES = 20_000, 200_000


def _node_rows(text: str) -> list[tuple]:
    root = newick.parse(text)
    order = {id(n): k for k, n in enumerate(root.preorder())}
    far, level, path, rows = {id(root): 0.0}, {id(root): 0}, {}, []
    for n in root.preorder():
        path[id(n)] = [order[id(n)], *(path[id(n.parent)] if n.parent is not None else [])]
        for c in n.children:
            far[id(c)], level[id(c)] = far[id(n)] + (c.length or 0.0), level[id(n)] + 1
        rows.append((order[id(n)], order[id(n.parent)] if n.parent is not None else None, n.name if n.is_leaf else None, n.label or None, n.length, n.is_leaf, far[id(n)], level[id(n)], path[id(n)], n.tags))
    return rows


def nodes(trees: DataFrame) -> DataFrame:
    """Every node of every tree (family, tree_no, newick), numbered from the root in the order written; path has the numbers from the node up to the root."""

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in NODES.split(", ")])
        out["parent"] = out["parent"].astype("Int32")
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for f, k, t in zip(pdf["family"], pdf["tree_no"], pdf["newick"]):
                rows += [(f, k, *r) for r in _node_rows(t)]
                if len(rows) >= HELD_ROWS:
                    yield frame(rows)
                    rows = []
            yield frame(rows)

    return trees.select(F.col("family").cast("string").alias("family"), F.col("tree_no").cast("long").alias("tree_no"), "newick").mapInPandas(run, NODES)


def children(node_rows: DataFrame) -> DataFrame:
    """family, tree_no, node, child, number of children and, for each child, its siblings."""
    kids = node_rows.filter("parent IS NOT NULL").groupBy("family", "tree_no", "parent").agg(F.array_sort(F.collect_list("node")).alias("children"))
    one = kids.select("family", "tree_no", F.col("parent").alias("node"), F.size("children").alias("n_children"), "children", F.explode("children").alias("child"))
    return one.withColumn("siblings", F.array_remove("children", F.col("child"))).drop("children")


def descendants(node_rows: DataFrame) -> DataFrame:
    """(family, tree_no, above, below): each node with all nodes below it and itself, from the nodes' paths."""
    return node_rows.select("family", "tree_no", F.explode("path").alias("above"), F.col("node").alias("below"))


def taxa(node_rows: DataFrame) -> DataFrame:
    """family, tree_no, node, leaves, label, height: the leaves below each node, by name, a label of the first and the last, and the way down to the deepest."""
    keys = ["family", "tree_no"]
    rows = node_rows.select(*keys, F.explode("path").alias("_at"), "node", "parent", "name", "is_leaf", "depth")
    own = lambda c: F.max(F.when(F.col("node") == F.col("_at"), F.col(c))).alias(c)
    leaf = lambda c: F.when(F.col("is_leaf"), F.col(c))
    # One pass: each node is met by itself, and by the leaves below it, as many as a tree has.
    g = rows.groupBy(*keys, "_at").agg(F.array_sort(F.collect_list(leaf("name"))).alias("leaves"), F.max(leaf("depth")).alias("_deep"), own("parent"), own("is_leaf"), own("depth"))
    first, last = F.col("leaves")[0], F.element_at("leaves", -1)
    label = F.when(first == last, first).otherwise(F.concat_ws("-", first, last)).alias("label")
    return g.select(*keys, F.col("_at").alias("node"), "parent", "is_leaf", "leaves", label, (F.col("_deep") - F.col("depth")).alias("height"))


TAXA = "family string, tree_no long, node int, parent int, is_leaf boolean, leaves array<string>, label string, height double"
_TAXA_ARROW = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.string()), pa.string(), pa.float64()]


def _taxa_rows(text: str) -> list[tuple]:
    root = newick.parse(text)
    every = list(root.preorder())
    number = {id(n): k for k, n in enumerate(every)}
    far = [0.0] * len(every)
    for k, n in enumerate(every[1:], 1):
        far[k] = far[number[id(n.parent)]] + (n.length or 0.0)
    below: list[list[str]] = [[n.name] if n.is_leaf else [] for n in every]
    deep = [far[k] if n.is_leaf else float("-inf") for k, n in enumerate(every)]
    rows = []
    for k in range(len(every) - 1, -1, -1):  # nodes below have higher numbers
        n, names = every[k], below[k]
        names.sort()
        up = None
        if n.parent is not None:
            up = number[id(n.parent)]
            below[up] += names
            deep[up] = max(deep[up], deep[k])
        rows.append((k, up, n.is_leaf, names, names[0] if names[0] == names[-1] else f"{names[0]}-{names[-1]}", deep[k] - far[k]))
    return rows


def tree_taxa(trees: DataFrame) -> DataFrame:
    """The taxa of trees (family, tree_no, newick), as ``taxa`` gives them of their nodes, without a shuffle.

    A tree lies in one row, so its nodes need not meet again; ``taxa`` is for node tables that were edited.
    """
    names = [c.split()[0] for c in TAXA.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_TAXA_ARROW)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            rows: list[tuple] = []
            held = 0
            for f, k, t in zip(*(c.to_pylist() for c in given.columns)):
                for r in _taxa_rows(t):
                    rows.append((f, k, *r))
                    held += len(r[3])
                if held >= HELD_NAMES:
                    yield batch(rows)
                    rows, held = [], 0
            yield batch(rows)

    return trees.select(F.col("family").cast("string").alias("family"), F.col("tree_no").cast("long").alias("tree_no"), "newick").mapInArrow(run, TAXA)


def ranks(taxa_rows: DataFrame) -> DataFrame:
    """family, tree_no, node, rank: the inner nodes of each tree by height, the lowest 1; equal heights by label."""
    return ranked(taxa_rows).drop("height")


def ranked(taxa_rows: DataFrame) -> DataFrame:
    """``ranks`` with the height of each node; lists of leaves stay behind."""
    w = Window.partitionBy("family", "tree_no").orderBy("height", "label", "_n")
    inner = taxa_rows.filter("NOT is_leaf").select("family", "tree_no", "node", "height", "label", F.size("leaves").alias("_n"))
    return inner.select("family", "tree_no", "node", F.row_number().over(w).alias("rank"), "height")


def dated_pairs(taxa_rows: DataFrame) -> DataFrame:
    """family, tree_no, node, other: each node with those that end before it begins: they are higher than its parent."""
    keys = ["family", "tree_no"]
    up = taxa_rows.select(*keys, F.col("node").alias("parent"), F.col("height").alias("_start"))
    own = taxa_rows.select(*keys, "node", "parent").join(up, [*keys, "parent"])
    other = taxa_rows.select(*keys, F.col("node").alias("other"), F.col("height").alias("_end"))
    return own.join(other, keys).filter("_start < _end").select(*keys, "node", "other")  # pairs within one tree


def time_slices(taxa_rows: DataFrame, step: float, least: int) -> DataFrame:
    """family, tree_no, rank, t_i, time, dt of every sub-slice: from each inner node up to the next, in equal steps of at most step, least at least; the slice of rank 0 begins at the leaves.

    Ages are heights, as shares of the root's.
    """
    own = Window.partitionBy("family", "tree_no")
    inner = taxa_rows.filter("NOT is_leaf").select("family", "tree_no", F.col("height").alias("_h"), F.max("height").over(own).alias("_top"))
    ages = inner.select("family", "tree_no", (F.col("_h") / F.col("_top")).alias("upper")).withColumn("rank", F.row_number().over(own.orderBy("upper")) - 1)
    ages = ages.withColumn("lower", F.coalesce(F.lag("upper").over(own.orderBy("upper", "rank")), F.lit(0.0))).withColumn("_n", F.greatest(F.ceil(F.round((F.col("upper") - F.col("lower")) / step, 9)), F.lit(least)).cast("int"))
    rows = ages.select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("t_i"))
    dt = (F.col("upper") - F.col("lower")) / F.col("_n")
    return rows.select("family", "tree_no", "rank", "t_i", (F.col("lower") + F.col("t_i") * dt).alias("time"), dt.alias("dt"))


def without_subtrees(node_rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Nodes of trees without those at or below the nodes (family, tree_no, node) that go."""
    keys = ["family", "tree_no"]
    hit = node_rows.select(*keys, "node", F.explode("path").alias("_above")).join(gone.select(*keys, F.col("node").alias("_above")), [*keys, "_above"], "left_semi")
    return node_rows.join(hit.select(*keys, "node"), [*keys, "node"], "left_anti")


def last_common_ancestors(node_rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (family, tree_no, a, b) with their last common ancestor and the distance between them."""
    d = descendants(node_rows)
    up = pairs.join(d.select("family", "tree_no", "above", F.col("below").alias("a")), ["family", "tree_no", "a"]).join(d.select("family", "tree_no", "above", F.col("below").alias("b")), ["family", "tree_no", "b", "above"])
    deep = node_rows.select("family", "tree_no", F.col("node").alias("above"), "level", "depth")
    top = up.join(deep, ["family", "tree_no", "above"]).groupBy("family", "tree_no", "a", "b").agg(F.max_by("above", "level").alias("ancestor"), F.max_by("depth", "level").alias("_top"))
    for end in ("a", "b"):
        top = top.join(node_rows.select("family", "tree_no", F.col("node").alias(end), F.col("depth").alias(f"_{end}")), ["family", "tree_no", end])
    return top.select("family", "tree_no", "a", "b", "ancestor", (F.col("_a") + F.col("_b") - 2 * F.col("_top")).alias("distance"))


def edited(tree: Column, edit: Callable[[newick.Node], newick.Node | None]) -> Column:
    """A Newick column put through a function on trees; null where it returns none."""

    def run(text: str):
        if text is None:
            return None
        got = edit(newick.parse(text))
        return newick.write(got) if got is not None else None

    return over_batches(run, StringType())(tree)


def unrooted(tree: Column) -> Column:
    return edited(tree, newick.unroot)


def rerooted(tree: Column, leaf: str) -> Column:
    return edited(tree, lambda t: newick.reroot(t, leaf))


def without_leaf(tree: Column, leaf: str) -> Column:
    return edited(tree, lambda t: newick.remove_leaf(t, leaf))


def contracted(tree: Column, threshold: float) -> Column:
    return edited(tree, lambda t: newick.contract(t, threshold))


def stretched(tree: Column) -> Column:
    return edited(tree, newick.stretch)


def grafted(tree: Column, moved: str, target: str) -> Column:
    return edited(tree, lambda t: newick.graft(t, moved, target))


def triplets(one: Column, two: Column) -> Column:
    """A struct of how many triplets of common leaves two trees resolve alike, and of how many."""

    def run(a: str, b: str):
        return dict(zip(("same", "total"), newick.triplets_shared(newick.parse(a), newick.parse(b))))

    return over_batches(run, StructType().add("same", LongType()).add("total", LongType()))(one, two)


def regrafted(tree: Column, moved: Column, target: Column) -> Column:
    """Trees with one named node moved beside another."""

    def run(text: str, a: str, b: str):
        return newick.write(newick.graft(newick.parse(text), a, b))

    return over_batches(run, StringType())(tree, moved, target)


def interchanged(tree: Column, node: Column) -> Column:
    """The nearest-neighbour interchanges of trees around a named node, as an array of trees."""

    def run(text: str, name: str):
        return [newick.write(t) for t in newick.interchanges(newick.parse(text), name)]

    return over_batches(run, ArrayType(StringType()))(tree, node)


def rooted_clades(tree: Column) -> Column:
    """The clades of rooted trees, leaves too, as one text each: trees with the same are one topology."""
    return over_batches(lambda text: ";".join(sorted(" ".join(r[3]) for r in _taxa_rows(text))), StringType())(tree)


def every_topology(names: Column) -> Column:
    """All rooted binary topologies on arrays of up to eight names, as arrays of trees."""
    return over_batches(lambda x: list(rooted_topologies(list(x))), ArrayType(StringType()))(names)


def coalescent(tree: Column) -> Column:
    """Trees re-dated by the ranks of their nodes: expected coalescent times, the root at 1."""
    return over_batches(lambda text: coalescent_lengths(read_species_tree(text)).numbered(), StringType())(tree)


def rooted_distance(one: Column, two: Column) -> Column:
    """Half the number of rooted clades that only one of two trees has."""

    def run(a: str, b: str):
        return float(newick.robinson_foulds(newick.parse(a), newick.parse(b)))

    return over_batches(run, DoubleType())(one, two)


def support(tree: DataFrame, samples: DataFrame) -> DataFrame:
    """Share of the sampled trees that have each clade of a family's tree."""
    return ccp.support(tree, samples)


def register(spark: SparkSession) -> None:
    """Table functions for SQL: newick_nodes(text) and newick_splits(text)."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="node int, parent int, name string, label string, length double, is_leaf boolean, depth double, level int")
    class NewickNodes:
        def eval(self, text: str):
            for row in _node_rows(text):
                yield row[:-2]

    @udtf(returnType="clade string, part_one string, part_two string")
    class NewickSplits:
        def eval(self, text: str):
            root = newick.parse(text)
            names = sorted(root.leaf_names())
            splits, _ = newick.directed_splits(root, {x: k for k, x in enumerate(names)})
            show = lambda g: ",".join(x for k, x in enumerate(names) if g >> k & 1)
            for g, a, b in splits:
                yield show(g), show(a), show(b)

    spark.udtf.register("newick_nodes", NewickNodes)
    spark.udtf.register("newick_splits", NewickSplits)
