"""Split counting: from tree samples to clade tables, in one shuffle.

Trees are cut into splits where they are read, equal splits of a batch are added up there,
and one exchange by (family, clade) serves both the counts of splits and of clades.
Clades are binary masks, so a family may have any number of leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from cladeflow.functions import newick
from cladeflow.functions.clade_table import CladeTable, pack_mask, unpack_mask
from cladeflow.operators.batches import over_batches

FACTS = "family string, n_leaves int, clade binary, other binary, size int, left binary, right binary, left_size int, right_size int, cnt double, bl double"
FAMILY = "family string, n_leaves int, leaves array<string>, observations double, n_trees long"


#: Splits and clades that a task adds up before it hands them on; one tree's are held at once.
HELD_SPLITS = 50_000


def _fact_rows(sums: dict[tuple, list[float]], sizes: dict[str, tuple[int, dict[str, int]]]) -> pd.DataFrame:
    rows = []
    for (family, g, a, b), (cnt, bl) in sums.items():
        n = sizes[family][0]
        pair = (pack_mask(a, n), pack_mask(b, n), a.bit_count(), b.bit_count()) if a > 0 else (None, None, 0, 0)
        rows.append((family, n, pack_mask(g, n), pack_mask(((1 << n) - 1) ^ g, n), g.bit_count(), *pair, cnt if a >= 0 else 0.0, bl))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in FACTS.split(", ")])


def _facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        sums: dict[tuple, list[float]] = {}
        sizes: dict[str, tuple[int, dict[str, int]]] = {}
        for family, text, weight in zip(pdf["family"], pdf["newick"], pdf["weight"]):
            root = newick.parse(text)
            names = sorted(root.leaf_names())
            n, index = sizes.setdefault(family, (len(names), {x: k for k, x in enumerate(names)}))
            if n != len(names) or any(x not in index for x in names):
                raise ValueError(f"trees of family {family} have different leaves")
            splits, lengths = newick.directed_splits(root, index) if n > 1 else ([], {1: 1.0})
            if n == 2:
                splits = [(1, 0, 0)]
            for s in splits:
                at = sums.setdefault((family, *s), [0.0, 0.0])
                at[0] += weight
            for g, x in lengths.items():
                at = sums.setdefault((family, g, -1, -1), [0.0, 0.0])
                at[1] += x
            if len(sums) >= HELD_SPLITS:
                yield _fact_rows(sums, sizes)
                sums = {}
        yield _fact_rows(sums, sizes)


def split_facts(trees: DataFrame) -> DataFrame:
    """Counts of splits and sums of branch lengths by clade.

    trees: family, newick and, if there is one, weight. A row has left and right where it is a
    split, and neither where it holds a clade's branch lengths (or a two-leaf tree's count).
    """
    weight = F.col("weight").cast("double") if "weight" in trees.columns else F.lit(1.0)
    rows = trees.select(F.col("family").cast("string").alias("family"), "newick", weight.alias("weight")).mapInPandas(_facts, FACTS)
    keys = ["family", "n_leaves", "clade", "other", "size", "left", "right", "left_size", "right_size"]
    return rows.repartition("family", "clade").groupBy(*keys).agg(F.sum("cnt").alias("cnt"), F.sum("bl").alias("bl"))


def dips(facts: DataFrame) -> DataFrame:
    """Split counts: family, clade, left, right, cnt."""
    return facts.filter("left IS NOT NULL").select("family", "n_leaves", "clade", "size", "left", "right", "left_size", "right_size", "cnt")


def bips(facts: DataFrame) -> DataFrame:
    """Clade counts and branch lengths: family, clade, other, size, cnt, bl_sum; clades never split have a null cnt."""
    g = facts.groupBy("family", "n_leaves", "clade", "other", "size").agg(F.sum("cnt").alias("cnt"), F.sum("bl").alias("bl_sum"))
    return g.withColumn("cnt", F.when(F.col("cnt") > 0, F.col("cnt")))


def leaf_names(tree: str) -> Column:
    """The sorted leaf names of a column of trees; a tree without parentheses is one leaf."""
    names = F.array_sort(F.transform(F.regexp_extract_all(tree, F.lit(r"[(,]\s*([^\s(),:;\[\]]+)"), 1), lambda x: F.regexp_replace(x, "^'|'$", "")))
    return F.when(F.col(tree).contains("("), names).otherwise(F.array(F.trim(F.regexp_replace(tree, "[:;].*", ""))))


def families(trees: DataFrame) -> DataFrame:
    """One row per family: leaves, observations (sum of weights), number of trees and the first tree; trees with other leaves are an error."""
    weight = F.col("weight").cast("double") if "weight" in trees.columns else F.lit(1.0)
    number = F.col("tree_no") if "tree_no" in trees.columns else F.lit(0)
    one = trees.select(F.col("family").cast("string").alias("family"), "newick", weight.alias("w"), number.alias("k"))
    one = one.withColumn("same", F.xxhash64(leaf_names("newick")))
    g = one.groupBy("family").agg(F.sum("w").alias("observations"), F.count(F.lit(1)).alias("n_trees"), F.min_by("newick", F.struct("k", "newick")).alias("constructor"), F.min("same").alias("_low"), F.max("same").alias("_high"))
    leaves = F.when(F.col("_low") == F.col("_high"), leaf_names("constructor")).otherwise(F.raise_error(F.concat(F.lit("different leaves in the trees of family "), F.col("family"))))
    g = g.withColumn("leaves", leaves)
    leaves = F.col("leaves")
    return g.select("family", F.size(leaves).alias("n_leaves"), leaves.alias("leaves"), "observations", "n_trees", "constructor")


def clade_ids(facts: DataFrame) -> DataFrame:
    """Dense clade ids from 1 by size, then leaf set, within each family."""
    w = Window.partitionBy("family").orderBy("size", "clade")
    return bips(facts).select("family", "clade", "size", F.row_number().over(w).alias("clade_id"))


def clade_names(facts: DataFrame, fams: DataFrame, separator: str = " ") -> DataFrame:
    """Each clade with its leaf names, each followed by the separator."""
    rows = bips(facts).select("family", "clade", "size").join(fams.select("family", "leaves"), "family")
    bits = F.reverse(F.hex("clade"))  # hex digits, those of the lowest leaves first
    one = rows.select("family", "clade", "size", "leaves", bits.alias("_bits"), F.explode(F.sequence(F.lit(0), F.size("leaves") - 1)).alias("k"))
    one = one.withColumn("_d", F.expr("cast(conv(substring(_bits, cast(floor(k / 4) as int) + 1, 1), 16, 10) as int)"))
    hit = one.filter(F.expr("(shiftright(_d, k % 4) & 1) = 1")).withColumn("name", F.element_at("leaves", F.col("k") + 1))
    g = hit.groupBy("family", "clade", "size").agg(F.array_sort(F.collect_list("name")).alias("names"))
    return g.withColumn("name", F.concat(F.array_join("names", separator), F.lit(separator)))


def topologies(trees: DataFrame) -> DataFrame:
    """Trees with the same clades count as one topology: family, topology, n_trees, newick of the first."""
    import hashlib

    def topology(text: str) -> str:
        root = newick.parse(text)
        index = {x: k for k, x in enumerate(sorted(root.leaf_names()))}
        splits, _ = newick.directed_splits(root, index)
        key = ",".join(sorted(index)) + "|" + ",".join(str(g) for g in sorted(s[0] for s in splits))
        return hashlib.sha256(key.encode()).hexdigest()

    number = F.col("tree_no") if "tree_no" in trees.columns else F.lit(0)
    rows = trees.select("family", over_batches(topology, StringType())("newick").alias("topology"), "newick", number.alias("k"))
    return rows.groupBy("family", "topology").agg(F.count(F.lit(1)).alias("n_trees"), F.min_by("newick", F.struct("k", "newick")).alias("newick"))


def add(facts: DataFrame, more: DataFrame) -> DataFrame:
    """Two tables' facts as one; counts and lengths add up."""
    keys = [c for c in facts.columns if c not in ("cnt", "bl")]
    return facts.unionByName(more).groupBy(*keys).agg(F.sum("cnt").alias("cnt"), F.sum("bl").alias("bl"))


def add_families(fams: DataFrame, more: DataFrame) -> DataFrame:
    g = fams.unionByName(more).groupBy("family")
    return g.agg(F.first("n_leaves").alias("n_leaves"), F.first("leaves").alias("leaves"), F.sum("observations").alias("observations"), F.sum("n_trees").alias("n_trees"), F.min("constructor").alias("constructor"))


def leaf_census(trees: DataFrame) -> DataFrame:
    """How many families' first trees have each leaf name."""
    return families(trees).select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))


def keep_leaves(trees: DataFrame, keep: list[str], separator: str = "_", least: int = 3) -> DataFrame:
    """Trees without the leaves of species that are not listed; families left with fewer leaves than least go."""
    wanted = set(keep)

    def cut(text: str):
        left = newick.prune(newick.parse(text), lambda x: x.split(separator)[0] in wanted)
        return {"newick": newick.write(left), "n": len(left.leaves())} if left is not None else {"newick": None, "n": 0}

    rows = trees.withColumn("_cut", over_batches(cut, StructType().add("newick", StringType()).add("n", IntegerType()))("newick"))
    low = rows.groupBy("family").agg(F.min("_cut.n").alias("_least")).filter(F.col("_least") >= least).select("family")
    return rows.join(low, "family", "left_semi").withColumn("newick", F.col("_cut.newick")).drop("_cut")


#: Rows of a list of groups at most: it is a list of taxa given by hand, and goes to every task.
MOST_GROUP_ROWS = 1_000_000


def keep_groups(trees: DataFrame, groups: DataFrame, separator: str = "_") -> DataFrame:
    """One cut copy of each tree for each group (group, species): its other leaves are dropped.

    A tree is read once for all groups. Lists of over MOST_GROUP_ROWS rows are refused.
    """
    listed = groups.select("group", "species").distinct().limit(MOST_GROUP_ROWS + 1).collect()
    if len(listed) > MOST_GROUP_ROWS:
        raise ValueError(f"the groups have over {MOST_GROUP_ROWS} rows")
    lists: dict = {}
    for r in listed:
        lists.setdefault(r["group"], set()).add(r["species"])
    kind = groups.schema["group"].dataType

    def cut(text: str):
        root, out = newick.parse(text), []
        for group, species in lists.items():
            left = newick.prune(root, lambda x: x.split(separator)[0] in species)  # noqa: B023, called at once
            if left is not None:
                out.append({"group": group, "newick": newick.write(left)})
        return out

    cuts = over_batches(cut, ArrayType(StructType().add("group", kind).add("newick", StringType())))
    met = trees.withColumn("_cut", F.explode(cuts("newick")))
    return met.select(F.col("_cut.group").alias("group"), *(F.col("_cut.newick").alias(c) if c == "newick" else F.col(c) for c in trees.columns))


def table_of(pdf: pd.DataFrame | dict[str, list], leaves: list[str], observations: float, alpha: float = 0.0, beta: float = 0.0) -> CladeTable:
    """The clade table of one family's facts."""
    bip: dict[int, float] = {}
    dip: dict[tuple[int, int, int], float] = {}
    length: dict[int, float] = {}
    for clade, left, right, cnt, bl in zip(pdf["clade"], pdf["left"], pdf["right"], pdf["cnt"], pdf["bl"]):
        g = unpack_mask(clade)
        if left is not None:
            a, b = sorted((unpack_mask(left), unpack_mask(right)))
            dip[g, a, b] = dip.get((g, a, b), 0.0) + cnt
        if cnt:
            bip[g] = bip.get(g, 0.0) + cnt
        length[g] = length.get(g, 0.0) + bl
    return CladeTable(list(leaves), float(observations), bip, dip, length, alpha, beta)


TABLES = "family string, n_leaves int, leaves array<string>, observations double, n_trees long, constructor string, facts array<struct<clade:binary,left:binary,right:binary,cnt:double,bl:double>>"


def tables(trees: DataFrame) -> DataFrame:
    """One row per family with its whole table nested, the unit that grouped models work on."""
    return nest(split_facts(trees), families(trees))


def nest(facts: DataFrame, fams: DataFrame) -> DataFrame:
    rows = facts.groupBy("family").agg(F.collect_list(F.struct("clade", "left", "right", "cnt", "bl")).alias("facts"))
    return fams.join(rows, "family")


def clade_size(clade: Column) -> Column:
    """The number of leaves of a clade."""
    return F.aggregate(F.sequence(F.lit(1), F.length(clade)), F.lit(0), lambda n, k: n + F.bit_count(_byte(clade, k)))


def _byte(clade: Column, k: Column) -> Column:
    return F.conv(F.hex(F.substring(clade, k, F.lit(1))), 16, 10).cast("int")


def complement(clade: Column, n_leaves: Column) -> Column:
    """The clade of all other leaves."""
    whole = lambda k: F.when(k == 1, F.pow(F.lit(2.0), (n_leaves - 1) % 8 + 1).cast("int") - 1).otherwise(255)
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(1), F.length(clade)), lambda k: F.lpad(F.hex(whole(k) - _byte(clade, k)), 2, "0")), ""))


def facts_of(tables_: DataFrame) -> DataFrame:
    """The facts of nested tables again, as ``split_facts`` gives them."""
    one = tables_.select("family", "n_leaves", F.explode("facts").alias("f")).select("family", "n_leaves", "f.*")
    size = lambda c: F.when(F.col(c).isNotNull(), clade_size(F.col(c))).otherwise(0)
    other = complement(F.col("clade"), F.col("n_leaves"))
    return one.select("family", "n_leaves", "clade", other.alias("other"), size("clade").alias("size"), "left", "right", size("left").alias("left_size"), size("right").alias("right_size"), "cnt", "bl")


def of_row(row, alpha: float = 0.0, beta: float = 0.0) -> CladeTable:
    """The clade table of a nested row (a dict or pandas row)."""
    names = ("clade", "left", "right", "cnt", "bl")
    return table_of({k: [f[k] for f in row["facts"]] for k in names}, list(row["leaves"]), row["observations"], alpha, beta)
