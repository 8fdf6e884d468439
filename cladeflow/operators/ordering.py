"""Time-order constraints from transfers, and the ranking of the species tree.

Constraints are rows (older, younger, weight). Extraction, aggregation, cancellation,
classification and scoring are joins and aggregations against the closure of the species
tree, a table of at most branches squared rows; the searches for an order run on the driver
or, for many chains, one seed per row.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cladeflow.functions import newick, ranking
from cladeflow.operators.batches import over_batches
from cladeflow.operators.prefix import with_running
from cladeflow.operators.stored import stored


def branch_table(spark: SparkSession, species: str) -> DataFrame:
    """name, parent, is_leaf, depth and path (the names from the node up to the root) of every node of a labelled species tree."""
    root = newick.parse(species)
    far, path = {id(root): 0.0}, {}
    rows = []
    for n in root.preorder():
        for c in n.children:
            far[id(c)] = far[id(n)] + (c.length or 0.0)
        name = n.name if n.is_leaf else n.label
        up = (n.parent.label or None) if n.parent is not None else None
        path[id(n)] = [name, *(path[id(n.parent)] if n.parent is not None else [])]
        rows.append((name, up, n.is_leaf, far[id(n)], path[id(n)]))
    return spark.createDataFrame(rows, "name string, parent string, is_leaf boolean, depth double, path array<string>")


def closure(branches: DataFrame) -> DataFrame:
    """(above, below) for every node and each of its descendants, itself included, of a tree of any depth.

    Where the branches carry their paths to the root these are exploded. Otherwise each round
    doubles the way that nodes see upwards, with a join of what they see and one of where they
    stand: a tree of depth d takes about log2 d rounds, and no task holds the tree.
    """
    if "path" in branches.columns:
        return branches.select(F.explode("path").alias("above"), F.col("name").alias("below"))
    kind = branches.schema["name"].dataType
    one = stored(branches.select("name", F.col("parent").cast(kind).alias("to")), "branches")
    seen, jump, rounds, n = [one.select(F.col("name").alias("above"), F.col("name").alias("below"))], one.filter("to IS NOT NULL"), 0, one.count()
    while (first := jump.first()) is not None:
        if 1 << rounds > n:
            raise ValueError(f"{first['name']} is among its own ancestors")
        reach = reduce(DataFrame.unionByName, seen)
        seen.append(stored(jump.join(reach, F.col("to") == F.col("below")).select("above", F.col("name").alias("below")), "reach"))
        jump = stored(jump.join(jump.select(F.col("name").alias("_via"), F.col("to").alias("_next")), F.col("to") == F.col("_via")).select("name", F.col("_next").alias("to")), "jump")
        rounds += 1
    return reduce(DataFrame.unionByName, seen)


def transfers(reconciled: DataFrame, least_leaves: int = 5) -> DataFrame:
    """(family, sample_no, donor, recipient) of every transfer label in trees of more than least_leaves leaves."""
    leaves = F.size(F.split("newick", ","))
    label = F.explode(F.regexp_extract_all("newick", F.lit(r"T@([^.(),:;]+->[^.(),:;]+)"), 1)).alias("t")
    keys = [c for c in ("family", "sample_no") if c in reconciled.columns]
    one = reconciled.filter(leaves > least_leaves).select(*keys, label)
    return one.select(*keys, F.split("t", "->")[0].alias("donor"), F.split("t", "->")[1].alias("recipient"))


def transfer_constraints(moves: DataFrame, branches: DataFrame) -> DataFrame:
    """Each transfer says that the donor's parent is older than the recipient, if that is an inner node; weights count them."""
    b = F.broadcast(branches.select(F.col("name").alias("donor"), F.col("parent").alias("older")))
    inner = F.broadcast(branches.filter("NOT is_leaf").select(F.col("name").alias("recipient")))
    keys = [c for c in ("family",) if c in moves.columns]
    g = moves.join(b, "donor").filter("older IS NOT NULL").join(inner, "recipient").groupBy(*keys, "older", F.col("recipient").alias("younger"))
    return g.agg(F.count(F.lit(1)).cast("double").alias("weight"))


def reconciliation_constraints(reconciled: DataFrame, branches: DataFrame, least_leaves: int = 5) -> DataFrame:
    """Constraints between speciations on either side of transfers in trees sampled by the undated model.

    Above a transfer the nearest speciation on the donor's lineage, below it the nearest on
    the recipient's: the former is older, if the latter is an inner node.
    """
    schema = "family string, older string, younger string"

    def walk(text: str) -> list[tuple[str, str]]:
        root = newick.parse(text)
        if len(root.leaves()) <= least_leaves:
            return []
        out = []
        # A label lists what befell a lineage from the youngest to the oldest; here the oldest comes first.
        marks = {id(n): [e for e in (n.label if not n.is_leaf else n.name[n.name.find(".") :] if "." in n.name else "").split(".") if e][::-1] for n in root.preorder()}
        plain = lambda e: not e.startswith(("T@", "D@"))
        for n in root.preorder():
            own = marks[id(n)]
            for k, e in enumerate(own):
                if not e.startswith("T@"):
                    continue
                donor, recipient = e[2:].split("->")
                above = next((x for x in reversed(own[:k]) if plain(x)), None)
                up = n.parent
                while above is None and up is not None:
                    above = next((x for x in reversed(marks[id(up)]) if plain(x)), None)
                    up = up.parent
                below = next((x for x in own[k + 1 :] if plain(x)), None)
                if below is None:
                    for c in n.children:
                        first = next((x for x in marks[id(c)]), None)
                        if first == recipient:
                            below = first
                if above is not None and below is not None:
                    out.append((above, below))
        return out

    def run(batches):
        for pdf in batches:
            rows = [(f, a, b) for f, t in zip(pdf["family"], pdf["newick"]) for a, b in walk(t)]
            yield pd.DataFrame(rows, columns=["family", "older", "younger"])

    rows = reconciled.select("family", "newick").mapInPandas(run, schema)
    inner = F.broadcast(branches.filter("NOT is_leaf").select(F.col("name").alias("younger")))
    return rows.join(inner, "younger").groupBy("family", "older", "younger").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def total(constraints: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Summed weights of equal constraints."""
    return constraints.groupBy(*by, "older", "younger").agg(F.sum("weight").alias("weight"))


def cancel(constraints: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Of two opposite constraints the heavier keeps the difference and the lighter goes; equal ones go both."""
    swapped = constraints.select(*by, F.col("older").alias("younger"), F.col("younger").alias("older"), F.col("weight").alias("_opposite"))
    met = constraints.join(swapped, [*by, "older", "younger"], "left").withColumn("weight", F.col("weight") - F.coalesce("_opposite", F.lit(0.0))).drop("_opposite")
    return met.filter("weight > 0")


def supported(constraints: DataFrame, n_samples: int, least: float = 0.05, branches: DataFrame | None = None) -> DataFrame:
    """Constraints as shares of samples, above a least support; with branches, the distance between the two nodes too."""
    out = constraints.withColumn("support", F.col("weight") / F.lit(float(n_samples))).filter(F.col("support") > least)
    if branches is None:
        return out
    c = closure(branches)
    shared = c.alias("a").join(c.alias("b"), F.col("a.above") == F.col("b.above")).join(branches.alias("t"), F.col("t.name") == F.col("a.above"))
    top = shared.groupBy(F.col("a.below").alias("older"), F.col("b.below").alias("younger")).agg(F.max("t.depth").alias("_top"))
    d = branches.select(F.col("name").alias("older"), F.col("depth").alias("_d1")), branches.select(F.col("name").alias("younger"), F.col("depth").alias("_d2"))
    return out.join(top, ["older", "younger"], "left").join(d[0], "older", "left").join(d[1], "younger", "left").withColumn("distance", F.col("_d1") + F.col("_d2") - 2 * F.col("_top")).drop("_top", "_d1", "_d2")


def cut_light(constraints: DataFrame, share: float) -> DataFrame:
    """Without the lightest constraints that together make up a share of all weight.

    A constraint goes if those lighter than it (ties by name) weigh less than the share; running
    sums go over ranges, so no task sorts all.
    """
    total_ = constraints.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w")).first()["w"]
    met = with_running(constraints, [F.col("weight"), F.col("older"), F.col("younger")], {"_before": "weight"})
    return met.filter(F.col("_before") >= share * total_).select(constraints.columns)


def classify(constraints: DataFrame, branches: DataFrame) -> DataFrame:
    """Each constraint with its class: self, to_descendant, to_leaf, from_leaf, to_ancestor or informative."""
    c = closure(branches)
    # Both directions come from one pass over the closure.
    ways = F.array(F.struct(F.col("above").alias("older"), F.col("below").alias("younger"), F.lit(True).alias("down"), F.lit(False).alias("up")), F.struct(F.col("below").alias("older"), F.col("above").alias("younger"), F.lit(False).alias("down"), F.lit(True).alias("up")))
    related = c.select(F.explode(ways).alias("w")).select("w.*").groupBy("older", "younger").agg(F.max("down").alias("_down"), F.max("up").alias("_up"))
    leaf = branches.filter("is_leaf")
    met = constraints.join(related, ["older", "younger"], "left")  # up to branches squared rows, so no side is named to be sent to all
    met = met.join(F.broadcast(leaf.select(F.col("name").alias("younger"), F.lit(True).alias("_to_leaf"))), "younger", "left")
    met = met.join(F.broadcast(leaf.select(F.col("name").alias("older"), F.lit(True).alias("_from_leaf"))), "older", "left")
    kind = (
        F.when(F.col("older") == F.col("younger"), "self").when(F.col("_down"), "to_descendant").when(F.col("_to_leaf"), "to_leaf").when(F.col("_from_leaf"), "from_leaf").when(F.col("_up"), "to_ancestor").otherwise("informative")
    )
    return met.withColumn("class", kind).select(*constraints.columns, "class")


def informative(constraints: DataFrame, branches: DataFrame) -> DataFrame:
    return classify(constraints, branches).filter("class = 'informative'").drop("class").orderBy(F.desc("weight"), "older", "younger")


def order_table(spark: SparkSession, order: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(order)), "place int, name string")


def order_value(constraints: DataFrame, order: DataFrame) -> DataFrame:
    """One row: the weight that an order (place, name) breaks and its share of all."""
    a = F.broadcast(order.select(F.col("name").alias("older"), F.col("place").alias("_a")))
    b = F.broadcast(order.select(F.col("name").alias("younger"), F.col("place").alias("_b")))
    met = constraints.join(a, "older", "left").join(b, "younger", "left")
    broken = F.sum(F.when(F.col("_a") > F.col("_b"), F.col("weight")).otherwise(0.0))
    return met.agg(broken.alias("violated"), (broken / F.sum("weight")).alias("share"))


def conflicting(constraints: DataFrame, order: DataFrame) -> DataFrame:
    """The constraints that an order breaks, heaviest first."""
    a = F.broadcast(order.select(F.col("name").alias("older"), F.col("place").alias("_a")))
    b = F.broadcast(order.select(F.col("name").alias("younger"), F.col("place").alias("_b")))
    return constraints.join(a, "older").join(b, "younger").filter("_a > _b").drop("_a", "_b").orderBy(F.desc("weight"), "older", "younger")


def partial_order(constraints: DataFrame, order: DataFrame) -> DataFrame:
    """The constraints that an order keeps: with the tree's branches, what is known of it."""
    a = F.broadcast(order.select(F.col("name").alias("older"), F.col("place").alias("_a")))
    b = F.broadcast(order.select(F.col("name").alias("younger"), F.col("place").alias("_b")))
    return constraints.join(a, "older").join(b, "younger").filter("_a < _b").drop("_a", "_b")


def kendall(one: DataFrame, two: DataFrame) -> DataFrame:
    """One row: inversions between two orders (place from 0 or more, name), in n log n rows.

    Two places in the second order differ first at some binary digit; among the nodes that share
    all higher digits, a node with a 1 there before one with a 0 is an inversion.
    """
    both = one.select("name", F.col("place").cast("long").alias("p")).join(two.select("name", F.col("place").cast("long").alias("q")), "name")
    bits = max(1, int(both.agg(F.max("q")).first()[0] or 0).bit_length())
    digits = both.select("p", "q", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("k"))
    at = digits.select("p", "k", F.expr("shiftright(q, k + 1)").alias("high"), F.expr("shiftright(q, k) & 1").alias("one"))
    ones = F.sum("one").over(Window.partitionBy("k", "high").orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    before = at.withColumn("before", F.coalesce(ones, F.lit(0)))
    return before.agg(F.coalesce(F.sum(F.when(F.col("one") == 0, F.col("before"))), F.lit(0)).cast("long").alias("inversions"))


def weights_of(constraints: DataFrame) -> ranking.Weights:
    """Summed constraints as a dict; a species tree bounds their number by branches squared."""
    return {(r["older"], r["younger"]): r["weight"] for r in total(constraints).collect()}


def rank(species: str, constraints: DataFrame, steps: int = 100_000, chains: int = 4, light_share: float = 0.0, temperature: float = 0.001, seed: int = 0) -> dict:
    """Order the inner nodes: heuristics, then local search, chains in parallel. Returns orders, values and the ranked tree."""
    spark = constraints.sparkSession
    r = ranking.Ranking.of(species)
    branches = branch_table(spark, species)
    kept = cut_light(total(constraints), light_share) if light_share else total(constraints)
    weights = weights_of(informative(kept, branches))
    starts = {"input": r.by_depth(), "greedy": ranking.greedy(r, weights), "mixing": ranking.mixing(r, weights)}
    start = min(starts.values(), key=lambda o: ranking.violated(o, weights))

    def run(batches):
        for pdf in batches:
            for k in pdf["id"].tolist():
                names, value = ranking.local_search(r, weights, start, steps, temperature, seed + k)
                yield pd.DataFrame({"chain": [k], "value": [value], "order": [names]})

    found = spark.range(0, chains, 1, chains).mapInPandas(run, "chain long, value double, order array<string>").orderBy("value", "chain").first()
    best = list(found["order"])
    return {"order": best, "value": found["value"], "heuristics": {k: ranking.violated(o, weights) for k, o in starts.items()}, "total": sum(weights.values()), "similarity": ranking.similarity(r, r.by_depth(), best), "tree": ranking.ranked_tree(r, best)}


def random_orders(spark: SparkSession, species: str, constraints: DataFrame, n: int = 1000, seed: int = 0) -> DataFrame:
    """Values of n random orders that the tree allows: draw, value, similarity to the input order; a row each."""
    r = ranking.Ranking.of(species)
    weights = weights_of(informative(constraints, branch_table(spark, species)))
    given = r.by_depth()

    def run(batches):
        for pdf in batches:
            rows = []
            for k in pdf["id"].tolist():
                order = ranking.random_order(r, np.random.default_rng([seed, k]))
                rows.append((k, ranking.violated(order, weights), ranking.similarity(r, given, order)))
            yield pd.DataFrame(rows, columns=["draw", "value", "similarity"])

    return spark.range(n).mapInPandas(run, "draw long, value double, similarity double")


def draw_orders(spark: SparkSession, species: str, n: int, seed: int = 0) -> DataFrame:
    """draw, place, name: n orders of the inner nodes, each equally likely among all that the tree allows; a draw depends on the seed and its number alone."""
    r = ranking.Ranking.of(species)

    def run(batches):
        for pdf in batches:
            for k in pdf["id"].tolist():
                order = ranking.random_order(r, np.random.default_rng([seed, k]))
                yield pd.DataFrame({"draw": k, "place": np.arange(len(order), dtype=np.int32), "name": order})

    return spark.range(n).mapInPandas(run, "draw long, place int, name string")


def order_values(constraints: DataFrame, orders: DataFrame) -> DataFrame:
    """draw, value: the weight that each of many orders (draw, place, name) breaks; constraints on other names count for none."""
    met = orders.withColumnsRenamed({"name": "older", "place": "_a"}).join(total(constraints), "older")
    met = met.join(orders.withColumnsRenamed({"name": "younger", "place": "_b"}), ["draw", "younger"])
    broken = met.groupBy("draw").agg(F.sum(F.when(F.col("_a") > F.col("_b"), F.col("weight")).otherwise(0.0)).alias("value"))
    return orders.select("draw").distinct().join(broken, "draw", "left").select("draw", F.coalesce("value", F.lit(0.0)).alias("value"))


def similarities(species: str, orders: DataFrame, given: DataFrame) -> DataFrame:
    """draw, inversions, similarity of many orders (draw, place, name) to a given one (place, name): 1 for the same order, 0 for one as far off as the tree allows.

    Pairs of nodes are met within each draw: a species tree bounds their number.
    """
    r = ranking.Ranking.of(species)
    most = ranking.inversions(*ranking.extremes(r))
    at = orders.select("draw", "name", "place").join(F.broadcast(given.select("name", F.col("place").alias("_given"))), "name")  # the nodes of one tree
    rows = at.groupBy("draw").agg(F.array_sort(F.collect_list(F.struct("place", "_given"))).alias("_xs"))
    later = lambda x, i: F.size(F.filter(F.slice("_xs", i + 2, F.size("_xs")), lambda y: y["_given"] < x["_given"]))
    count = F.aggregate(F.transform("_xs", later), F.lit(0), lambda a, b: a + b)
    same = F.lit(1.0) if not most else (most - F.col("inversions")) / most
    return rows.select("draw", count.alias("inversions")).withColumn("similarity", same)


def ranked_trees(species: str, orders: DataFrame) -> DataFrame:
    """draw, newick: the species tree with the differences of places as branch lengths, for each of many orders (draw, place, name)."""
    r = ranking.Ranking.of(species)
    rows = orders.groupBy("draw").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("names"))  # the nodes of one tree
    return rows.select("draw", over_batches(lambda names: ranking.ranked_tree(r, list(names)), StringType())("names").alias("newick"))


def p_value(random: DataFrame, value: float) -> DataFrame:
    """One row: the share of random orders that break no more weight."""
    return random.agg(F.avg(F.when(F.col("value") <= value, 1.0).otherwise(0.0)).alias("p_value"))
