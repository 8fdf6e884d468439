"""More queries of the tree engine: node tables, tree edits, species tables, readers and writers, constraints from labels.

Readers are checked on files that the queries write first, from the star schema, to the
shared folder that spark.checkpoint.dir names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeflow import api
from cladeflow.functions import clade_math, newick
from cladeflow.functions.dated_model import DatedRates
from cladeflow.functions.species_tree import coalescent_lengths, read_species_tree
from cladeflow.functions.undated_model import Rates
from cladeflow.operators import ccp, dated, event_tables, ordering, reconcile, scheduling, species, splits, tree_tools
from cladeflow.operators.stored import shared_path
from cladeflow.plans.catalog import CLASS_SQL, CONSTRAINT_SQL, EVENTS_SQL, ORDER, TREE, _constraints, _events, _ORDER_SQL, _split, _with
from cladeflow.plans.forest import FOREST_SQL, forest_trees
from cladeflow.plans.ladder import LADDER_SQL, ladder_trees, mask, table
from cladeflow.plans.registry import query
from cladeflow.sources import readers, writers


def _file(spark, lines: DataFrame) -> str:
    """Write a column of text as one file, in the order given; the files of these queries are small."""
    path = shared_path(spark, "files")
    lines.coalesce(1).write.text(path)
    return path


def _line_file(spark, *lines: str) -> str:
    return _file(spark, spark.createDataFrame([(x,) for x in lines], "value string"))


#: Ladder places: name, and level of the leaf below the root; unit branch lengths.
PLACE_SQL = LADDER_SQL + """, p AS (SELECT CAST(fam AS VARCHAR) AS fam, CAST(obs AS BIGINT) AS tree_no, pos, 'n' || lpad(CAST(nk AS VARCHAR), 2, '0') AS name, nk, CAST(6 - greatest(pos, 2) AS INT) AS level FROM r)"""


# --- trees as tables -----------------------------------------------------------------------


@query(f"WITH {PLACE_SQL} SELECT fam, tree_no, name, level, CAST(level AS DOUBLE) AS depth FROM p")
def leaf_levels(spark, sf_dir):
    n = tree_tools.nodes(ladder_trees(spark, sf_dir)).filter("is_leaf")
    return n.select(F.col("family").alias("fam"), "tree_no", "name", "level", "depth")


@query(f"WITH {PLACE_SQL} SELECT fam, tree_no, CAST(9 AS BIGINT) AS nodes, CAST(5 AS BIGINT) AS leaves, CAST(1 AS BIGINT) AS roots, CAST(sum(level) + 6 AS BIGINT) AS levels FROM p GROUP BY ALL")
def node_counts(spark, sf_dir):
    n = tree_tools.nodes(ladder_trees(spark, sf_dir))
    g = n.groupBy(F.col("family").alias("fam"), "tree_no")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return g.agg(F.count(F.lit(1)).alias("nodes"), count(F.col("is_leaf")).alias("leaves"), count(F.col("parent").isNull()).alias("roots"), F.sum("level").alias("levels"))


@query(f"WITH {PLACE_SQL} SELECT a.fam, a.tree_no, a.name AS leaf, b.name AS sibling FROM p a JOIN p b ON a.fam = b.fam AND a.tree_no = b.tree_no AND a.pos <= 2 AND b.pos <= 2 AND a.pos <> b.pos")
def cherry_siblings(spark, sf_dir):
    n = tree_tools.nodes(ladder_trees(spark, sf_dir))
    kids = tree_tools.children(n).select("family", "tree_no", "child", F.explode("siblings").alias("sibling"))
    leaf = n.filter("is_leaf").select("family", "tree_no", "node", "name")
    one = kids.join(leaf.select("family", "tree_no", F.col("node").alias("child"), F.col("name").alias("leaf")), ["family", "tree_no", "child"])
    two = one.join(leaf.select("family", "tree_no", F.col("node").alias("sibling"), F.col("name").alias("other")), ["family", "tree_no", "sibling"])
    return two.select(F.col("family").alias("fam"), "tree_no", "leaf", F.col("other").alias("sibling"))


@query(f"WITH {PLACE_SQL} SELECT a.fam, a.tree_no, a.name AS one, b.name AS two, CAST(a.level + b.level - 2 * (least(a.level, b.level) - 1) AS DOUBLE) AS distance FROM p a JOIN p b ON a.fam = b.fam AND a.tree_no = b.tree_no AND a.name < b.name")
def leaf_distances(spark, sf_dir):
    n = tree_tools.nodes(ladder_trees(spark, sf_dir))
    leaf = n.filter("is_leaf").select("family", "tree_no", "node", "name")
    a, b = (leaf.select("family", "tree_no", F.col("node").alias(x), F.col("name").alias(y)) for x, y in (("a", "one"), ("b", "two")))
    pairs = a.join(b, ["family", "tree_no"]).filter("one < two")  # the leaves of one tree
    d = tree_tools.last_common_ancestors(n, pairs.select("family", "tree_no", "a", "b"))
    return d.join(pairs, ["family", "tree_no", "a", "b"]).select(F.col("family").alias("fam"), "tree_no", "one", "two", "distance")


@query(f"WITH {PLACE_SQL} SELECT fam, tree_no, CAST(sum(level + 1) + 10 AS BIGINT) AS pairs FROM p GROUP BY ALL")
def ancestor_pairs(spark, sf_dir):
    d = tree_tools.descendants(tree_tools.nodes(ladder_trees(spark, sf_dir)))
    return d.groupBy(F.col("family").alias("fam"), "tree_no").agg(F.count(F.lit(1)).alias("pairs"))


def _leaf_depths(trees: DataFrame) -> DataFrame:
    n = tree_tools.nodes(trees.filter("newick IS NOT NULL"))
    return n.filter("is_leaf").select(F.col("family").alias("fam"), "tree_no", "name", F.round("depth", 9).alias("depth"))


@query(f"WITH {PLACE_SQL}, x AS (SELECT fam, tree_no, pos AS gone FROM p WHERE nk = 5) SELECT fam, tree_no, name, CAST(CASE WHEN gone = 5 THEN level - 1 WHEN gone <= 2 AND pos <= 2 THEN level ELSE level END AS DOUBLE) AS depth FROM p JOIN x USING (fam, tree_no) WHERE nk <> 5")
def remove_leaf(spark, sf_dir):
    trees = ladder_trees(spark, sf_dir).filter(F.col("newick").contains("n05"))
    return _leaf_depths(trees.withColumn("newick", tree_tools.without_leaf(F.col("newick"), "n05")))


@query(f"WITH {PLACE_SQL} SELECT fam, tree_no, name, CAST(4 AS DOUBLE) AS depth FROM p")
def ultrametric(spark, sf_dir):
    return _leaf_depths(ladder_trees(spark, sf_dir).withColumn("newick", tree_tools.stretched(F.col("newick"))))


@query(f"WITH {PLACE_SQL} SELECT DISTINCT fam, tree_no, CAST(3 AS INT) AS n_children FROM p")
def unrooted_children(spark, sf_dir):
    trees = ladder_trees(spark, sf_dir).withColumn("newick", tree_tools.unrooted(F.col("newick")))
    return tree_tools.children(tree_tools.nodes(trees)).filter("node = 0").select(F.col("family").alias("fam"), "tree_no", F.col("n_children").cast("int").alias("n_children")).distinct()


@query(f"WITH {PLACE_SQL} SELECT fam, tree_no, name, CAST(CASE WHEN pos <= 3 THEN 3 WHEN pos = 4 THEN 2 ELSE 1 END + CASE WHEN pos <= 2 THEN 1 ELSE 0 END AS DOUBLE) AS depth, CAST(CASE WHEN pos <= 3 THEN 3 WHEN pos = 4 THEN 2 ELSE 1 END AS INT) AS level FROM p")
def contract_unsupported(spark, sf_dir):
    """The cherry's branch has support 0.2, the others 0.9: the three innermost leaves come to hang from one node."""
    trees = ladder_trees(spark, sf_dir)
    labelled = F.regexp_replace(F.regexp_replace("newick", r"\):1", ")0.9:1"), r"^(\(+[^()]*)\)0\.9", "$1)0.2")
    n = tree_tools.nodes(trees.withColumn("newick", tree_tools.contracted(labelled, 0.5)))
    return n.filter("is_leaf").select(F.col("family").alias("fam"), "tree_no", "name", "depth", "level")


def _next(trees: DataFrame) -> DataFrame:
    later = trees.select("family", (F.col("tree_no") - 1).alias("tree_no"), F.col("newick").alias("later"))
    return trees.join(later, ["family", "tree_no"])


TRIPLET_SQL = """, t AS (SELECT a.fam, a.tree_no, a.name || b.name || c.name AS three, arg_max(z.name, z.pos) AS odd
 FROM p a JOIN p b ON a.fam = b.fam AND a.tree_no = b.tree_no AND a.name < b.name JOIN p c ON c.fam = a.fam AND c.tree_no = a.tree_no AND b.name < c.name
 JOIN p z ON z.fam = a.fam AND z.tree_no = a.tree_no AND z.name IN (a.name, b.name, c.name) GROUP BY ALL)
SELECT x.fam, x.tree_no, count(*) FILTER (x.odd = y.odd) AS same, count(*) AS total FROM t x JOIN t y ON x.fam = y.fam AND x.three = y.three AND y.tree_no = x.tree_no + 1 GROUP BY ALL"""


@query(f"WITH {PLACE_SQL} {TRIPLET_SQL}")
def common_triplets(spark, sf_dir):
    t = _next(ladder_trees(spark, sf_dir))
    return t.select(F.col("family").alias("fam"), "tree_no", tree_tools.triplets(F.col("newick"), F.col("later")).alias("t")).select("fam", "tree_no", "t.same", "t.total")


ROOTED_SQL = """, c AS (SELECT CAST(fam AS VARCHAR) AS fam, CAST(obs AS BIGINT) AS tree_no, unnest([a + b, a + b + c, a + b + c + d]) AS clade FROM w)
SELECT x.fam, x.tree_no, (3 - count(y.clade)) AS distance FROM c x LEFT JOIN c y ON y.fam = x.fam AND y.tree_no = x.tree_no + 1 AND y.clade = x.clade
WHERE (x.fam, x.tree_no + 1) IN (SELECT (fam, tree_no) FROM c) GROUP BY ALL"""


@query(f"WITH {LADDER_SQL} {ROOTED_SQL}")
def rooted_distance(spark, sf_dir):
    t = _next(ladder_trees(spark, sf_dir))
    return t.select(F.col("family").alias("fam"), "tree_no", tree_tools.rooted_distance(F.col("newick"), F.col("later")).cast("long").alias("distance"))


@query(_with("SELECT s.fam, s.obs AS tree_no, s.g, round(bip.cnt / observations, 9) AS support FROM s JOIN bip USING (fam, g) CROSS JOIN o WHERE s.obs % 12 = 0"))
def bootstrap_support(spark, sf_dir):
    trees = ladder_trees(spark, sf_dir)
    got = ccp.support(trees.filter("tree_no % 12 = 0"), trees)
    return got.select(F.col("family").alias("fam"), "tree_no", mask("clade").alias("g"), F.round("support", 9).alias("support"))


TOP_SQL = """, t AS (SELECT fam, obs, string_agg(CAST(g AS VARCHAR), '-' ORDER BY g) AS top FROM s GROUP BY ALL),
n AS (SELECT fam, top, count(*) AS n_trees, min(obs) AS obs FROM t GROUP BY ALL)
SELECT n.fam, n.n_trees, round(n.n_trees / observations, 9) AS share, round(sum(ln(p)), 8) AS log_p FROM n JOIN s ON s.fam = n.fam AND s.obs = n.obs JOIN ccp ON ccp.fam = s.fam AND ccp.g = s.g AND ccp.gp = s.gp AND ccp.gpp = s.gpp CROSS JOIN o WHERE s.g % 2 = 0 GROUP BY n.fam, n.top, n.n_trees, observations"""


@query(_with(TOP_SQL))
def scored_topologies(spark, sf_dir):
    got = ccp.scored_topologies(ladder_trees(spark, sf_dir))
    return got.select(F.col("family").alias("fam"), "n_trees", F.round("share", 9).alias("share"), F.round("log_p", 8).alias("log_p"))


LENGTH_SQL = """, e AS (SELECT fam, obs, unnest([a, b, c, d, e]) AS leaf, unnest([1, 1, 1, 1, 2]) AS len FROM w),
x AS (SELECT fam, leaf AS g, len FROM e UNION ALL SELECT fam, 31 - leaf, len FROM e UNION ALL
 SELECT fam, unnest([a + b, c + d + e, a + b + c, d + e]), 1 FROM w)
SELECT CAST(fam AS VARCHAR) AS fam, CAST(g AS BIGINT) AS g, CAST(sum(len) AS DOUBLE) AS bl_sum FROM x GROUP BY ALL"""


@query(_with(LENGTH_SQL))
def clade_lengths(spark, sf_dir):
    _, facts, _ = _split(spark, sf_dir)
    return splits.bips(facts).select(F.col("family").alias("fam"), mask("clade").alias("g"), "bl_sum")


PRIOR_SCORE_SQL = """, df AS (SELECT * FROM (VALUES (2, 1.0), (3, 3.0), (4, 15.0)) v(k, f)),
d2 AS (SELECT fam, g, gp, gpp, CAST(count(*) AS DOUBLE) AS cnt FROM s WHERE obs % 2 = 0 GROUP BY ALL), b2 AS (SELECT fam, g, CAST(count(*) AS DOUBLE) AS cnt FROM s WHERE obs % 2 = 0 GROUP BY ALL),
n2 AS (SELECT fam, CAST(count(DISTINCT obs) AS DOUBLE) AS n FROM s WHERE obs % 2 = 0 GROUP BY ALL),
z AS (SELECT s.fam, s.obs, coalesce(d2.cnt, 0) AS d, CASE WHEN bit_count(s.g) = 4 THEN n2.n ELSE coalesce(b2.cnt, 0) END AS b, CASE WHEN bit_count(s.g) = 4 OR b2.cnt IS NOT NULL THEN 0.25 ELSE 0 END AS q,
 bit_count(s.g) AS size, t1.f * t2.f * t3.f AS tri, CASE WHEN bit_count(s.g) = 4 THEN 15.0 ELSE b1.f * c1.f END AS bi
 FROM s JOIN n2 USING (fam) LEFT JOIN d2 ON d2.fam = s.fam AND d2.g = s.g AND d2.gp = s.gp AND d2.gpp = s.gpp LEFT JOIN b2 ON b2.fam = s.fam AND b2.g = s.g
 JOIN df t1 ON t1.k = greatest(2, 5 - bit_count(s.g)) JOIN df t2 ON t2.k = greatest(2, bit_count(s.gp)) JOIN df t3 ON t3.k = greatest(2, bit_count(s.gpp))
 JOIN df b1 ON b1.k = greatest(2, 5 - bit_count(s.g)) JOIN df c1 ON c1.k = greatest(2, bit_count(s.g)) WHERE s.obs % 2 = 1 AND s.g % 2 = 0)
SELECT fam, obs AS tree_no, round(sum(ln((d + 0.5 / 15.0 * tri + q / (pow(2.0, size - 1) - 1)) / (b + 0.5 / 15.0 * bi + q))), 8) AS log_p FROM z GROUP BY ALL"""


@query(_with(PRIOR_SCORE_SQL))
def tree_score_priors(spark, sf_dir):
    trees = ladder_trees(spark, sf_dir)
    even, odd = trees.filter("tree_no % 2 = 0"), trees.filter("tree_no % 2 = 1")
    got = ccp.score_trees(odd, splits.split_facts(even), splits.families(even), alpha=0.5, beta=0.25)
    return got.select(F.col("family").alias("fam"), "tree_no", F.round("log_p", 8).alias("log_p"))


@query(f"WITH {PLACE_SQL} SELECT fam, tree_no, string_agg(name, ' ' ORDER BY name) AS leaves FROM p WHERE nk % 2 = 0 AND fam IN (SELECT CAST(n_regionkey AS VARCHAR) FROM nation WHERE n_nationkey % 2 = 0 GROUP BY 1 HAVING count(*) >= 3) GROUP BY ALL")
def keep_leaves(spark, sf_dir):
    """Leaves of even nations; families with fewer than three of them go."""
    kept = splits.keep_leaves(ladder_trees(spark, sf_dir), [f"n{k:02d}" for k in range(0, 25, 2)])
    leaf = _leaf_depths(kept)
    return leaf.groupBy("fam", "tree_no").agg(F.array_join(F.array_sort(F.collect_list("name")), " ").alias("leaves"))


@query(f"""WITH {PLACE_SQL} SELECT 'g' || CAST(nk % 3 AS VARCHAR) AS "group", fam, tree_no, string_agg(name, ' ' ORDER BY name) AS leaves FROM p GROUP BY ALL HAVING count(*) >= 2""")
def group_pruning(spark, sf_dir):
    groups = table(spark, sf_dir, "nation").select(F.concat(F.lit("g"), (F.col("n_nationkey") % 3).cast("string")).alias("group"), F.concat(F.lit("n"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("species"))
    got = splits.keep_groups(ladder_trees(spark, sf_dir), groups)
    n = tree_tools.nodes(got.filter(F.col("newick").contains("(")).withColumn("family", F.concat_ws("/", "group", "family"))).filter("is_leaf")
    g = n.groupBy("family", "tree_no").agg(F.array_join(F.array_sort(F.collect_list("name")), " ").alias("leaves"))
    return g.select(F.split("family", "/")[0].alias("group"), F.split("family", "/")[1].alias("fam"), "tree_no", "leaves")


@query(f"WITH {PLACE_SQL}, y AS (SELECT fam, tree_no, string_agg(name || ':1', '' ORDER BY pos) AS t FROM p GROUP BY ALL), z AS (SELECT *, row_number() OVER (PARTITION BY fam ORDER BY tree_no) AS k FROM y) SELECT fam, CAST(k AS INT) AS tree_no, t AS leaves FROM z WHERE k > 5 AND k % 2 = 0 QUALIFY row_number() OVER (PARTITION BY fam ORDER BY k) <= 20")
def tree_list_reader(spark, sf_dir):
    """Trees written as lists, one file a family, and read with burn-in, thinning and an upper number."""
    trees = ladder_trees(spark, sf_dir)
    out = None
    for k in range(5):
        path = _file(spark, trees.filter(F.col("family") == str(k)).coalesce(1).sortWithinPartitions("tree_no").select(F.col("newick").alias("value")))
        one = readers.tree_samples(spark, path, family=F.lit(str(k)), burnin=5, every=2, until=20)
        out = one if out is None else out.unionByName(one)
    return out.select(F.col("family").alias("fam"), "tree_no", F.array_join(F.regexp_extract_all("newick", F.lit(r"(n\d\d:1)"), 1), "").alias("leaves"))


@query(_with(", t AS (SELECT fam, obs, row_number() OVER (PARTITION BY fam ORDER BY obs) - 1 AS k FROM w) SELECT CAST(fam AS VARCHAR) AS fam, CAST(obs AS BIGINT) AS tree_no FROM t WHERE k >= 10 AND k % 3 = 0"))
def add_filter(spark, sf_dir):
    """Which trees count when they are added to a table."""
    trees = ladder_trees(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("family").orderBy("tree_no")))
    return trees.filter(readers.chosen(F.col("k"), 10, 3, "add")).select(F.col("family").alias("fam"), "tree_no")


@query(_with("SELECT fam, g, gp, gpp, cnt FROM dip"))
def posterior_round_trip(spark, sf_dir):
    """Clade tables written in the tagged text form and read again."""
    trees = ladder_trees(spark, sf_dir)
    path = shared_path(spark, "files")
    texts = writers.posterior_texts(splits.tables(trees))
    texts.select(F.col("text").alias("value")).write.option("lineSep", "\x00").text(path)
    whole = spark.read.text(path, lineSep="\x00").select(F.regexp_extract("value", r"n(\d\d)", 1).alias("k"), F.col("value").alias("text"))
    from cladeflow.sources import posterior_text

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                t = posterior_text.loads(text)
                rank = {x: i for i, x in enumerate(sorted(t.leaves))}
                move = lambda g: sum(1 << rank[x] for i, x in enumerate(t.leaves) if g >> i & 1)  # noqa: E731, B023
                rows += [(min(t.leaves), move(g), *sorted((move(a), move(b))), n) for (g, a, b), n in t.dips.items()]
            yield pd.DataFrame(rows, columns=["leaf", "g", "gp", "gpp", "cnt"])

    got = whole.mapInPandas(run, "leaf string, g long, gp long, gpp long, cnt double")
    first = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("string").alias("fam")).agg(F.min("n_nationkey").alias("k")).select("fam", F.concat(F.lit("n"), F.lpad(F.col("k").cast("string"), 2, "0")).alias("leaf"))
    return got.join(F.broadcast(first), "leaf").select("fam", "g", "gp", "gpp", "cnt")  # five regions


@query("SELECT 's' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS name, CAST(CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey / 100.0 ELSE 0.0 END AS DOUBLE) AS fraction FROM nation")
def fraction_missing(spark, sf_dir):
    """Fractions of missing genes read from a file and given to a species tree's leaves, none being zero."""
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("s"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("name"), "n_nationkey")
    path = _file(spark, nation.filter("n_nationkey % 3 = 0").select(F.concat_ws(":", "name", (F.col("n_nationkey") / 100).cast("string")).alias("value")))
    return species.with_missing(nation.withColumn("is_leaf", F.lit(True)), readers.fraction_missing(spark, path)).select("name", "fraction")


@query(f"WITH {CONSTRAINT_SQL} SELECT older, younger, weight FROM c WHERE weight > 0")
def constraint_reader(spark, sf_dir):
    """Constraint lines written, read and added up."""
    lines = writers.constraint_lines(_constraints(spark, sf_dir).withColumn("family", F.lit("f")))
    path = shared_path(spark, "files")
    lines.write.text(path)
    return readers.constraints(spark, path)


@query("SELECT s_name AS file, s_acctbal + 1000 AS time, CAST(s_suppkey AS BIGINT) AS clades, CAST(s_nationkey AS BIGINT) AS genes, CAST(s_nationkey + 1 AS BIGINT) AS species FROM supplier")
def runtime_reader(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    path = shared_path(spark, "files")
    s.select(F.concat_ws("\t", (F.col("s_acctbal") + 1000).cast("string"), "s_suppkey", "s_nationkey", F.col("s_nationkey") + 1, "s_name").alias("value")).write.text(path)
    return readers.runtimes(spark, path).select("file", "time", "clades", "genes", "species")


@query("SELECT s_name AS file, CAST(s_suppkey % 7 AS INT) AS cpu, s_acctbal + 1000 AS time FROM supplier")
def packing_list(spark, sf_dir):
    """Packing lines written and read."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("file"), F.pmod("s_suppkey", F.lit(7)).cast("int").alias("cpu"), (F.col("s_acctbal") + 1000).alias("time"))
    path = shared_path(spark, "files")
    writers.packing_lines(s).write.text(path)
    return readers.distributed_list(spark, path)


@query("SELECT quantile_disc(s_acctbal + 1000, 0.8) AS bound FROM supplier WHERE s_nationkey > 0.8 * (SELECT max(s_nationkey) FROM supplier)")
def near_universal_bound(spark, sf_dir):
    t = table(spark, sf_dir, "supplier").select((F.col("s_acctbal") + 1000).alias("time"), F.col("s_nationkey").alias("species"))
    return spark.createDataFrame([(scheduling.near_universal_bound(t),)], "bound double")


# --- species tables ------------------------------------------------------------------------

#: The labelled tree of the constraint queries: name, parent, branch length.
SPECIES_SQL = """sp(name, parent, len) AS (VALUES ('a', NULL, 0.0), ('b', 'a', 1.0), ('c', 'b', 1.0), ('d', 'a', 0.5), ('e', 'd', 1.5), ('f', 'd', 0.5), ('l1', 'c', 1.0), ('l2', 'c', 1.0), ('l3', 'b', 2.0), ('l4', 'e', 1.0), ('l5', 'e', 1.0), ('l6', 'f', 1.0), ('l7', 'f', 1.0)),
up AS (WITH RECURSIVE k(name, above, far) AS (SELECT name, name, CAST(0 AS DOUBLE) FROM sp UNION ALL SELECT k.name, sp.parent, k.far + sp.len FROM k JOIN sp ON sp.name = k.above WHERE sp.parent IS NOT NULL) SELECT * FROM k),
ht AS (SELECT above AS name, max(far) AS height FROM up GROUP BY ALL), lf AS (SELECT above AS name, list_sort(list(name)) AS leaves FROM up WHERE name LIKE 'l_' GROUP BY ALL)"""


def _label():
    """The label that a branch has in the tree as given: an inner node's own, else the leaf's name."""
    return F.when(F.col("is_leaf"), F.col("name")).otherwise(F.col("label"))


@query("""WITH c AS (SELECT s_suppkey AS branch, 0.1 * (1 + s_nationkey % 3) AS d, 0.2 * (1 + s_nationkey % 2) AS t, 0.3 AS l FROM supplier)
SELECT branch, round(1 / (1 + d + t + l), 9) AS p_s, round(d / (1 + d + t + l), 9) AS p_d, round(t / (1 + d + t + l), 9) AS p_t, round(l / (1 + d + t + l), 9) AS p_l FROM c""")
def event_probabilities(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("branch"), (1 + F.col("s_nationkey") % 3).alias("rm_delta"), (1 + F.col("s_nationkey") % 2).alias("rm_tau"))
    p = species.event_probabilities(s, 0.1, 0.2, 0.3)
    return p.select("branch", *(F.round(c, 9).alias(c) for c in ("p_s", "p_d", "p_t", "p_l")))


@query("SELECT 's' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS species, count(*) AS genes, c_nationkey >= 20 AS unknown FROM customer GROUP BY ALL")
def genes_to_species(spark, sf_dir):
    """Genes named species_number or species@number; a tree that lacks five species."""
    sep = F.when(F.col("c_custkey") % 2 == 0, "_").otherwise("@")
    leaves = table(spark, sf_dir, "customer").select(F.lit("f").alias("family"), F.concat(F.lit("s"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), sep, F.col("c_custkey").cast("string")).alias("leaf"))
    known = spark.range(20).select(F.concat(F.lit("s"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("name"), F.lit(True).alias("is_leaf"))
    mapped, unknown = species.genes_to_species(leaves, known)
    lost = unknown.select("species").distinct().withColumn("unknown", F.lit(True))
    return mapped.groupBy("species").agg(F.count(F.lit(1)).alias("genes")).join(lost, "species", "left").select("species", "genes", F.coalesce("unknown", F.lit(False)).alias("unknown"))


# --- constraints from labelled trees -------------------------------------------------------


def _reconciled(spark, sf_dir) -> DataFrame:
    """A gene tree a customer: a transfer between two inner branches, an older speciation above it and a younger below."""
    o = table(spark, sf_dir, "customer")
    name = lambda c, n: F.element_at(F.array(*map(F.lit, n)), (F.pmod(c, F.lit(len(n))) + 1).cast("int"))
    donor, recipient = name(F.col("c_custkey"), "bcdef"), name(F.floor(F.col("c_custkey") / 5), "bcdef")
    text = F.concat(F.lit("((x_1,x_2)."), recipient, F.lit(".T@"), donor, F.lit("->"), recipient, F.lit(".b,((x_3,x_4),(x_5,x_6))).a;"))
    return o.select(F.pmod("c_custkey", F.lit(3)).cast("string").alias("family"), F.col("c_custkey").cast("int").alias("sample_no"), donor.alias("donor"), recipient.alias("recipient"), text.alias("newick"))


_REC_SQL = """rc AS (SELECT CAST(c_custkey % 3 AS VARCHAR) AS family, CAST(c_custkey AS INT) AS sample_no, substr('bcdef', CAST(c_custkey % 5 AS INT) + 1, 1) AS donor, substr('bcdef', CAST((c_custkey // 5) % 5 AS INT) + 1, 1) AS recipient FROM customer)"""


@query(f"WITH {_REC_SQL} SELECT * FROM rc")
def transfer_labels(spark, sf_dir):
    return ordering.transfers(_reconciled(spark, sf_dir).drop("donor", "recipient")).select("family", "sample_no", "donor", "recipient")


@query(f"WITH {CONSTRAINT_SQL}, {_REC_SQL} SELECT family, br.parent AS older, recipient AS younger, CAST(count(*) AS DOUBLE) AS weight FROM rc JOIN br ON br.name = donor GROUP BY ALL")
def transfer_constraints(spark, sf_dir):
    return ordering.transfer_constraints(ordering.transfers(_reconciled(spark, sf_dir).drop("donor", "recipient")), ordering.branch_table(spark, TREE))


@query(f"WITH {_REC_SQL} SELECT family, 'b' AS older, recipient AS younger, CAST(count(*) AS DOUBLE) AS weight FROM rc GROUP BY ALL")
def reconciliation_constraints(spark, sf_dir):
    """Labels run from the youngest event to the oldest: b came before the transfer, the recipient's speciation after it."""
    return ordering.reconciliation_constraints(_reconciled(spark, sf_dir), ordering.branch_table(spark, TREE))


@query(f"WITH {CONSTRAINT_SQL}, {SPECIES_SQL}, top AS (SELECT x.name AS older, y.name AS younger, min(x.far + y.far) AS distance FROM up x JOIN up y ON x.above = y.above GROUP BY ALL), n AS (SELECT count(*) AS n FROM orders) SELECT c.older, c.younger, round(weight / n, 9) AS support, round(distance, 9) AS distance FROM c JOIN top USING (older, younger) CROSS JOIN n WHERE weight / n > 0.04")
def supported_constraints(spark, sf_dir):
    n = table(spark, sf_dir, "orders").count()
    got = ordering.supported(ordering.total(_constraints(spark, sf_dir)), n, 0.04, ordering.branch_table(spark, TREE))
    return got.select("older", "younger", F.round("support", 9).alias("support"), F.round("distance", 9).alias("distance"))


@query(f"WITH {CONSTRAINT_SQL}, z AS ({CLASS_SQL}) SELECT older, younger, weight FROM z WHERE class = 'informative'")
def informative_constraints(spark, sf_dir):
    return ordering.informative(ordering.total(_constraints(spark, sf_dir)), ordering.branch_table(spark, TREE))


@query(f"WITH {CONSTRAINT_SQL}, {_ORDER_SQL} SELECT c.* FROM c JOIN od a ON a.name = c.older JOIN od b ON b.name = c.younger WHERE a.place < b.place")
def partial_order(spark, sf_dir):
    return ordering.partial_order(ordering.total(_constraints(spark, sf_dir)), ordering.order_table(spark, list(ORDER)))


# --- trees that grow with the tables --------------------------------------------------------


@query(f"WITH {FOREST_SQL} SELECT fam, g, gp, gpp, cnt FROM fd")
def forest_split_counts(spark, sf_dir):
    d = splits.dips(splits.split_facts(forest_trees(spark, sf_dir)))
    return d.select(F.col("family").alias("fam"), mask("clade").alias("g"), mask("left").alias("gp"), mask("right").alias("gpp"), "cnt")


@query(f"WITH {FOREST_SQL} SELECT fam, g, gp, gpp, round(p, 9) AS p_dip FROM fc")
def forest_ccp(spark, sf_dir):
    trees = forest_trees(spark, sf_dir)
    p = ccp.split_probabilities(splits.split_facts(trees), splits.families(trees))
    return p.select(F.col("family").alias("fam"), mask("clade").alias("g"), mask("left").alias("gp"), mask("right").alias("gpp"), F.round("p_dip", 9).alias("p_dip"))


@query(f"WITH {FOREST_SQL} SELECT fs.fam, fs.obs AS tree_no, round(sum(ln(p)), 6) AS log_p FROM fs JOIN fc USING (fam, g, gp, gpp) WHERE fs.g % 2 = 0 GROUP BY ALL")
def forest_scores(spark, sf_dir):
    trees = forest_trees(spark, sf_dir)
    got = ccp.score_trees(trees, splits.split_facts(trees), splits.families(trees))
    return got.select(F.col("family").alias("fam"), "tree_no", F.round("log_p", 6).alias("log_p"))


@query(f"WITH {FOREST_SQL} SELECT fam, CAST(bit_count(g) AS INT) AS size, count(*) AS clades, sum(cnt) AS seen FROM fb GROUP BY ALL")
def forest_clade_sizes(spark, sf_dir):
    b = splits.bips(splits.split_facts(forest_trees(spark, sf_dir))).filter("cnt IS NOT NULL")
    return b.groupBy(F.col("family").alias("fam"), "size").agg(F.count(F.lit(1)).alias("clades"), F.sum("cnt").alias("seen"))


# --- reports of events ---------------------------------------------------------------------


@query(f"WITH {EVENTS_SQL} SELECT family, sample_no, string_agg(kind || '@' || branch || CASE WHEN other >= 0 THEN '->' || other ELSE '' END, ' ' ORDER BY kind || '@' || branch || CASE WHEN other >= 0 THEN '->' || other ELSE '' END) AS trail FROM e GROUP BY ALL")
def event_trails(spark, sf_dir):
    return event_tables.trails(_events(spark, sf_dir))


@query(f"WITH {EVENTS_SQL}, n(e, name) AS (VALUES (0, 'a(0)'), (1, 'b(1)'), (2, 'c(2)'), (3, 'd(3)'), (4, '4'), (5, '5'), (6, '6')) SELECT x.name AS \"from\", y.name AS \"to\", round(count(*) / 20.0, 9) AS freq FROM e JOIN n x ON x.e = branch JOIN n y ON y.e = other WHERE kind = 'T' GROUP BY ALL")
def transfer_list(spark, sf_dir):
    tree = read_species_tree("((a:1,b:1):1,(c:1,d:1):1);")
    return writers.transfer_list(event_tables.transfer_matrix(_events(spark, sf_dir), 20), tree).withColumn("freq", F.round("freq", 9))


@query(f"WITH {EVENTS_SQL} SELECT family, sample_no, count(*) FILTER (kind = 'D') AS D, count(*) FILTER (kind = 'T') AS T, count(*) FILTER (kind = 'L') AS L, count(*) FILTER (kind = 'S') AS S, count(*) FILTER (kind = 'O') AS O FROM e GROUP BY ALL")
def event_lists(spark, sf_dir):
    e = _events(spark, sf_dir).groupBy("family", "sample_no").agg(F.collect_list(F.struct("kind", "branch", "other")).alias("events")).withColumn("newick", F.lit(""))
    chain = spark.createDataFrame([], "family string, iteration int, delta double, tau double, lambda double, logl double")
    return writers.event_lists(e, chain)[1]


COUNT_TREE_SQL = """, n AS (SELECT family, branch, count(*) FILTER (kind = 'D') / 20.0 AS v FROM (SELECT family, kind, branch FROM e UNION ALL SELECT family, 'R', other FROM e WHERE kind = 'T') GROUP BY ALL),
x AS (SELECT unnest(range(7)) AS branch), f AS (SELECT DISTINCT family FROM e)
SELECT f.family, CAST(x.branch AS INT) AS branch, round(coalesce(n.v, 0), 5) AS length FROM f CROSS JOIN x LEFT JOIN n ON n.family = f.family AND n.branch = x.branch"""


@query(f"WITH {EVENTS_SQL} {COUNT_TREE_SQL}")
def counts_on_tree(spark, sf_dir):
    """Mean duplications as the branch lengths of a species tree."""
    tree = read_species_tree("((a:1,b:1):1,(c:1,d:1):1);")
    got = writers.branch_trees(event_tables.branch_means(_events(spark, sf_dir), 20), tree, "duplications")
    each = got.select("family", F.explode(F.regexp_extract_all("newick", F.lit(r"([a-d0-9]+:[-+.e0-9]+)"), 1)).alias("x"))
    number = F.when(F.split("x", ":")[0].rlike("[a-d]"), F.ascii(F.split("x", ":")[0]) - 97).otherwise(F.split("x", ":")[0].try_cast("int"))
    return each.select("family", number.cast("int").alias("branch"), F.round(F.split("x", ":")[1].cast("double"), 5).alias("length"))


@query("SELECT c_custkey AS k, '((a_1,b_2):1,c_' || c_custkey || ':2);' AS tree FROM customer")
def plain_labels(spark, sf_dir):
    """Reconciled trees without events in their labels."""
    t = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("((a_1.T@3->0,b_2.D@b).4.T@5->4:1,c_"), F.col("c_custkey").cast("string"), F.lit(".7:2).8;")).alias("newick"))
    return event_tables.leaf_labels(t).select("k", F.col("newick").alias("tree"))


# --- models at fixed values: log likelihoods worked out from the formulas in a separate script ---


@query(_with(""", c AS (SELECT fam, CASE WHEN size = 2 THEN g ELSE 31 - g END AS g, cnt FROM bip WHERE size IN (2, 3)),
u AS (SELECT fam, g, max(cnt) AS w FROM c GROUP BY ALL),
best AS (SELECT a.fam, max(a.w + coalesce(b.w, 0)) AS kept FROM u a LEFT JOIN u b ON a.fam = b.fam AND a.g <> b.g AND (a.g & b.g) = 0 GROUP BY a.fam)
SELECT fam, 2 * sum(w) - max(kept) AS changes FROM u JOIN best USING (fam) GROUP BY fam"""))
def parsimony_consensus(spark, sf_dir):
    """On five leaves a tree has two splits; a character changes once on a tree that has its split, else twice."""
    _, facts, fams = _split(spark, sf_dir)
    return ccp.parsimony_consensus(facts, fams).select(F.col("family").alias("fam"), "changes")


@query(_with("SELECT fam, g, gp, gpp, cnt FROM dip"))
def added_tables(spark, sf_dir):
    """A table of the even trees with the odd ones added through the program's function."""
    trees = ladder_trees(spark, sf_dir)
    both = api.add(splits.tables(trees.filter("tree_no % 2 = 0")), trees.filter("tree_no % 2 = 1"))
    d = splits.facts_of(both).filter("left IS NOT NULL")
    return d.groupBy(F.col("family").alias("fam"), mask("clade").alias("g"), mask("left").alias("gp"), mask("right").alias("gpp")).agg(F.sum("cnt").alias("cnt"))
