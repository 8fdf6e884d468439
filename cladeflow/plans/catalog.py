"""Registry of the tree-engine queries and their SQL oracles.

Queries run the library's operators on trees, events and constraints derived from the star
schema. Where SQL can express the result, the oracle computes it independently.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeflow.operators.prefix import with_running
from cladeflow.operators import ccp, dated, event_tables, ordering, reconcile, scheduling, simulate, species, splits
from cladeflow.plans.ladder import LADDER_SQL, ladder_trees, mask, table
from cladeflow.plans.registry import ORACLES, QUERIES, query
from cladeflow.plans.undated_sql import loglik_sql


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["split_counts"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from cladeflow.plans import model_queries, table_queries, tree_queries  # noqa: F401, register their own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLES)


def _with(sql: str) -> str:
    return f"WITH {LADDER_SQL} {sql}"


def _split(spark, sf_dir):
    trees = ladder_trees(spark, sf_dir)
    return trees, splits.split_facts(trees), splits.families(trees)


# --- clade tables -------------------------------------------------------------------------


@query(_with("SELECT fam, g, gp, gpp, cnt FROM dip"))
def split_counts(spark, sf_dir):
    _, facts, _ = _split(spark, sf_dir)
    d = splits.dips(facts)
    return d.select(F.col("family").alias("fam"), mask("clade").alias("g"), mask("left").alias("gp"), mask("right").alias("gpp"), "cnt")


@query(_with("SELECT fam, g, CAST(size AS INT) AS size, cnt FROM bip"))
def clade_counts(spark, sf_dir):
    _, facts, _ = _split(spark, sf_dir)
    b = splits.bips(facts).filter("cnt IS NOT NULL")
    return b.select(F.col("family").alias("fam"), mask("clade").alias("g"), "size", "cnt")


@query(_with("SELECT fam, g, gp, gpp, round(p, 9) AS p_dip FROM ccp"))
def ccp_table(spark, sf_dir):
    _, facts, fams = _split(spark, sf_dir)
    p = ccp.split_probabilities(facts, fams)
    return p.select(F.col("family").alias("fam"), mask("clade").alias("g"), mask("left").alias("gp"), mask("right").alias("gpp"), F.round("p_dip", 9).alias("p_dip"))


@query(_with("SELECT fam, g, round(CASE WHEN size = 4 THEN 1.0 ELSE cnt / observations END, 9) AS p_bip FROM bip CROSS JOIN o"))
def clade_probability(spark, sf_dir):
    _, facts, fams = _split(spark, sf_dir)
    p = ccp.clade_probabilities(facts, fams).filter("cnt IS NOT NULL")
    return p.select(F.col("family").alias("fam"), mask("clade").alias("g"), F.round("p_bip", 9).alias("p_bip"))


PRIOR_SQL = """, df AS (SELECT * FROM (VALUES (2, 1.0), (3, 3.0), (4, 15.0)) v(k, f)),
pr AS (SELECT dip.fam, dip.g, dip.gp, dip.gpp, dip.cnt AS d, bip.cnt AS b, bip.size AS size, o.observations AS n, bit_count(dip.gp) AS s1, bit_count(dip.gpp) AS s2
 FROM dip JOIN bip USING (fam, g) CROSS JOIN o)
SELECT pr.fam, g, gp, gpp, round((d + 0.5 / 15.0 * t1.f * t2.f * t3.f + 0.25 / (pow(2.0, size - 1) - 1)) /
 ((CASE WHEN size = 4 THEN n ELSE b END) + 0.5 / 15.0 * (CASE WHEN size = 4 THEN 15.0 ELSE b1.f * b2.f END) + 0.25), 9) AS p_dip
FROM pr JOIN df t1 ON t1.k = greatest(2, 5 - s1 - s2) JOIN df t2 ON t2.k = greatest(2, s1) JOIN df t3 ON t3.k = greatest(2, s2)
JOIN df b1 ON b1.k = greatest(2, 5 - size) JOIN df b2 ON b2.k = greatest(2, size)"""


@query(f"WITH {LADDER_SQL} {PRIOR_SQL}")
def ccp_prior(spark, sf_dir):
    _, facts, fams = _split(spark, sf_dir)
    p = ccp.split_probabilities(facts, fams, alpha=0.5, beta=0.25)
    return p.select(F.col("family").alias("fam"), mask("clade").alias("g"), mask("left").alias("gp"), mask("right").alias("gpp"), F.round("p_dip", 9).alias("p_dip"))


@query(_with("SELECT s.fam, s.obs AS tree_no, round(sum(ln(p)), 8) AS log_p FROM s JOIN ccp USING (fam, g, gp, gpp) WHERE s.g % 2 = 0 GROUP BY ALL"))
def tree_score(spark, sf_dir):
    trees, facts, fams = _split(spark, sf_dir)
    return ccp.score_trees(trees, facts, fams).select(F.col("family").alias("fam"), "tree_no", F.round("log_p", 8).alias("log_p"))


@query(_with(", half AS (SELECT DISTINCT fam, g FROM s WHERE obs % 2 = 0) SELECT s.fam, s.obs AS tree_no, round(avg(CASE WHEN half.g IS NULL THEN 0.0 ELSE 1.0 END), 9) AS share FROM s LEFT JOIN half ON s.fam = half.fam AND s.g = half.g WHERE s.obs % 2 = 1 GROUP BY ALL"))
def tree_clade_share(spark, sf_dir):
    trees = ladder_trees(spark, sf_dir)
    even, odd = trees.filter("tree_no % 2 = 0"), trees.filter("tree_no % 2 = 1")
    return ccp.clade_share(odd, splits.split_facts(even)).select(F.col("family").alias("fam"), "tree_no", F.round("share", 9).alias("share"))


COUNT_SQL = """, l AS (SELECT DISTINCT fam, CAST(pow(2, k) AS BIGINT) AS g FROM s CROSS JOIN (SELECT unnest(range(5)) AS k)),
n1 AS (SELECT fam, g, CAST(1 AS HUGEINT) AS n FROM l),
n2 AS (SELECT fam, g, count(*) AS n FROM (SELECT DISTINCT fam, g, gp, gpp FROM s) WHERE bit_count(g) = 2 GROUP BY ALL),
u2 AS (SELECT * FROM n1 UNION ALL SELECT * FROM n2),
n3 AS (SELECT d.fam, d.g, sum(x.n * y.n) AS n FROM (SELECT DISTINCT fam, g, gp, gpp FROM s) d JOIN u2 x ON x.fam = d.fam AND x.g = d.gp JOIN u2 y ON y.fam = d.fam AND y.g = d.gpp WHERE bit_count(d.g) = 3 GROUP BY ALL),
u3 AS (SELECT * FROM u2 UNION ALL SELECT * FROM n3),
n4 AS (SELECT d.fam, d.g, sum(x.n * y.n) AS n FROM (SELECT DISTINCT fam, g, gp, gpp FROM s) d JOIN u3 x ON x.fam = d.fam AND x.g = d.gp JOIN u3 y ON y.fam = d.fam AND y.g = d.gpp WHERE bit_count(d.g) = 4 GROUP BY ALL),
u4 AS (SELECT * FROM u3 UNION ALL SELECT * FROM n4)
SELECT x.fam, CAST(sum(x.n * y.n) AS BIGINT) AS n_trees FROM u4 x JOIN u4 y ON x.fam = y.fam AND y.g = 31 - x.g WHERE bit_count(x.g) > bit_count(y.g) GROUP BY ALL"""


@query(f"WITH {LADDER_SQL} {COUNT_SQL}")
def count_amalgamations(spark, sf_dir):
    _, facts, fams = _split(spark, sf_dir)
    return ccp.count_trees(splits.nest(facts, fams)).select(F.col("family").alias("fam"), F.col("n_trees").cast("long").alias("n_trees"))


MPP_SQL = """, q1 AS (SELECT DISTINCT fam, CAST(pow(2, k) AS BIGINT) AS g, 1.0 AS q FROM s CROSS JOIN (SELECT unnest(range(5)) AS k)),
q2 AS (SELECT fam, g, max(p) AS q FROM ccp WHERE bit_count(g) = 2 GROUP BY ALL), v2 AS (SELECT * FROM q1 UNION ALL SELECT * FROM q2),
q3 AS (SELECT c.fam, c.g, max(c.p * x.q * y.q) AS q FROM ccp c JOIN v2 x ON x.fam = c.fam AND x.g = c.gp JOIN v2 y ON y.fam = c.fam AND y.g = c.gpp WHERE bit_count(c.g) = 3 GROUP BY ALL), v3 AS (SELECT * FROM v2 UNION ALL SELECT * FROM q3),
q4 AS (SELECT c.fam, c.g, max(c.p * x.q * y.q) AS q FROM ccp c JOIN v3 x ON x.fam = c.fam AND x.g = c.gp JOIN v3 y ON y.fam = c.fam AND y.g = c.gpp WHERE bit_count(c.g) = 4 GROUP BY ALL), v4 AS (SELECT * FROM v3 UNION ALL SELECT * FROM q4)
SELECT b.fam, round(max(x.q * y.q * CASE WHEN b.size = 4 THEN 1.0 ELSE b.cnt / observations END), 9) AS p FROM bip b CROSS JOIN o JOIN v4 x ON x.fam = b.fam AND x.g = b.g JOIN v4 y ON y.fam = b.fam AND y.g = 31 - b.g GROUP BY ALL"""


@query(f"WITH {LADDER_SQL} {MPP_SQL}")
def mpp_score(spark, sf_dir):
    _, facts, fams = _split(spark, sf_dir)
    return ccp.best_trees(splits.nest(facts, fams)).select(F.col("family").alias("fam"), F.round("p", 9).alias("p"))


@query(_with(", t AS (SELECT fam, obs, string_agg(CAST(g AS VARCHAR), '-' ORDER BY g) AS top FROM s GROUP BY ALL), n AS (SELECT fam, top, count(*) AS n_trees, min(obs) AS first_tree FROM t GROUP BY ALL) SELECT fam, n_trees, first_tree FROM n"))
def topology_counts(spark, sf_dir):
    trees = ladder_trees(spark, sf_dir)
    top = splits.topologies(trees)
    first = trees.select("family", "newick", "tree_no").join(top, ["family", "newick"]).groupBy("family", "topology", "n_trees").agg(F.min("tree_no").alias("first_tree"))
    return first.select(F.col("family").alias("fam"), "n_trees", "first_tree")


@query(_with("SELECT fam, g, gp, gpp, sum(CASE WHEN obs % 2 = 0 THEN 1.0 ELSE 2.5 END) AS cnt FROM s GROUP BY ALL"))
def add_posterior(spark, sf_dir):
    trees = ladder_trees(spark, sf_dir)
    one = splits.split_facts(trees.filter("tree_no % 2 = 0"))
    two = splits.split_facts(trees.filter("tree_no % 2 = 1").withColumn("weight", F.lit(2.5)))
    d = splits.dips(splits.add(one, two))
    return d.select(F.col("family").alias("fam"), mask("clade").alias("g"), mask("left").alias("gp"), mask("right").alias("gpp"), "cnt")


PRUNE_SQL = """, k AS (SELECT fam, g & 15 AS g, gp & 15 AS x, gpp & 15 AS y FROM s)
SELECT fam, g, least(x, y) AS gp, greatest(x, y) AS gpp, CAST(count(*) AS DOUBLE) AS cnt FROM k WHERE x > 0 AND y > 0 AND g <> 15 GROUP BY ALL"""


@query(f"WITH {LADDER_SQL} {PRUNE_SQL}")
def prune_clades(spark, sf_dir):
    _, facts, fams = _split(spark, sf_dir)
    nation = table(spark, sf_dir, "nation")
    w = Window.partitionBy("n_regionkey").orderBy(F.desc("n_nationkey"))
    last = nation.withColumn("k", F.row_number().over(w)).filter("k > 1").select(F.concat(F.lit("n"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")))
    keep = [r[0] for r in last.collect()]  # nations: 25 at most
    cut, _ = ccp.prune(facts, fams, keep)
    return cut.select(F.col("family").alias("fam"), mask("clade").alias("g"), mask("left").alias("gp"), mask("right").alias("gpp"), "cnt")


@query("SELECT 'n' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS leaf, CAST(1 AS BIGINT) AS n FROM nation")
def leaf_census(spark, sf_dir):
    return splits.leaf_census(ladder_trees(spark, sf_dir))


COMPARE_SQL = """, d2 AS (SELECT fam, g, gp, gpp, obs % 2 AS part, CAST(count(*) AS DOUBLE) AS cnt FROM s GROUP BY ALL),
b2 AS (SELECT fam, g, obs % 2 AS part, CAST(count(*) AS DOUBLE) AS cnt FROM s GROUP BY ALL),
p2 AS (SELECT d2.fam, d2.g, d2.gp, d2.gpp, d2.part, d2.cnt / b2.cnt AS p FROM d2 JOIN b2 USING (fam, g, part)),
x AS (SELECT s.fam, s.obs, c.part, sum(CASE WHEN p2.p IS NULL THEN 1 ELSE 0 END) AS unseen, sum(ln(p2.p)) AS lp
 FROM s CROSS JOIN (SELECT 0 AS part UNION ALL SELECT 1) c LEFT JOIN p2 ON p2.fam = s.fam AND p2.g = s.g AND p2.gp = s.gp AND p2.gpp = s.gpp AND p2.part = c.part WHERE s.g % 2 = 0 GROUP BY ALL)
SELECT a.fam, CASE WHEN a.obs % 2 = 0 THEN 'one' ELSE 'two' END AS sample, a.obs AS tree_no,
 CASE WHEN a.unseen > 0 THEN NULL ELSE round(a.lp, 8) END AS log_p_one, CASE WHEN b.unseen > 0 THEN NULL ELSE round(b.lp, 8) END AS log_p_two
FROM x a JOIN x b ON a.fam = b.fam AND a.obs = b.obs AND a.part = 0 AND b.part = 1"""


@query(f"WITH {LADDER_SQL} {COMPARE_SQL}")
def compare_posteriors(spark, sf_dir):
    trees = ladder_trees(spark, sf_dir)
    got = ccp.compare(trees.filter("tree_no % 2 = 0"), trees.filter("tree_no % 2 = 1"))
    finite = lambda c: F.when(F.col(c) > F.lit(float("-inf")), F.round(c, 8)).alias(c)
    return got.select(F.col("family").alias("fam"), "sample", "tree_no", finite("log_p_one"), finite("log_p_two"))


@query(_with("SELECT coalesce(a.fam, b.fam) AS fam, coalesce(a.obs, b.obs - 1) AS one, coalesce(a.obs + 1, b.obs) AS two, sum(CASE WHEN a.g IS NULL OR b.g IS NULL THEN 1 ELSE 0 END) / 2.0 AS distance FROM s a FULL JOIN s b ON a.fam = b.fam AND b.obs = a.obs + 1 AND a.g = b.g WHERE (a.obs IS NULL OR a.obs + 1 IN (SELECT obs FROM m)) AND (b.obs IS NULL OR b.obs - 1 IN (SELECT obs FROM m)) GROUP BY ALL"))
def rf_distance(spark, sf_dir):
    return ccp.robinson_foulds(ladder_trees(spark, sf_dir)).select(F.col("family").alias("fam"), "one", "two", F.col("distance").cast("double").alias("distance"))


@query(_with("SELECT fam, g, CAST(size AS INT) AS size, round(cnt / observations, 9) AS freq FROM bip CROSS JOIN o WHERE g % 2 = 0 AND cnt > 0.15 * observations"))
def majority_consensus(spark, sf_dir):
    _, facts, fams = _split(spark, sf_dir)
    return ccp.majority(facts, fams, 0.15).select(F.col("family").alias("fam"), mask("clade").alias("g"), "size", F.round("freq", 9).alias("freq"))


@query(_with(", t AS (SELECT fam, obs, row_number() OVER (PARTITION BY fam ORDER BY obs) AS k FROM w) SELECT CAST(fam AS VARCHAR) AS fam, CAST(obs AS BIGINT) AS tree_no FROM t WHERE k > 10 AND k % 3 = 0"))
def burnin_filter(spark, sf_dir):
    from cladeflow.sources.readers import chosen

    trees = ladder_trees(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("family").orderBy("tree_no")))
    return trees.filter(chosen(F.col("k"), 10, 3)).select(F.col("family").alias("fam"), "tree_no")


@query(_with(", ids AS (SELECT DISTINCT fam, g FROM (SELECT fam, g FROM s UNION ALL SELECT fam, gp FROM s UNION ALL SELECT fam, gpp FROM s)) SELECT fam, g, CAST(row_number() OVER (PARTITION BY fam ORDER BY bit_count(g), g) AS INT) AS clade_id FROM ids"))
def clade_ids(spark, sf_dir):
    _, facts, _ = _split(spark, sf_dir)
    return splits.clade_ids(facts).select(F.col("family").alias("fam"), mask("clade").alias("g"), "clade_id")


NAMES_SQL = """, lf AS (SELECT CAST(fam AS VARCHAR) AS fam, leaf, min(nk) AS nk FROM r GROUP BY ALL)
SELECT b.fam, b.g, string_agg('n' || lpad(CAST(nk AS VARCHAR), 2, '0'), ' ' ORDER BY nk) || ' ' AS name FROM bip b JOIN lf ON lf.fam = b.fam AND (b.g >> CAST(leaf - 1 AS INT)) & 1 = 1 GROUP BY ALL"""


@query(f"WITH {LADDER_SQL} {NAMES_SQL}")
def clade_names(spark, sf_dir):
    _, facts, fams = _split(spark, sf_dir)
    seen = splits.bips(facts).filter("cnt IS NOT NULL").select("family", "clade")
    return splits.clade_names(facts, fams).join(seen, ["family", "clade"], "left_semi").select(F.col("family").alias("fam"), mask("clade").alias("g"), "name")


# --- events: users are families, event types are branches, hours are samples --------------


def _events(spark, sf_dir) -> DataFrame:
    """Events of users as sampled events: family is a user group, sample the day, branch the event type, kind by value."""
    e = table(spark, sf_dir, "events").select(F.pmod("user_id", F.lit(10)).cast("string").alias("family"), F.pmod(F.col("event_id"), F.lit(20)).cast("int").alias("sample_no"), "event_type", "value", "event_id")
    branch = F.pmod(F.length("event_type"), F.lit(7)).cast("int")
    other = F.pmod(F.col("event_id"), F.lit(5)).cast("int")
    kind = F.element_at(F.array(*map(F.lit, "DTLOCS")), (F.pmod(F.col("event_id"), F.lit(6)) + 1).cast("int"))
    return e.select("family", "sample_no", kind.alias("kind"), branch.alias("branch"), F.when(kind == "T", other).otherwise(-1).alias("other"))


EVENTS_SQL = """e AS (SELECT CAST(user_id % 10 AS VARCHAR) AS family, CAST(event_id % 20 AS INT) AS sample_no, substr('DTLOCS', CAST(event_id % 6 AS INT) + 1, 1) AS kind,
 CAST(length(event_type) % 7 AS INT) AS branch, CASE WHEN event_id % 6 = 1 THEN CAST(event_id % 5 AS INT) ELSE -1 END AS other FROM events)"""


@query(f"WITH {EVENTS_SQL} SELECT branch AS donor, other AS recipient, round(count(*) / 20.0, 9) AS freq FROM e WHERE kind = 'T' GROUP BY ALL")
def transfer_matrix(spark, sf_dir):
    return event_tables.transfer_matrix(_events(spark, sf_dir), 20).select("donor", "recipient", F.round("freq", 9).alias("freq"))


PIVOT_SQL = """, h AS (SELECT family, kind, branch FROM e UNION ALL SELECT family, 'R', other FROM e WHERE kind = 'T')
SELECT family, branch, round(count(*) FILTER (kind = 'D') / 20.0, 9) AS duplications, round(count(*) FILTER (kind = 'T') / 20.0, 9) AS transfers,
 round(count(*) FILTER (kind = 'L') / 20.0, 9) AS losses, round(count(*) FILTER (kind = 'O') / 20.0, 9) AS originations, round(count(*) FILTER (kind = 'R') / 20.0, 9) AS received,
 round(count(*) FILTER (kind IN ('C', 'S')) / 20.0, 9) AS copies FROM h GROUP BY ALL"""


@query(f"WITH {EVENTS_SQL} {PIVOT_SQL}")
def branch_event_pivot(spark, sf_dir):
    m = event_tables.branch_means(_events(spark, sf_dir), 20)
    return m.select("family", "branch", *(F.round(c, 9).alias(c) for c in ("duplications", "transfers", "losses", "originations", "received", "copies")))


HIST_SQL = """, p AS (SELECT family, kind, branch, sample_no, count(*) AS n FROM e GROUP BY ALL)
SELECT family, kind, branch, round(1 - count(*) / 20.0, 9) AS n0, """ + ", ".join(f"round(count(*) FILTER (n = {k}) / 20.0, 9) AS n{k}" for k in range(1, 10)) + " FROM p GROUP BY ALL"


@query(f"WITH {EVENTS_SQL} {HIST_SQL}")
def event_histogram(spark, sf_dir):
    h = event_tables.histogram(_events(spark, sf_dir), 20)
    return h.select("family", "kind", "branch", *(F.round(f"n{k}", 9).alias(f"n{k}") for k in range(10)))


@query(f"WITH {EVENTS_SQL}, p AS (SELECT family, branch, sample_no, count(*) AS n FROM e WHERE kind IN ('C', 'S') GROUP BY ALL) SELECT family, branch, round(count(*) / 20.0, 9) AS presence, round(count(*) FILTER (n = 1) / 20.0, 9) AS singletons FROM p GROUP BY ALL")
def branch_presence(spark, sf_dir):
    p = event_tables.presence(_events(spark, sf_dir), 20)
    return p.select("family", "branch", F.round("presence", 9).alias("presence"), F.round("singletons", 9).alias("singletons"))


@query(f"WITH {EVENTS_SQL}, c AS (SELECT family, branch, count(*) FILTER (kind IN ('C', 'S')) / 20.0 AS copies FROM (SELECT family, kind, branch FROM e UNION ALL SELECT family, 'R', other FROM e WHERE kind = 'T') GROUP BY ALL) SELECT family, branch, round(sum(copies) OVER (PARTITION BY family ORDER BY branch DESC), 9) AS cumulative FROM c")
def cumulative_copies(spark, sf_dir):
    m = event_tables.branch_means(_events(spark, sf_dir), 20)
    ranks = spark.range(0, 8).select(F.col("id").cast("int").alias("branch"), F.col("id").alias("rank"))
    c = event_tables.cumulative_copies(m, ranks)
    return c.select("family", "branch", F.round("cumulative", 9).alias("cumulative"))


RATE_SQL = """, h AS (SELECT kind, branch FROM e UNION ALL SELECT 'R', other FROM e WHERE kind = 'T'),
g AS (SELECT branch, count(*) FILTER (kind = 'D') / 20.0 AS d, count(*) FILTER (kind = 'T') / 20.0 AS t, count(*) FILTER (kind = 'L') / 20.0 AS l, count(*) FILTER (kind IN ('C', 'S')) / 20.0 AS c FROM h GROUP BY ALL),
z AS (SELECT sum(c) AS all_c, count(*) AS n FROM g)
SELECT branch, round(greatest(1e-6, coalesce(d / nullif(c, 0), 0)), 9) AS delta, round(greatest(1e-6, coalesce(t / nullif(all_c, 0) * n, 0)), 9) AS tau, round(greatest(1e-6, coalesce(l / nullif(c, 0), 0)), 9) AS "lambda" FROM g CROSS JOIN z"""


@query(f"WITH {EVENTS_SQL} {RATE_SQL}")
def rate_estimates(spark, sf_dir):
    m = event_tables.branch_means(_events(spark, sf_dir), 20, by=())
    r = event_tables.rate_estimates(m)
    return r.select("branch", *(F.round(c, 9).alias(c) for c in ("delta", "tau", "lambda")))


@query(f"WITH {EVENTS_SQL} SELECT family, " + ", ".join(f"round(count(*) FILTER (kind = '{k}') / 20.0, 9) AS {n}" for k, n in (("D", "duplications"), ("T", "transfers"), ("L", "losses"), ("O", "originations"), ("S", "speciations"))) + " FROM e GROUP BY ALL")
def family_totals(spark, sf_dir):
    t = event_tables.totals(_events(spark, sf_dir), 20)
    return t.select("family", *(F.round(c, 9).alias(c) for c in ("duplications", "transfers", "losses", "originations", "speciations")))


# --- constraints: nations that ship to each other, over a fixed labelled tree --------------

#: Six inner nodes over seven leaves: (((l1,l2)c,l3)b,((l4,l5)e,(l6,l7)f)d)a.
TREE = "(((l1:1,l2:1)c:1,l3:2)b:1,((l4:1,l5:1)e:1.5,(l6:1,l7:1)f:0.5)d:0.5)a;"
NODES = ("a", "b", "c", "d", "e", "f", "l1", "l4")


def _constraints(spark, sf_dir) -> DataFrame:
    """Customers' and orders' keys as constraints between nodes, a unit of weight each."""
    o = table(spark, sf_dir, "orders")
    name = lambda c: F.element_at(F.array(*map(F.lit, NODES)), (F.pmod(c, F.lit(8)) + 1).cast("int"))
    return o.select(name(F.col("o_custkey")).alias("older"), name(F.floor(F.col("o_orderkey") / 3)).alias("younger"), (F.pmod("o_orderkey", F.lit(4)) + 1).cast("double").alias("weight"))


_ARRAY = "['a','b','c','d','e','f','l1','l4']"
CONSTRAINT_SQL = f"""c0 AS (SELECT list_extract({_ARRAY}, CAST(o_custkey % 8 + 1 AS INT)) AS older, list_extract({_ARRAY}, CAST((o_orderkey // 3) % 8 + 1 AS INT)) AS younger, CAST(o_orderkey % 4 + 1 AS DOUBLE) AS weight FROM orders),
c AS (SELECT older, younger, sum(weight) AS weight FROM c0 GROUP BY ALL),
br(name, parent, leaf) AS (VALUES ('a', NULL, false), ('b', 'a', false), ('c', 'b', false), ('d', 'a', false), ('e', 'd', false), ('f', 'd', false), ('l1', 'c', true), ('l2', 'c', true), ('l3', 'b', true), ('l4', 'e', true), ('l5', 'e', true), ('l6', 'f', true), ('l7', 'f', true)),
cl AS (WITH RECURSIVE k(above, below) AS (SELECT name, name FROM br UNION ALL SELECT br.parent, k.below FROM k JOIN br ON br.name = k.above WHERE br.parent IS NOT NULL) SELECT * FROM k)"""


@query(f"WITH {CONSTRAINT_SQL} SELECT * FROM c")
def constraint_weights(spark, sf_dir):
    return ordering.total(_constraints(spark, sf_dir))


@query(f"WITH {CONSTRAINT_SQL} SELECT x.older, x.younger, x.weight - coalesce(y.weight, 0) AS weight FROM c x LEFT JOIN c y ON x.older = y.younger AND x.younger = y.older WHERE x.weight - coalesce(y.weight, 0) > 0")
def constraint_cancel(spark, sf_dir):
    return ordering.cancel(ordering.total(_constraints(spark, sf_dir)))


CLASS_SQL = """ SELECT c.older, c.younger, c.weight, CASE WHEN c.older = c.younger THEN 'self' WHEN d.above IS NOT NULL THEN 'to_descendant' WHEN y.leaf THEN 'to_leaf' WHEN x.leaf THEN 'from_leaf' WHEN u.above IS NOT NULL THEN 'to_ancestor' ELSE 'informative' END AS class
FROM c JOIN br x ON x.name = c.older JOIN br y ON y.name = c.younger LEFT JOIN cl d ON d.above = c.older AND d.below = c.younger LEFT JOIN cl u ON u.above = c.younger AND u.below = c.older"""


@query(f"WITH {CONSTRAINT_SQL} {CLASS_SQL}")
def constraint_class(spark, sf_dir):
    return ordering.classify(ordering.total(_constraints(spark, sf_dir)), ordering.branch_table(spark, TREE))


ORDER = ("a", "d", "b", "e", "f", "c")
_ORDER_SQL = "od(name, place) AS (VALUES " + ", ".join(f"('{x}', {k})" for k, x in enumerate(ORDER)) + ")"


@query(f"WITH {CONSTRAINT_SQL}, {_ORDER_SQL} SELECT sum(CASE WHEN a.place > b.place THEN weight ELSE 0 END) AS violated, round(sum(CASE WHEN a.place > b.place THEN weight ELSE 0 END) / sum(weight), 9) AS share FROM c LEFT JOIN od a ON a.name = c.older LEFT JOIN od b ON b.name = c.younger")
def order_value(spark, sf_dir):
    v = ordering.order_value(ordering.total(_constraints(spark, sf_dir)), ordering.order_table(spark, list(ORDER)))
    return v.select("violated", F.round("share", 9).alias("share"))


@query(f"WITH {CONSTRAINT_SQL}, {_ORDER_SQL} SELECT c.* FROM c JOIN od a ON a.name = c.older JOIN od b ON b.name = c.younger WHERE a.place > b.place")
def conflicting_constraints(spark, sf_dir):
    return ordering.conflicting(ordering.total(_constraints(spark, sf_dir)), ordering.order_table(spark, list(ORDER)))


@query("WITH x AS (SELECT s_suppkey AS name, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS p, row_number() OVER (ORDER BY s_name DESC, s_suppkey) AS q FROM supplier) SELECT count(*) AS inversions FROM x a JOIN x b ON a.p < b.p AND a.q > b.q")
def kendall(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("name"), "s_acctbal", "s_name")
    place = lambda *o: with_running(s, list(o), {}, "place").select("name", "place")
    return ordering.kendall(place(F.col("s_acctbal"), F.col("name")), place(F.desc("s_name"), F.col("name")))


@query(f"WITH {CONSTRAINT_SQL}, z AS (SELECT *, coalesce(sum(weight) OVER (ORDER BY weight, older, younger ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(weight) OVER () AS tot FROM c) SELECT older, younger, weight FROM z WHERE before >= 0.3 * tot")
def light_edge_cut(spark, sf_dir):
    return ordering.cut_light(ordering.total(_constraints(spark, sf_dir)), 0.3)


@query("WITH RECURSIVE k(above, below) AS (SELECT n_nationkey, n_nationkey FROM nation UNION ALL SELECT k.above // 2, k.below FROM k WHERE k.above > 0) SELECT above, below FROM k")
def ancestor_closure(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("name"))
    return ordering.closure(n.select("name", F.when(F.col("name") > 0, F.floor(F.col("name") / 2).cast("int")).alias("parent")))


@query("WITH t AS (SELECT s.s_suppkey AS file, s.s_acctbal + 1000 AS time, s.s_nationkey AS species FROM supplier s), z AS (SELECT *, sum(time) OVER (PARTITION BY species ORDER BY time, file ROWS UNBOUNDED PRECEDING) / sum(time) OVER (PARTITION BY species) AS part FROM t) SELECT file, time, species FROM z WHERE part < 0.7")
def species_time_cut(spark, sf_dir):
    t = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file"), (F.col("s_acctbal") + 1000).alias("time"), F.col("s_nationkey").alias("species"))
    return scheduling.species_time_cut(t, 0.7)


@query("WITH b AS (SELECT p_partkey AS e, CAST(p_size AS DOUBLE) AS t_begin, CAST(p_size % 7 AS DOUBLE) - 1 AS t_end FROM part WHERE p_size % 7 - 1 < p_size), s AS (SELECT unnest(range(0, 50, 5)) AS t_i) SELECT CAST(t_i AS BIGINT) AS t_i, count(*) AS n, CAST(sum(e) AS BIGINT) AS sum_e FROM s JOIN b ON t_end <= t_i AND t_i < t_begin GROUP BY ALL")
def slice_branches(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("e"), F.col("p_size").cast("double").alias("t_begin"), (F.col("p_size") % 7).cast("double").alias("m"))
    b = p.select("e", "t_begin", (F.col("m") - 1).alias("t_end")).filter("t_end < t_begin")
    return species.alive_at(b, spark.range(0, 50, 5).withColumnRenamed("id", "t_i")).groupBy("t_i").agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("sum_e"))


# --- models: results are checked in tests against fixed values, SQL cannot express them ----


def _tables(spark, sf_dir):
    trees = ladder_trees(spark, sf_dir)
    own = F.regexp_replace("newick", "n(0[0-9]|1[0-9]|2[0-9])", "s$1_g")
    return splits.tables(trees.withColumn("newick", own))


def _species(spark, sf_dir) -> str:
    """A species tree of all nations: regions are ladders, joined in a row."""
    rows = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey").orderBy("n_regionkey", "n_nationkey").collect()  # 25 rows
    by: dict[int, str] = {}
    for r in rows:
        leaf = f"s{r['n_nationkey']:02d}"
        by[r["n_regionkey"]] = f"({by[r['n_regionkey']]}:1,{leaf}:1)" if r["n_regionkey"] in by else leaf
    text = ""
    for _, part in sorted(by.items()):
        text = f"({text}:1,{part}:1)" if text else part
    return text + ";"


@query(loglik_sql())
def undated_loglik(spark, sf_dir):
    return reconcile.loglik(_tables(spark, sf_dir), _species(spark, sf_dir)).withColumn("logl", F.round("logl", 6))


@query()
def undated_fit(spark, sf_dir):
    return reconcile.fit(_tables(spark, sf_dir), _species(spark, sf_dir))


@query()
def undated_samples(spark, sf_dir):
    s = reconcile.samples(_tables(spark, sf_dir), _species(spark, sf_dir), n=20)
    return event_tables.branch_means(reconcile.events(s), 20)


@query()
def mcmc_trace(spark, sf_dir):
    return reconcile.mcmc(_tables(spark, sf_dir), _species(spark, sf_dir), steps=60, burnin=20, thin=4)


@query()
def dated_loglik(spark, sf_dir):
    return dated.loglik(_tables(spark, sf_dir), _species(spark, sf_dir)).withColumn("logl", F.round("logl", 6))


@query()
def ml_reconciliation(spark, sf_dir):
    return dated.best_reconciliation(_tables(spark, sf_dir), _species(spark, sf_dir)).select("family", F.round("logp", 6).alias("logp"), "newick")


@query()
def simulate_trees(spark, sf_dir):
    """A simulation for each supplier."""
    return simulate.simulate(spark, 0, seeds=table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")))


@query()
def rank_species(spark, sf_dir):
    got = ordering.rank(TREE, _constraints(spark, sf_dir), steps=5000, chains=2)
    return spark.createDataFrame(list(enumerate(got["order"])), "place int, name string")


@query()
def pack_families(spark, sf_dir):
    t = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("file"), (F.abs("s_acctbal") + 1).alias("time"), F.col("s_nationkey").cast("long").alias("species"))
    return scheduling.pack(t, 8, "all")


