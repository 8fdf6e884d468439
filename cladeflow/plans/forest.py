"""Trees that grow with the scale factor: a family a hundred customers, a ladder of 32 leaves a quarter.

A leaf is one of 32 groups of order keys; groups ranked by their orders in a quarter give the
ladder, the busiest pair innermost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeflow.plans.ladder import dealt, table

LEAVES = 32


def forest_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """family, tree_no, newick; leaves are named x00 to x31."""
    o = table(spark, sf_dir, "orders").select(
        F.floor(F.col("o_custkey") / 100).cast("string").alias("family"), (F.year("o_orderdate") * 4 + F.quarter("o_orderdate")).cast("long").alias("tree_no"), (F.floor(F.col("o_orderkey") / 4) % LEAVES).cast("int").alias("leaf")
    )
    # A tree's counts travel as one row, so the grid of leaves is made where the counts are.
    counts = o.groupBy("family", "tree_no", "leaf").agg(F.count(F.lit(1)).alias("c"))
    per = counts.groupBy("family", "tree_no").agg(F.map_from_entries(F.collect_list(F.struct("leaf", "c"))).alias("of"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(LEAVES - 1)), lambda k: F.struct((-F.coalesce(F.try_element_at("of", k), F.lit(0))).alias("c"), k.cast("int").alias("leaf")))
    xs = F.transform(F.array_sort(grid), lambda s: F.concat(F.lit("x"), F.lpad(s["leaf"].cast("string"), 2, "0")))
    one = per.select("family", "tree_no", xs.alias("xs"))
    tail = F.aggregate(F.slice("xs", 2, LEAVES - 1), F.col("xs")[0], lambda t, x: F.concat(F.lit("("), t, F.lit(":1,"), x, F.lit(":1)")))
    return dealt(one.select("family", "tree_no", F.concat(tail, F.lit(";")).alias("newick")))


#: Common tables of the SQL oracles: directed splits fs (fam, obs, g, gp, gpp) of every tree.
FOREST_SQL = """
f0 AS (SELECT CAST(o_custkey // 100 AS VARCHAR) AS fam, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) AS BIGINT) AS obs, CAST((o_orderkey // 4) % 32 AS INT) AS leaf, count(*) AS c FROM orders GROUP BY ALL),
fg AS (SELECT DISTINCT fam, obs FROM f0),
fl AS (SELECT fg.fam, fg.obs, l.leaf, coalesce(f0.c, 0) AS c FROM fg CROSS JOIN (SELECT CAST(unnest(range(32)) AS INT) AS leaf) l LEFT JOIN f0 ON f0.fam = fg.fam AND f0.obs = fg.obs AND f0.leaf = l.leaf),
fr AS (SELECT fam, obs, CAST(1 AS BIGINT) << leaf AS bit, row_number() OVER (PARTITION BY fam, obs ORDER BY c DESC, leaf) AS pos FROM fl),
fp AS (SELECT *, CAST(sum(bit) OVER (PARTITION BY fam, obs ORDER BY pos) AS BIGINT) AS pre FROM fr),
fx AS (SELECT fam, obs, pre AS g, pre - bit AS x, bit AS y FROM fp WHERE pos BETWEEN 2 AND 31 UNION ALL
 SELECT fam, obs, 4294967295 - pre + bit, bit, 4294967295 - pre FROM fp WHERE pos BETWEEN 2 AND 31 UNION ALL
 SELECT fam, obs, 4294967295 - bit, pre - bit, 4294967295 - pre FROM fp WHERE pos BETWEEN 2 AND 31),
fs AS (SELECT fam, obs, CAST(g AS BIGINT) AS g, CAST(least(x, y) AS BIGINT) AS gp, CAST(greatest(x, y) AS BIGINT) AS gpp FROM fx),
fo AS (SELECT fam, CAST(count(*) AS DOUBLE) AS n FROM fg GROUP BY ALL),
fd AS (SELECT fam, g, gp, gpp, CAST(count(*) AS DOUBLE) AS cnt FROM fs GROUP BY ALL),
fb AS (SELECT fam, g, CAST(count(*) AS DOUBLE) AS cnt FROM fs GROUP BY ALL),
fc AS (SELECT fd.fam, fd.g, fd.gp, fd.gpp, fd.cnt / CASE WHEN bit_count(fd.g) = 31 THEN fo.n ELSE fb.cnt END AS p FROM fd JOIN fb USING (fam, g) JOIN fo USING (fam))
"""
