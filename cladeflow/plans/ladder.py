"""Tree samples derived from the star schema, so that tree operators can be checked in SQL.

A family is a region, its leaves are its nations, and each month of orders is an observed
tree: nations ranked by their orders give a ladder, the busiest pair innermost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def month(column: str = "o_orderdate"):
    return (F.year(column) * 12 + F.month(column)).cast("int")


def ladder_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fam, obs, nk, pos, leaf: the place of each nation in each month's ladder, and its leaf number."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", month().alias("obs"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nk"))
    nation = F.broadcast(table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("fam"), F.col("n_nationkey").alias("nk")))  # 25 rows, whatever the scale
    # Counting by customer first shrinks the join with the customers to one row a customer and month.
    per = orders.groupBy("o_custkey", "obs").agg(F.count(F.lit(1)).alias("c")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    counts = per.groupBy("nk", "obs").agg(F.sum("c").alias("c"))
    months = counts.select("obs").distinct()
    grid = nation.join(months).join(counts, ["nk", "obs"], "left").select("fam", "obs", "nk", F.coalesce("c", F.lit(0)).alias("c"))
    own = Window.partitionBy("fam", "obs")
    return grid.select("fam", "obs", "nk", F.row_number().over(own.orderBy(F.desc("c"), "nk")).alias("pos"), F.row_number().over(own.orderBy("nk")).alias("leaf"))


def ladder_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """family, tree_no, newick: one ladder for each region and month; leaves are named n00 to n24."""
    name = F.concat(F.lit("n"), F.lpad(F.col("nk").cast("string"), 2, "0"))
    g = ladder_ranks(spark, sf_dir).groupBy("fam", "obs").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", name.alias("x")))), lambda s: s["x"]).alias("xs"))
    tail = F.aggregate(F.slice("xs", F.lit(2), F.size("xs")), F.col("xs")[0], lambda t, x: F.concat(F.lit("("), t, F.lit(":1,"), x, F.lit(":1)")))
    return dealt(g.select(F.col("fam").cast("string").alias("family"), F.col("obs").cast("long").alias("tree_no"), F.concat(tail, F.lit(";")).alias("newick")))


def dealt(trees: DataFrame) -> DataFrame:
    """Trees dealt to all cores: they are few bytes but dear to parse, and would be merged into one task for their bytes."""
    return trees.repartition(trees.sparkSession.sparkContext.defaultParallelism)


def mask(column: str):
    """A binary clade of at most 63 leaves as a number."""
    return F.conv(F.hex(column), 16, 10).cast("long")


#: Common tables of the SQL oracles: splits (fam, obs, g, gp, gpp) of every ladder, and ranks r.
LADDER_SQL = """
m AS (SELECT DISTINCT CAST(year(o_orderdate)*12+month(o_orderdate) AS INT) AS obs FROM orders),
a AS (SELECT c_nationkey AS nk, CAST(year(o_orderdate)*12+month(o_orderdate) AS INT) AS obs, count(*) AS c FROM orders JOIN customer ON o_custkey=c_custkey GROUP BY 1,2),
gr AS (SELECT n.n_regionkey AS fam, m.obs AS obs, n.n_nationkey AS nk, coalesce(a.c,0) AS c FROM nation n CROSS JOIN m LEFT JOIN a ON a.nk=n.n_nationkey AND a.obs=m.obs),
r AS (SELECT fam,obs,nk, row_number() OVER (PARTITION BY fam,obs ORDER BY c DESC, nk) AS pos, row_number() OVER (PARTITION BY fam,obs ORDER BY nk) AS leaf FROM gr),
w AS (SELECT fam,obs, CAST(sum(CASE WHEN pos=1 THEN pow(2,leaf-1) END) AS BIGINT) a, CAST(sum(CASE WHEN pos=2 THEN pow(2,leaf-1) END) AS BIGINT) b,
 CAST(sum(CASE WHEN pos=3 THEN pow(2,leaf-1) END) AS BIGINT) c, CAST(sum(CASE WHEN pos=4 THEN pow(2,leaf-1) END) AS BIGINT) d, CAST(sum(CASE WHEN pos=5 THEN pow(2,leaf-1) END) AS BIGINT) e FROM r GROUP BY fam,obs),
s0 AS (
 SELECT fam, obs, a+b AS g, a AS x, b AS y FROM w UNION ALL SELECT fam, obs, a+b+c, a+b, c FROM w
 UNION ALL SELECT fam, obs, c+d+e, c, d+e FROM w UNION ALL SELECT fam, obs, d+e, d, e FROM w
 UNION ALL SELECT fam, obs, b+c+d+e, b, c+d+e FROM w UNION ALL SELECT fam, obs, a+c+d+e, a, c+d+e FROM w
 UNION ALL SELECT fam, obs, a+b+d+e, a+b, d+e FROM w UNION ALL SELECT fam, obs, a+b+c+e, a+b+c, e FROM w
 UNION ALL SELECT fam, obs, a+b+c+d, a+b+c, d FROM w),
s AS (SELECT CAST(fam AS VARCHAR) AS fam, CAST(obs AS BIGINT) AS obs, CAST(g AS BIGINT) AS g, CAST(least(x,y) AS BIGINT) AS gp, CAST(greatest(x,y) AS BIGINT) AS gpp FROM s0),
o AS (SELECT CAST(count(*) AS DOUBLE) AS observations FROM m),
dip AS (SELECT fam, g, gp, gpp, CAST(count(*) AS DOUBLE) AS cnt FROM s GROUP BY ALL),
bip AS (SELECT fam, g, bit_count(g) AS size, CAST(count(*) AS DOUBLE) AS cnt FROM s GROUP BY ALL),
ccp AS (SELECT dip.fam, dip.g, dip.gp, dip.gpp, dip.cnt, dip.cnt / (CASE WHEN bip.size = 4 THEN o.observations ELSE bip.cnt END) AS p FROM dip JOIN bip USING (fam, g) CROSS JOIN o)
"""
