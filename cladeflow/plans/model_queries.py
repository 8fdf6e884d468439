"""Queries of models over families derived from the star schema, with the models written out in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeflow.functions.species_tree import read_species_tree
from cladeflow.functions.undated_model import Rates
from cladeflow.operators import ccp, event_tables, ordering, reconcile, scheduling, splits, undated_levels
from cladeflow.operators.stored import shared_path
from cladeflow.plans.catalog import CONSTRAINT_SQL, EVENTS_SQL, TREE, _constraints, _species, _tables, _with
from cladeflow.plans.forest import FOREST_SQL, forest_trees
from cladeflow.plans.ladder import LADDER_SQL, ladder_trees, mask, table
from cladeflow.plans.registry import query
from cladeflow.plans.undated_sql import extinction_ctes, loglik_sql, undated_ctes
from cladeflow.sources import readers


def _facts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Facts and families of the ladders, genes named by nation."""
    trees = ladder_trees(spark, sf_dir).withColumn("newick", F.regexp_replace("newick", r"n(\d\d)", "s$1_g"))
    return splits.split_facts(trees), splits.families(trees)


def _below(spark, sf_dir):
    """The leaves below each branch of the tree of nations, as a column over branch; the tree has 49 branches."""
    tree = read_species_tree(_species(spark, sf_dir))
    return F.get(F.array(*(F.lit("+".join(x)) for x in tree.below())), F.col("branch")).alias("below")


# --- undated likelihoods ---------------------------------------------------------------------


@query(loglik_sql())
def undated_levels_loglik(spark, sf_dir):
    """Likelihoods level by level, a clade a row."""
    return undated_levels.loglik(*_facts(spark, sf_dir), _species(spark, sf_dir)).withColumn("logl", F.round("logl", 6))


@query(loglik_sql(delta=0.3, tau=0.2, lambda_=0.4, any_recipient=True))
def undated_any_recipient(spark, sf_dir):
    """Transfers to any branch, ancestors too."""
    rates = Rates(delta=0.3, tau=0.2, lambda_=0.4, any_recipient=True)
    return undated_levels.loglik(*_facts(spark, sf_dir), _species(spark, sf_dir), rates).withColumn("logl", F.round("logl", 6))


@query(loglik_sql(delta=0.2, tau=0.0, lambda_=0.3))
def undated_without_transfers(spark, sf_dir):
    rates = Rates(delta=0.2, tau=0.0, lambda_=0.3)
    return reconcile.loglik(_tables(spark, sf_dir), _species(spark, sf_dir), rates).withColumn("logl", F.round("logl", 6))


TERMS_SQL = f"""WITH {undated_ctes()} SELECT fam AS family, array_to_string(below[b], '+') AS below, round(e[b], 9) AS extinction, round(ln(q4[b]) - ln({49}), 6) AS origin_logl
FROM root, x, nl, (SELECT unnest(range(1, 50)) AS b)"""


@query(TERMS_SQL)
def branch_terms(spark, sf_dir):
    """Extinction on each branch, and the log likelihood of an origination there."""
    t = reconcile.branch_terms(_tables(spark, sf_dir), _species(spark, sf_dir))
    return t.select("family", _below(spark, sf_dir), F.round("extinction", 9).alias("extinction"), F.round("origin_logl", 6).alias("origin_logl"))


@query(TERMS_SQL.replace(", round(e[b], 9) AS extinction", ""))
def origination_levels(spark, sf_dir):
    t = undated_levels.origination_loglik(*_facts(spark, sf_dir), _species(spark, sf_dir))
    return t.select("family", _below(spark, sf_dir), F.round("logl", 6).alias("origin_logl"))


@query(f"WITH {extinction_ctes(0.3, 0.2, 0.4)} SELECT array_to_string(below[b], '+') AS below, round(e[b], 9) AS extinction FROM x, nl, (SELECT unnest(range(1, 50)) AS b)")
def nation_extinction(spark, sf_dir):
    """Extinction at high rates, the same for every family."""
    t = reconcile.branch_terms(_tables(spark, sf_dir), _species(spark, sf_dir), Rates(delta=0.3, tau=0.2, lambda_=0.4))
    return t.select(_below(spark, sf_dir), F.round("extinction", 9).alias("extinction")).distinct()


@query(f"WITH {undated_ctes()} SELECT fam AS family, array_to_string(below[b], '+') AS below, round(q4[b] / list_sum(q4), 6) AS share, true AS within FROM root, nl, (SELECT unnest(range(1, 50)) AS b)")
def sampled_originations(spark, sf_dir):
    """Where sampled trees originate: the share that the likelihood gives each branch, and whether the samples' is within five standard errors and one sample of it."""
    n = 200
    tables, tree = _tables(spark, sf_dir), _species(spark, sf_dir)
    terms = reconcile.origination_loglik(tables, tree).withColumn("_w", F.exp("logl"))
    total = terms.groupBy("family").agg(F.sum("_w").alias("_all"))
    drawn = reconcile.events(reconcile.samples(tables, tree, n=n)).filter("kind = 'O'").groupBy("family", "branch").agg((F.count(F.lit(1)) / n).alias("_drawn"))
    met = terms.join(total, "family").join(drawn, ["family", "branch"], "left").withColumn("share", F.col("_w") / F.col("_all"))
    error = 5 * F.sqrt(F.col("share") * (1 - F.col("share")) / n) + 1 / n
    return met.select("family", _below(spark, sf_dir), F.round("share", 6).alias("share"), (F.abs(F.coalesce("_drawn", F.lit(0.0)) - F.col("share")) <= error).alias("within"))


def _difference(name: str, **rates) -> str:
    h = 1e-4
    at = lambda x: f"(WITH {undated_ctes(**(rates | {name: rates[name] + x}))} SELECT fam, ln(list_sum(q4)) - ln(list_sum(list_transform(e, lambda z: 1 - z))) AS logl FROM root, x)"
    return f"SELECT '{name.rstrip('_')}' AS rate, round(sum(a.logl - b.logl) / {2 * h}, 4) AS slope FROM {at(h)} a JOIN {at(-h)} b USING (fam)"


@query(" UNION ALL ".join(_difference(k, delta=0.1, tau=0.15, lambda_=0.2) for k in ("delta", "tau", "lambda_")))
def rate_slopes(spark, sf_dir):
    """Derivatives of the summed log likelihood by the shared rates, from the backward pass; the SQL has finite differences."""
    _, g = reconcile.gradients(_tables(spark, sf_dir), _species(spark, sf_dir), [Rates(delta=0.1, tau=0.15, lambda_=0.2)])[0]
    return spark.createDataFrame([(k, round(float(x), 4)) for k, x in zip(("delta", "tau", "lambda"), g["rates"])], "rate string, slope double")


# --- clade tables ------------------------------------------------------------------------------


@query(_with("SELECT a.fam, a.obs AS tree_no, a.g, round(sum(ln(ccp.p)), 8) AS log_p FROM s a JOIN s b ON a.fam = b.fam AND a.obs = b.obs AND (b.g & a.g) = b.g JOIN ccp ON ccp.fam = b.fam AND ccp.g = b.g AND ccp.gp = b.gp AND ccp.gpp = b.gpp GROUP BY ALL"))
def recomposed_trees(spark, sf_dir):
    """Products of split probabilities within every clade of every tree, inner clades."""
    trees = ladder_trees(spark, sf_dir)
    r = ccp.recompose(trees, splits.split_facts(trees), splits.families(trees)).withColumn("g", mask("clade"))
    return r.filter(F.bit_count("g") > 1).select(F.col("family").alias("fam"), "tree_no", "g", F.round("log_p", 8).alias("log_p"))


# --- readers and schedules -----------------------------------------------------------------------


@query(f"""WITH {FOREST_SQL}, t AS (SELECT CAST((obs - 1) // 4 AS BIGINT) AS y, fam, obs, string_agg('x' || lpad(CAST(leaf AS VARCHAR), 2, '0'), '' ORDER BY pos) AS leaves FROM (SELECT fam, obs, CAST(log2(bit) AS INT) AS leaf, pos FROM fr) GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY fam, obs) AS tree_no FROM t) SELECT CAST(y AS VARCHAR) AS family, tree_no, leaves FROM n WHERE tree_no > 15 AND tree_no % 3 = 0""")
def pooled_tree_lists(spark, sf_dir):
    """Tree lists of several files, a year a file, each with its own burn-in, pooled."""
    path = shared_path(spark, "lists")
    trees = forest_trees(spark, sf_dir).withColumn("y", F.floor((F.col("tree_no") - 1) / 4))
    trees.repartition("y").sortWithinPartitions("y", "family", "tree_no").select("y", F.col("newick").alias("value")).write.partitionBy("y").text(path)
    year = F.regexp_extract("path", r"/y=(\d+)/", 1)
    got = readers.tree_samples(spark, path, family=year, burnin=15, every=3)
    return got.select("family", "tree_no", F.array_join(F.regexp_extract_all("newick", F.lit(r"(x\d\d)"), 1), "").alias("leaves"))


DEAL_SQL = """WITH RECURSIVE t AS (SELECT c_custkey AS file, abs(c_acctbal) + 1 AS time, row_number() OVER (ORDER BY abs(c_acctbal) DESC, c_custkey) AS k,
 coalesce(sum(abs(c_acctbal) + 1) OVER (ORDER BY abs(c_acctbal) DESC, c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM customer),
l(k, loads, cpu) AS (SELECT CAST(0 AS BIGINT), list_transform(range(8), lambda i: 0.0::DOUBLE), CAST(NULL AS INT)
 UNION ALL SELECT t.k, list_transform(l.loads, lambda x, i: CASE WHEN i = list_position(l.loads, list_min(l.loads)) THEN x + t.time ELSE x END), CAST(list_position(l.loads, list_min(l.loads)) - 1 AS INT) FROM l JOIN t ON t.k = l.k + 1 WHERE t.k <= 40),
f AS (SELECT loads FROM l ORDER BY k DESC LIMIT 1), r AS (SELECT coalesce(sum(time), 0) AS rest, coalesce(min(before), 0) AS start FROM t WHERE k > 40),
o AS (SELECT list_sort(loads) AS s FROM f), lv AS (SELECT max(j) AS j FROM o, r, (SELECT unnest(range(1, 9)) AS j) WHERE j * s[j] - list_sum(s[1:j]) <= rest),
v AS (SELECT (rest + list_sum(s[1:j])) / j AS level FROM o, r, lv),
b AS (SELECT list_transform(range(1, 9), lambda i: list_sum(list_transform(loads[1:i], lambda x: greatest(level - x, 0)))) AS upto, loads, level FROM f, v)
SELECT file, cpu, round(time, 2) AS time FROM l JOIN t USING (k) UNION ALL
SELECT file, CAST((SELECT min(i) FROM (SELECT unnest(range(1, 9)) AS i) WHERE upto[i] > before - start + time / 2 AND loads[i] < level) - 1 AS INT), round(time, 2) FROM t, b, r WHERE k > 40"""


@query(DEAL_SQL)
def dealt_families(spark, sf_dir):
    """Customers dealt evenly to 8 machines: the 40 longest one by one, the others poured."""
    t = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file"), (F.abs("c_acctbal") + 1).alias("time"))
    return scheduling.deal(t, 8, head=5, rounds=0).withColumn("time", F.round("time", 2))


# --- best and random trees -------------------------------------------------------------------------

BEST_SQL = """, lf AS (SELECT DISTINCT CAST(fam AS VARCHAR) AS fam, CAST(pow(2, leaf - 1) AS BIGINT) AS g, 's' || lpad(CAST(nk AS VARCHAR), 2, '0') || '_g' AS name FROM r),
q1 AS (SELECT fam, g, 1.0 AS q, name || ':1.0' AS t FROM lf),
""" + ",\n".join(
    f"""w{k} AS (SELECT c.fam, c.g, c.gp, c.p * x.q * y.q AS v, '(' || x.t || ',' || y.t || ')' AS t FROM ccp c JOIN ({" UNION ALL ".join(f"SELECT * FROM q{j}" for j in range(1, k))}) x ON x.fam = c.fam AND x.g = c.gp
 JOIN ({" UNION ALL ".join(f"SELECT * FROM q{j}" for j in range(1, k))}) y ON y.fam = c.fam AND y.g = c.gpp WHERE bit_count(c.g) = {k}),
q{k} AS (SELECT fam, g, max(v) AS q, arg_min(t, {{'v': round(-ln(v), 9), 'a': gp}}) || CAST(round(max(v) / sum(v), 6) AS VARCHAR) || ':1.0' AS t FROM w{k} GROUP BY fam, g)"""
    for k in (2, 3, 4)
) + """, qa AS (SELECT * FROM q1 UNION ALL SELECT * FROM q2 UNION ALL SELECT * FROM q3 UNION ALL SELECT * FROM q4),
w5 AS (SELECT b.fam, b.g, x.q * y.q * CASE WHEN b.size = 4 THEN 1.0 ELSE b.cnt / observations END AS v, '(' || x.t || ',' || y.t || ')' AS t FROM bip b CROSS JOIN o JOIN qa x ON x.fam = b.fam AND x.g = b.g JOIN qa y ON y.fam = b.fam AND y.g = 31 - b.g)
SELECT fam AS family, arg_min(t, {'v': round(-ln(v), 9), 'a': g}) || CAST(round(2 * max(v) / sum(v), 6) AS VARCHAR) || ':0.99;' AS newick, round(ln(max(v)), 8) AS log_p FROM w5 GROUP BY fam"""


@query(f"WITH {LADDER_SQL} {BEST_SQL}")
def best_tree_levels(spark, sf_dir):
    """The best tree of each family as text, with unit lengths: those of ladders differ where unrooting joins two branches."""
    from cladeflow.operators import tree_levels

    facts, fams = _facts(spark, sf_dir)
    counts = splits.bips(facts).select("family", "clade", F.col("cnt").alias("_cnt")).join(fams.select("family", "observations"), "family")
    one = F.when(F.col("left").isNull(), F.coalesce("_cnt", "observations")).otherwise(0.0)
    level = facts.join(counts, ["family", "clade"], "left").withColumn("bl", one).select(facts.columns)
    return tree_levels.best_trees(level, fams).select("family", "newick", F.round("log_p", 8).alias("log_p"))


@query(_with("SELECT fam, g, gp, gpp, round(p, 9) AS p, true AS within FROM ccp"))
def sampled_splits(spark, sf_dir):
    """Splits of drawn trees: the table's probability, and whether the drawn share is within five standard errors and one tree of it."""
    from cladeflow.operators import tree_levels

    facts, fams = _facts(spark, sf_dir)
    drawn = tree_levels.random_splits(facts, fams, 400).filter(F.length("clade") > 0)
    of = drawn.groupBy("family", "clade", F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right")).agg(F.count(F.lit(1)).alias("_n"))
    all_ = drawn.groupBy("family", "clade").agg(F.count(F.lit(1)).alias("_all"))
    p = ccp.split_probabilities(facts, fams).select("family", "clade", F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right"), "p_dip")
    met = p.join(of, ["family", "clade", "left", "right"], "left").join(all_, ["family", "clade"], "left")
    n, q = F.coalesce("_all", F.lit(1)), F.col("p_dip")
    gap = F.abs(F.coalesce("_n", F.lit(0)) / n - F.when(F.col("_all").isNotNull(), q).otherwise(0.0))
    return met.select(F.col("family").alias("fam"), mask("clade").alias("g"), mask("left").alias("gp"), mask("right").alias("gpp"), F.round(q, 9).alias("p"), (gap <= 5 * F.sqrt(q * (1 - q) / n) + 1 / n).alias("within"))


# --- events and orders ------------------------------------------------------------------------------


@query(f"""WITH {EVENTS_SQL.replace('AS other FROM events', 'AS other, event_id, CAST(user_id % 3 AS INT) AS clade FROM events')}
SELECT family, sample_no, clade, string_agg(kind || '@' || CAST(branch AS VARCHAR) || CASE WHEN other >= 0 THEN '->' || CAST(other AS VARCHAR) ELSE '' END, ' ' ORDER BY event_id) AS trail FROM e GROUP BY ALL""")
def clade_trails(spark, sf_dir):
    """Event trails by clade, users being clades and event numbers the order along a lineage."""
    e = table(spark, sf_dir, "events")
    kind = F.element_at(F.array(*map(F.lit, "DTLOCS")), (F.pmod(F.col("event_id"), F.lit(6)) + 1).cast("int"))
    rows = e.select(
        F.pmod("user_id", F.lit(10)).cast("string").alias("family"), F.pmod("event_id", F.lit(20)).cast("int").alias("sample_no"), F.pmod("user_id", F.lit(3)).cast("int").alias("clade"), F.col("event_id").alias("seq"),
        kind.alias("kind"), F.pmod(F.length("event_type"), F.lit(7)).cast("int").alias("branch"), F.when(kind == "T", F.pmod("event_id", F.lit(5)).cast("int")).otherwise(-1).alias("other"),
    )
    return event_tables.clade_trails(rows)


ORDERS_SQL = f"""WITH RECURSIVE {CONSTRAINT_SQL},
ord(names) AS (SELECT ['a'] UNION ALL SELECT list_append(ord.names, br.name) FROM ord JOIN br ON NOT br.leaf AND list_contains(ord.names, br.parent) AND NOT list_contains(ord.names, br.name)),
full_ AS (SELECT names FROM ord WHERE len(names) = 6),
v AS (SELECT names, (SELECT sum(CASE WHEN list_position(names, older) > list_position(names, younger) THEN weight ELSE 0 END) FROM c WHERE list_contains(names, older) AND list_contains(names, younger)) AS value FROM full_)
SELECT array_to_string(names, '') AS nodes, value, round((SELECT avg(CASE WHEN w.value <= v.value THEN 1.0 ELSE 0.0 END) FROM v w), 9) AS p_value, true AS share_within, true AS p_within FROM v"""


@query(ORDERS_SQL)
def drawn_orders(spark, sf_dir):
    """Orders drawn at random: each that the tree allows, the weight it breaks, the share of all orders that break no more, and whether the draws' shares are within five standard errors."""
    n = 2000
    orders = ordering.draw_orders(spark, TREE, n)
    values = ordering.order_values(_constraints(spark, sf_dir), orders)
    text = orders.groupBy("draw").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]), "").alias("nodes"))  # six places a draw
    found = values.join(text, "draw").groupBy("nodes", "value").agg(F.count(F.lit(1)).alias("_n"))
    every = found.groupBy("value").agg(F.count(F.lit(1)).alias("_orders"), F.sum("_n").alias("_draws"))
    w = Window.orderBy("value")  # one row for each value that an order of six nodes can have
    run = every.select("value", F.sum("_orders").over(w).alias("_orders"), F.sum("_draws").over(w).alias("_draws"))
    all_ = found.agg(F.count(F.lit(1)).alias("_all"))
    near = lambda x, p: F.abs(x / n - p) <= 5 * F.sqrt(p * (1 - p) / n) + 1 / n
    met = found.join(run, "value").join(F.broadcast(all_))
    p = F.col("_orders") / F.col("_all")
    return met.select("nodes", "value", F.round(p, 9).alias("p_value"), near(F.col("_n"), 1 / F.col("_all")).alias("share_within"), near(F.col("_draws"), p).alias("p_within"))


@query(ORDERS_SQL[: ORDERS_SQL.index("v AS (")].rstrip().rstrip(",") + """, g AS (SELECT ['a', 'd', 'b', 'e', 'f', 'c'] AS given),
most AS (SELECT count(*) AS n FROM br x JOIN br y ON x.name < y.name AND NOT x.leaf AND NOT y.leaf WHERE NOT EXISTS (SELECT 1 FROM cl WHERE (above = x.name AND below = y.name) OR (above = y.name AND below = x.name))),
i AS (SELECT names, (SELECT count(*) FROM range(1, 7) a(i) JOIN range(1, 7) b(j) ON i < j WHERE list_position(given, names[i]) > list_position(given, names[j])) AS inversions FROM full_, g)
SELECT array_to_string(names, '') AS nodes, CAST(inversions AS BIGINT) AS inversions, round((n - inversions) / n, 9) AS similarity FROM i, most""")
def order_similarity(spark, sf_dir):
    """How like the given order each drawn one is, by the inversions that the tree allows; a draw for each hundred orders and a thousand more."""
    n = 1000 + table(spark, sf_dir, "orders").count() // 100
    orders = ordering.draw_orders(spark, TREE, n, seed=2)
    text = orders.groupBy("draw").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]), "").alias("nodes"))  # six places a draw
    s = ordering.similarities(TREE, orders, ordering.order_table(spark, list("adbefc"))).join(text, "draw")
    return s.select("nodes", F.col("inversions").cast("long").alias("inversions"), F.round("similarity", 9).alias("similarity")).distinct()
