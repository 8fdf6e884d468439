"""The library's programs as functions on files and DataFrames, one for each task of a tree study."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeflow.functions.dated_model import DatedRates
from cladeflow.functions.species_tree import read_species_tree
from cladeflow.functions.undated_model import Rates
from cladeflow.operators import ccp, dated, event_tables, ordering, reconcile, scheduling, simulate, splits
from cladeflow.operators.stored import stored
from cladeflow.sources import posterior_text, readers, writers


def observe(spark: SparkSession, path: str | list[str], burnin: int = 0, every: int = 1, until: int = -1) -> DataFrame:
    """Nested clade tables of tree lists, a family for each file."""
    return splits.tables(readers.tree_samples(spark, path, burnin=burnin, every=every, until=until))


def load(spark: SparkSession, path: str) -> DataFrame:
    """Nested clade tables of files in the tagged text form."""
    import pandas as pd

    from cladeflow.functions.clade_table import pack_mask

    def run(batches):
        for pdf in batches:
            rows = []
            for family, text in zip(pdf["family"], pdf["text"]):
                t = posterior_text.loads(text)
                constructor = text.split("\n", 2)[1].strip()
                facts = [(pack_mask(g, t.n), pack_mask(a, t.n), pack_mask(b, t.n), n, 0.0) for (g, a, b), n in t.dips.items()]
                whole = {d[0] for d in t.dips}
                facts += [(pack_mask(g, t.n), None, None, 0.0 if g in whole else t.bips.get(g, 0.0), x) for g, x in {**dict.fromkeys(t.bips, 0.0), **t.lengths}.items()]
                rows.append((family, t.n, t.leaves, t.observations, int(t.observations), constructor, [dict(zip(("clade", "left", "right", "cnt", "bl"), f)) for f in facts]))
            yield pd.DataFrame(rows, columns=["family", "n_leaves", "leaves", "observations", "n_trees", "constructor", "facts"])

    return posterior_text.read_posteriors(spark, path).mapInPandas(run, splits.TABLES)


def save(tables: DataFrame, path: str) -> None:
    """Write nested clade tables in the tagged text form, a folder for each family."""
    writers.write_texts(writers.posterior_texts(tables), path)


def add(tables: DataFrame, trees: DataFrame, weight: float = 1.0) -> DataFrame:
    """Tables with more trees (family, tree_no, newick) counted in, each with a weight."""
    more = splits.tables(trees.withColumn("weight", F.lit(weight)))
    keys = ["clade", "left", "right"]
    both = tables.unionByName(more)
    facts = both.select("family", F.explode("facts").alias("f")).groupBy("family", *(f"f.{k}" for k in keys)).agg(F.sum("f.cnt").alias("cnt"), F.sum("f.bl").alias("bl"))
    nested = facts.groupBy("family").agg(F.collect_list(F.struct(*keys, "cnt", "bl")).alias("facts"))
    fams = splits.add_families(tables.drop("facts"), more.drop("facts"))
    return fams.join(nested, "family").select(*tables.columns)


count_trees = ccp.count_trees
best_trees = ccp.best_trees
leaf_census = splits.leaf_census
fit_undated = reconcile.fit
mcmc_undated = reconcile.mcmc
fit_global = reconcile.fit_global
em_rates = reconcile.em_rates
search_species_tree = reconcile.search_species_tree
fit_dated = dated.fit
mcmc_dated = dated.mcmc
best_dated = dated.best_reconciliation
simulate_trees = simulate.simulate
rank = ordering.rank
pack = scheduling.pack


def score(tables: DataFrame, trees: DataFrame) -> DataFrame:
    """family, tree_no, log_p of trees under the tables of their families; -inf for trees on other leaves.

    Splits of trees meet those of the tables; no family's table travels with a tree.
    """
    met = trees.select("family", F.col("tree_no").cast("long").alias("tree_no"), "newick").join(tables.select("family", "leaves"), "family")
    same = splits.leaf_names("newick") == F.array_sort("leaves")
    few = F.size("leaves") < 4
    known = met.filter(same & ~few)
    scored = ccp.score_trees(known, splits.facts_of(tables), tables).select("family", "tree_no", F.col("log_p").alias("_log_p"))
    log_p = F.when(~same, F.lit(float("-inf"))).when(few, 0.0).otherwise(F.col("_log_p"))
    return met.join(scored, ["family", "tree_no"], "left").select("family", "tree_no", log_p.alias("log_p"))


def evaluate(spark: SparkSession, species: str, gene_trees: DataFrame, rates: Rates | None = None, n_samples: int = 100) -> dict[str, DataFrame]:
    """Single gene trees at fixed rates: likelihoods, reconciled samples, per-branch means and transfers."""
    return reconcile_all(splits.tables(gene_trees), species, rates or Rates(), n_samples)


def reconcile_all(tables: DataFrame, species: str, rates: Rates | DataFrame, n_samples: int = 100, seed: int = 0, options: Rates | None = None) -> dict[str, DataFrame]:
    """Samples at given rates, or at each family's fitted ones, with what is read off them; options are those of the model that was fitted."""
    sampled = reconcile.samples(tables, species, rates, n_samples, seed, options)
    ev = reconcile.events(sampled)
    fits = rates if isinstance(rates, DataFrame) else reconcile.loglik(tables, species, rates).select("family", "logl", *(F.lit(x).alias(n) for n, x in (("delta", rates.delta), ("tau", rates.tau), ("lambda", rates.lambda_))))
    means, totals, seen = event_tables.branch_means(ev, n_samples), event_tables.totals(ev, n_samples), event_tables.presence(ev, n_samples)
    terms = reconcile.branch_terms(tables, species, rates, options)
    tree = read_species_tree(species)
    return {
        "fits": fits, "samples": sampled, "events": ev, "branches": means, "totals": totals, "presence": seen, "terms": terms,
        "transfers": writers.transfer_list(event_tables.transfer_matrix(ev, n_samples), tree), "report": writers.report(fits, totals, means, sampled, tree, seen, terms),
    }


def chain_report(tables: DataFrame, chain: DataFrame, species: str, start: Rates | None = None, n_samples: int = 1, seed: int = 0) -> dict[str, DataFrame]:
    """What is read off a chain: its trace, reconciled trees at each kept step, their events, per-branch means, totals, transfers and consensus trees.

    All families have the same number of kept steps, so means are over that many trees.
    """
    sampled = stored(reconcile.chain_samples(tables, chain, species, start, n_samples, seed), "chain-samples")
    steps = chain.groupBy("family").count().agg(F.max("count")).first()[0] or 0
    n = max(steps * n_samples, 1)
    ev, tree = reconcile.events(sampled), read_species_tree(species)
    return {
        "trace": chain, "samples": sampled, "events": ev, "branches": event_tables.branch_means(ev, n), "totals": event_tables.totals(ev, n), "presence": event_tables.presence(ev, n),
        "transfers": writers.transfer_list(event_tables.transfer_matrix(ev, n), tree), "consensus": writers.consensus_texts(sampled),
    }


def resample(spark: SparkSession, reports: str, tables: DataFrame, n_samples: int = 100) -> DataFrame:
    """Samples at the rates stored in report files, matched to tables by family."""
    rates = readers.reconciliation_files(spark, reports).select("family", "species_tree", "delta", "tau", "lambda", F.lit(1.0).alias("origin_root"))
    found = [r[0] for r in rates.select("species_tree").distinct().orderBy("species_tree").collect()]  # a study has a few species trees
    if not found:
        raise ValueError("no reports")
    return reduce(DataFrame.unionByName, (reconcile.samples(tables, t, rates.filter(F.col("species_tree") == t), n_samples) for t in found))


def constraints(sampled: DataFrame, spark: SparkSession, species: str, n_samples: int, least: float = 0.05) -> DataFrame:
    """Time-order constraints from sampled reconciliations: counted by family, opposites cancelled, with a least support."""
    branches = ordering.branch_table(spark, read_species_tree(species).numbered())
    found = ordering.transfer_constraints(ordering.transfers(sampled), branches)
    return ordering.supported(ordering.cancel(found, ("family",)), n_samples, least, branches)


def dated_loglik(tables: DataFrame, species: str, rates: DatedRates | None = None) -> DataFrame:
    return dated.loglik(tables, species, rates)
