"""What is read off sampled events: per-branch means, transfers, histograms, rates and reports.

Input is the fact table (family, sample_no, kind, branch, other) of ``reconcile.events``.
Everything is one aggregation, with counts combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = {"D": "duplications", "T": "transfers", "L": "losses", "O": "originations", "C": "copies"}


def _mean(kind: str, samples: Column) -> Column:
    return F.sum(F.when(F.col("kind") == kind, 1).otherwise(0)) / samples


def branch_means(events: DataFrame, n_samples: int, by: tuple[str, ...] = ("family",)) -> DataFrame:
    """Mean numbers of events of each branch, incoming transfers, and copies: a gene counts where it ends its stay on a branch."""
    home = events.filter("kind = 'T'").select(*by, "sample_no", F.lit("R").alias("kind"), F.col("other").alias("branch"), F.lit(-1).alias("other"))
    rows = events.select(*by, "sample_no", "kind", "branch", "other").unionByName(home)
    n = F.lit(float(n_samples))
    out = [_mean(k, n).alias(v) for k, v in KINDS.items() if k != "C"] + [_mean("R", n).alias("received")]
    return rows.groupBy(*by, "branch").agg(*out, (F.sum(F.when(F.col("kind").isin("C", "S"), 1).otherwise(0)) / n).alias("copies"))


def presence(events: DataFrame, n_samples: int) -> DataFrame:
    """Share of samples in which a family has a gene on the branch, and in which it has exactly one."""
    per = events.filter(F.col("kind").isin("C", "S")).groupBy("family", "branch", "sample_no").agg(F.count(F.lit(1)).alias("n"))
    n = F.lit(float(n_samples))
    return per.groupBy("family", "branch").agg((F.count(F.lit(1)) / n).alias("presence"), (F.sum(F.when(F.col("n") == 1, 1).otherwise(0)) / n).alias("singletons"))


def totals(events: DataFrame, n_samples: int) -> DataFrame:
    """Mean numbers of events of each family over all branches."""
    n = F.lit(float(n_samples))
    return events.groupBy("family").agg(*(_mean(k, n).alias(v) for k, v in KINDS.items() if k != "C"), _mean("S", n).alias("speciations"))


def transfer_matrix(events: DataFrame, n_samples: int, by_family: bool = False) -> DataFrame:
    """Mean number of transfers from branch to branch."""
    keys = (["family"] if by_family else []) + ["branch", "other"]
    g = events.filter("kind = 'T'").groupBy(*keys).agg((F.count(F.lit(1)) / F.lit(float(n_samples))).alias("freq"))
    return g.withColumnsRenamed({"branch": "donor", "other": "recipient"})


def histogram(events: DataFrame, n_samples: int, most: int = 9) -> DataFrame:
    """Share of samples with 0 to most events of each kind on each branch of a family."""
    per = events.groupBy("family", "kind", "branch", "sample_no").agg(F.count(F.lit(1)).alias("n"))
    g = per.groupBy("family", "kind", "branch")
    n = F.lit(float(n_samples))
    some = [(F.sum(F.when(F.col("n") == k, 1).otherwise(0)) / n).alias(f"n{k}") for k in range(1, most + 1)]
    return g.agg((1 - F.count(F.lit(1)) / n).alias("n0"), *some)


def cumulative_copies(means: DataFrame, branches: DataFrame) -> DataFrame:
    """Running sum of copies from the root to the tips, by branch rank within each family."""
    w = Window.partitionBy("family").orderBy(F.desc("rank"), "branch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return means.join(F.broadcast(branches.select("branch", "rank")), "branch").withColumn("cumulative", F.sum("copies").over(w))


def rate_estimates(means: DataFrame, by_branch: bool = True) -> DataFrame:
    """Event probabilities from mean counts (branch, duplications, transfers, losses, copies).

    A branch's duplications and losses are per copy on it; its transfers per copy anywhere,
    times the number of branches. None is below 1e-6; not by_branch gives their mean.
    """
    g = means.groupBy("branch").agg(*(F.sum(c).alias(c) for c in ("duplications", "transfers", "losses", "copies")))
    every = g.agg(F.sum("copies").alias("_all"), F.count(F.lit(1)).alias("_n"))
    low = lambda c: F.greatest(F.lit(1e-6), F.coalesce(c, F.lit(0.0)))
    own = F.nullif(F.col("copies"), F.lit(0.0))
    out = g.join(F.broadcast(every)).select(
        "branch", low(F.col("duplications") / own).alias("delta"), low(F.col("transfers") / F.nullif(F.col("_all"), F.lit(0.0)) * F.col("_n")).alias("tau"), low(F.col("losses") / own).alias("lambda")
    )
    return out if by_branch else out.agg(*(F.avg(c).alias(c) for c in ("delta", "tau", "lambda")))


def leaf_labels(sampled: DataFrame) -> DataFrame:
    """Reconciled trees without events in their labels, for a consensus."""
    return sampled.withColumn("newick", F.regexp_replace(F.regexp_replace("newick", r"([(,][^(),:.@]+)[.@][^(),:]*", "$1"), r"\)[^(),:;]+", ")"))


def trails(events: DataFrame) -> DataFrame:
    """The events of each sample as one text, in order of branch and kind."""
    word = F.concat_ws("", F.col("kind"), F.lit("@"), F.col("branch"), F.when(F.col("other") >= 0, F.concat(F.lit("->"), F.col("other"))))
    return events.groupBy("family", "sample_no").agg(F.array_join(F.array_sort(F.collect_list(word)), " ").alias("trail"))


def clade_trails(events: DataFrame) -> DataFrame:
    """family, sample_no, clade, trail: the events of each gene clade of each sample, the oldest first.

    events are rows with clade and seq, as ``reconcile.trail_events`` gives them; a trail is
    gathered for one lineage, and is as long as that has events.
    """
    word = F.concat_ws("", F.col("kind"), F.lit("@"), F.col("branch"), F.when(F.col("other") >= 0, F.concat(F.lit("->"), F.col("other"))))
    rows = events.groupBy("family", "sample_no", "clade").agg(F.array_sort(F.collect_list(F.struct("seq", word.alias("word")))).alias("found"))
    return rows.select("family", "sample_no", "clade", F.array_join(F.transform("found", lambda x: x["word"]), " ").alias("trail"))
