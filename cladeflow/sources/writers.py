"""Writers: tables as Parquet or delimited text, and the report texts of a family."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.functions.species_tree import SpeciesTree
from cladeflow.operators.splits import of_row
from cladeflow.sources.posterior_text import dumps


def posterior_texts(tables: DataFrame) -> DataFrame:
    """(family, text): nested tables in the tagged text form."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(r["family"], dumps(of_row(r), r["constructor"])) for r in pdf.to_dict("records")], columns=["family", "text"])

    return tables.select("family", "leaves", "observations", "constructor", "facts").mapInPandas(run, "family string, text string")


def write_texts(texts: DataFrame, path: str) -> None:
    """One folder for each family with its text, through Spark's writer, so any store will do."""
    texts.select("family", F.col("text").alias("value")).write.partitionBy("family").text(path)


def write_table(df: DataFrame, path: str, sep: str = "\t", header: bool = True) -> None:
    df.write.option("header", header).csv(path, sep=sep)


def transfer_list(matrix: DataFrame, tree: SpeciesTree) -> DataFrame:
    """from, to, freq lines; a leaf shows as name(number), an inner branch as its number."""
    names = F.array(*(F.lit(f"{tree.names[e]}({e})" if e < tree.n_leaves else str(e)) for e in range(tree.n)))
    return matrix.filter("freq > 0").select(F.element_at(names, F.col("donor") + 1).alias("from"), F.element_at(names, F.col("recipient") + 1).alias("to"), "freq")


def report(fits: DataFrame, totals: DataFrame, branch_rows: DataFrame, sampled: DataFrame, tree: SpeciesTree, presence: DataFrame | None = None, terms: DataFrame | None = None) -> DataFrame:
    """(family, text): species tree, likelihood, rates, sampled trees, mean totals and per-branch means.

    With presence (``event_tables.presence``) and terms (``reconcile.branch_terms``) a branch's line
    goes on with singletons, extinction probability, presence and origination log likelihood.
    """
    s = tree.numbered()
    names = F.array(*(F.lit(tree.branch_name(e)) for e in range(tree.n)))
    kind = F.when(F.col("branch") < tree.n_leaves, "S_terminal_branch").otherwise("S_internal_branch")
    num = lambda c: F.format_string("%.6g", F.col(c))
    cols = ("duplications", "transfers", "losses", "originations", "copies")
    more: tuple[str, ...] = ()
    if presence is not None and terms is not None:
        more = ("singletons", "extinction", "presence", "origin_logl")
        branch_rows = terms.join(branch_rows, ["family", "branch"], "left").join(presence, ["family", "branch"], "left").na.fill(0.0, [*cols, "singletons", "presence"])
    line = F.concat_ws("\t", kind, F.element_at(names, F.col("branch") + 1), *(num(c) for c in (*cols, *more)))
    # Branches of the species tree and the samples asked for bound both lists.
    lines = branch_rows.groupBy("family").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("branch", line.alias("x")))), lambda r: r["x"]), "\n").alias("branches"))
    trees = sampled.groupBy("family").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sample_no", "newick"))), lambda r: r["newick"]), "\n").alias("trees"), F.count(F.lit(1)).alias("n"))
    all_ = fits.join(totals.withColumnsRenamed({"speciations": "sp", "duplications": "d", "transfers": "t", "losses": "l"}), "family").join(lines, "family").join(trees, "family")
    head = F.concat(F.lit(f"S:\t{s}\n\nInput from:\t"), F.col("family"), F.lit("\n>logl: "), num("logl"), F.lit("\nrate of\t Duplications\tTransfers\tLosses\nML \t"), F.concat_ws("\t", num("delta"), num("tau"), num("lambda")), F.lit("\n\n"))
    body = F.concat(F.col("n").cast("string"), F.lit(" reconciled G-s:\n\n"), F.col("trees"), F.lit("\n\n# of\t Duplications\tTransfers\tLosses\tSpeciations\nTotal \t"), F.concat_ws("\t", num("d"), num("t"), num("l"), num("sp")))
    tail = F.concat(F.lit("\n\n# of\t Duplications\tTransfers\tLosses\tOriginations\tcopies" + "".join(f"\t{c}" for c in more) + "\n"), F.col("branches"), F.lit("\n"))
    return all_.select("family", F.concat(head, body, tail).alias("text"))


def branch_trees(branch_rows: DataFrame, tree: SpeciesTree, column: str, per_copy: bool = False) -> DataFrame:
    """(family, newick): the species tree with a column of per-branch means as branch lengths, per_copy divided by copies where there are over one."""
    value = F.col(column) / F.greatest(F.lit(1.0), F.col("copies")) if per_copy else F.col(column)
    maps = branch_rows.groupBy("family").agg(F.map_from_entries(F.collect_list(F.struct("branch", value.cast("double").alias("v")))).alias("of"))
    names = [tree.branch_name(e) for e in range(tree.n)]

    def render(e: int, of: dict[int, float]) -> str:
        inner = f"({render(int(tree.left[e]), of)},{render(int(tree.right[e]), of)})" if e >= tree.n_leaves else ""
        return f"{inner}{names[e]}:{of.get(e, 0.0):.6g}"

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(f, render(tree.root, dict(of)) + ";") for f, of in zip(pdf["family"], pdf["of"])], columns=["family", "newick"])

    return maps.mapInPandas(run, "family string, newick string")


def constraint_lines(constraints: DataFrame) -> DataFrame:
    """family,older,younger,support[,distance] as one column of text."""
    cols = [c for c in ("family", "older", "younger", "support", "weight", "distance") if c in constraints.columns and not (c == "weight" and "support" in constraints.columns)]
    return constraints.select(F.concat_ws(",", *(F.col(c).cast("string") for c in cols)).alias("value"))


def packing_lines(packed: DataFrame) -> DataFrame:
    return packed.orderBy("cpu", "time", "file").select(F.concat_ws("\t", "file", F.col("cpu").cast("string"), F.col("time").cast("string")).alias("value"))


def event_lists(sampled: DataFrame, chain: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rates, events and trees of a chain as three tables."""
    events = sampled.select("family", "sample_no", F.explode("events").alias("e")).groupBy("family", "sample_no").pivot("e.kind", ["D", "T", "L", "S", "O"]).count().na.fill(0)
    return chain.select("family", "iteration", "delta", "tau", "lambda", "logl"), events, sampled.select("family", "sample_no", "newick")


def consensus_texts(sampled: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(family, text): the majority-rule tree and the one by parsimony of a family's reconciled trees, their event labels left out.

    Families of one gene have no tree.
    """
    from cladeflow.operators import ccp, event_tables, splits

    plain = event_tables.leaf_labels(sampled.filter(F.col("newick").contains("(")).select("family", F.col("sample_no").alias("tree_no"), "newick"))
    facts, fams = splits.split_facts(plain), splits.families(plain)
    both = ccp.consensus(facts, fams, threshold).join(ccp.parsimony_consensus(facts, fams).select("family", F.col("newick").alias("least")), "family")
    return both.select("family", F.concat_ws("\n", "newick", "least").alias("text"))


def dated_report(fits: DataFrame, best: DataFrame, means: DataFrame, tree: SpeciesTree) -> DataFrame:
    """(family, text): species tree, likelihood, rates, the best reconciliation and per-branch means of the dated model.

    fits are from ``dated.fit``, best from ``dated.best_reconciliation`` and means from ``event_tables.branch_means``.
    """
    names = F.array(*(F.lit(tree.branch_name(e)) for e in range(tree.n)))
    kind = F.when(F.col("branch") < tree.n_leaves, "S_terminal_branch").otherwise("S_internal_branch")
    num = lambda c: F.format_string("%.6g", F.col(c).cast("double"))
    own = means.filter((F.col("branch") >= 0) & (F.col("branch") < tree.n))
    line = F.concat_ws("\t", kind, F.element_at(names, F.col("branch") + 1), *(num(c) for c in ("duplications", "transfers", "losses", "copies")))
    # The branches of the species tree bound the list.
    lines = own.groupBy("family").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("branch", line.alias("x")))), lambda r: r["x"]), "\n").alias("branches"))
    met = fits.join(best.select("family", "newick"), "family").join(lines, "family", "left").na.fill("", ["branches"])
    head = F.concat(F.lit(f"S:\t{tree.numbered()}\n\nInput from:\t"), F.col("family"), F.lit("\n>logl: "), num("logl"), F.lit("\nrate of\t Duplications\tTransfers\tLosses\nML \t"), F.concat_ws("\t", num("delta"), num("tau"), num("lambda")))
    return met.select("family", F.concat(head, F.lit("\n\n1 reconciled G-s:\n\n"), F.col("newick"), F.lit("\n\n# of\t Duplications\tTransfers\tLosses\tcopies\n"), F.col("branches"), F.lit("\n")).alias("text"))
