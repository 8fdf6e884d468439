"""Readers: each returns a DataFrame, with line numbers where order matters.

Lines are numbered where Spark reads them: each split of a file counts its own, and the counts
of the splits before it are added. A file of any size is read in as many tasks as Spark cuts it
into, and no task or row holds all of it; the numbers don't depend on the cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from cladeflow.functions import newick
from cladeflow.operators.batches import over_batches


def numbered_lines(spark: SparkSession, path: str | list[str], keep: Column | None = None) -> DataFrame:
    """(path, file, split, line_no from 0, line) of text files; with keep, a condition on line, only those lines are there and are numbered.

    split is the byte at which the part of the file begins that a line was read with.
    """
    m = F.col("_metadata")
    lines = spark.read.text(path).select(m["file_path"].alias("path"), m["file_name"].alias("file"), m["file_block_start"].alias("split"), F.col("value").alias("line"))
    # Ids rise by one from line to line within a task, and a task reads the splits that it has one after another.
    lines = (lines if keep is None else lines.filter(keep)).withColumn("_id", F.monotonically_increasing_id())
    parts = lines.groupBy("path", "split").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))  # one row per split
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("path", "split", "_first", "_before")
    met = lines.join(parts, ["path", "split"])
    return met.select("path", "file", "split", (F.col("_before") + F.col("_id") - F.col("_first")).alias("line_no"), "line")


def chosen(tree_no: Column, burnin: int, every: int, mode: str = "observe") -> Column:
    """Which trees of a sample count, tree_no from 1. "observe": past the burn-in and divisible by every;
    "add": numbered from 0, at or past the burn-in and divisible."""
    if mode == "observe":
        return (tree_no > burnin) & (tree_no % every == 0)
    if mode == "add":
        return (tree_no - 1 >= burnin) & ((tree_no - 1) % every == 0)
    raise ValueError(mode)


def tree_samples(spark: SparkSession, path: str | list[str], family: Column | None = None, burnin: int = 0, every: int = 1, until: int = -1, mode: str = "observe") -> DataFrame:
    """family, file, tree_no, newick of tree lists, a tree a line.

    A line with a parenthesis is a tree; one without, but with a semicolon, is a family of one
    gene. Burn-in and thinning go by tree within each file; until keeps so many of each family,
    in the order of its files' names. The family is the file's name unless another expression
    over file and path is given.
    """
    many, one = F.col("line").contains("("), ~F.col("line").contains("(") & F.col("line").contains(";")
    rows = numbered_lines(spark, path, many | one).withColumn("tree_no", F.col("line_no") + 1)
    rows = rows.filter(chosen(F.col("tree_no"), burnin, every, mode) | one).withColumn("family", family if family is not None else F.col("file")).withColumn("newick", F.trim("line"))
    if until >= 0:
        # A tree's place in its family: the trees of its own split before it, and those of earlier splits and files.
        parts = rows.groupBy("family", "file", "path", "split").agg(F.count(F.lit(1)).alias("_n"))
        before = Window.partitionBy("family").orderBy("file", "path", "split").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).filter(F.col("_before") < until).drop("_n")
        here = Window.partitionBy("family", "path", "split").orderBy("tree_no")
        rows = rows.join(parts, ["family", "file", "path", "split"]).withColumn("_k", F.col("_before") + F.row_number().over(here)).filter(F.col("_k") <= until)
    return rows.select("family", "file", F.col("tree_no").cast("long").alias("tree_no"), "newick")


def trees_from_strings(spark: SparkSession, trees: list[str] | dict[str, list[str]]) -> DataFrame:
    by = trees if isinstance(trees, dict) else {"family": trees}
    return spark.createDataFrame([(f, k + 1, t) for f, ts in by.items() for k, t in enumerate(ts)], "family string, tree_no int, newick string")


def nexus_trees(spark: SparkSession, path: str | list[str], burnin: int = 0, every: int = 1) -> DataFrame:
    """family, tree_no, newick of Nexus files, with leaf numbers translated to names.

    Tree lines are rows, whatever their number; the lines between them, which hold the
    translation, are gathered by file.
    """
    low = F.lower(F.trim("line"))
    is_tree = (low.startswith("tree ") | low.startswith("utree ")) & F.col("line").contains("(")
    head = numbered_lines(spark, path, ~is_tree).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("_head"))

    def names(lines) -> list[tuple[str, str]]:
        out, table = {}, False
        for x in lines:
            line = x["line"].strip()
            if line.lower().startswith("translate"):
                table, line = True, line[9:]
            if table:
                for part in line.rstrip(";").split(","):
                    words = part.split()
                    if len(words) == 2:
                        out[words[0]] = words[1]
                table = not line.endswith(";")
        return list(out.items())

    def named(line: str, pairs) -> str:
        of = dict(pairs or ())
        root = newick.parse(line[line.index("(") :])
        for leaf in root.leaves():
            leaf.name = of.get(leaf.name, leaf.name)
        return newick.write(root)

    head = head.select("path", over_batches(names, MapType(StringType(), StringType()))("_head").alias("_names"))
    rows = numbered_lines(spark, path, is_tree).withColumn("tree_no", (F.col("line_no") + 1).cast("int")).filter(chosen(F.col("tree_no"), burnin, every))
    return rows.join(head, "path", "left").select(F.col("file").alias("family"), "tree_no", over_batches(named, StringType())("line", "_names").alias("newick"))


def species_tree(spark: SparkSession, path: str, last: bool = False) -> str:
    """The first tree line of a file, or the last."""
    lines = numbered_lines(spark, path).filter(F.col("line").contains("("))
    pick = F.max_by if last else F.min_by
    return lines.agg(pick("line", "line_no")).first()[0].strip()


def fraction_missing(spark: SparkSession, path: str) -> DataFrame:
    """species, fraction of lines like species:fraction."""
    return spark.read.csv(path, sep=":", schema="species string, fraction double").filter("species IS NOT NULL")


def key_values(tokens: list[str]) -> dict[str, str]:
    """Options written as key=value or key:value."""
    import re

    return {k: v for k, v in (re.split("[=:]", t, maxsplit=1) for t in tokens if re.search("[=:]", t))}


def options(lines: DataFrame, column: str = "value") -> DataFrame:
    """lines with key and value of tokens written as key=value or key:value; others are left out."""
    parts = F.split(column, "[=:]", 2)
    return lines.filter(F.col(column).rlike("[=:]")).withColumns({"key": parts[0], "value": parts[1]})


def reconciliation_files(spark: SparkSession, path: str) -> DataFrame:
    """family, species_tree, delta, tau, lambda and the array of reconciled trees of report files."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("family"), F.col("value").alias("v"))
    rates = F.split(F.regexp_extract("v", r"(?m)^ML[ \t]+([^\n]*)", 1), r"\s+")
    body = F.regexp_replace("v", r"(?s)^.*reconciled G[^\n]*?:", "")
    trees = F.regexp_extract_all(body, F.lit(r"(?m)^\s*(\([^\n]*;|[^#\s][^\n(]*;)"), 1)
    return t.select(
        "family",
        F.trim(F.regexp_extract("v", r"(?m)^S:\s*([^\n]*)", 1)).alias("species_tree"),
        *(F.try_element_at(rates, F.lit(k + 1)).try_cast("double").alias(n) for k, n in enumerate(("delta", "tau", "lambda"))),
        trees.alias("reconciled"),
    )


def distributed_list(spark: SparkSession, path: str) -> DataFrame:
    """file, cpu, time of a packing list; lines without exactly three fields are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(parts.alias("p")).filter(F.size("p") == 3)
    return rows.select(F.col("p")[0].alias("file"), F.col("p")[1].cast("int").alias("cpu"), F.col("p")[2].cast("double").alias("time"))


def runtimes(spark: SparkSession, path: str) -> DataFrame:
    """time, clades, genes, species, file of a runtime list."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(p.alias("p")).filter(F.size("p") >= 5)
    kinds = ("double", "long", "long", "long", "string")
    return rows.select(*(F.col("p")[k].cast(t).alias(n) for k, (n, t) in enumerate(zip(("time", "clades", "genes", "species", "file"), kinds))))


def constraints(spark: SparkSession, path: str, least_distance: float | None = None, root: str = "root") -> DataFrame:
    """older, younger, weight of constraint lists, equal ones added up.

    Lines are family,older,younger[,weight[,distance]] or older younger [weight]; comments and
    headers are skipped, a weight defaults to 1, and the name None stands for the root.
    """
    line = F.trim("value")
    rows = spark.read.text(path).select(line.alias("v")).filter(~F.col("v").startswith("#") & ~F.col("v").contains("FRQ") & (F.col("v") != ""))
    csv = F.col("v").contains(",")
    p = F.when(csv, F.slice(F.split("v", r"\s*,\s*"), F.lit(2), F.lit(8))).otherwise(F.split("v", r"\s+"))
    got = rows.select(p.alias("p")).filter(F.size("p") >= 2)
    at = lambda k: F.try_element_at(F.col("p"), F.lit(k))
    out = got.select(at(1).alias("older"), at(2).alias("younger"), F.coalesce(at(3).try_cast("double"), F.lit(1.0)).alias("weight"), at(4).try_cast("double").alias("distance"))
    if least_distance is not None:
        out = out.filter(F.col("distance").isNull() | (F.col("distance") > least_distance))
    name = lambda c: F.when(F.col(c) == "None", F.lit(root)).otherwise(F.col(c)).alias(c)
    return out.select(name("older"), name("younger"), "weight").groupBy("older", "younger").agg(F.sum("weight").alias("weight"))
