"""URL filtering: host and path rules, then gradient-boosted trees over lexical features.

Everything is DataFrame expressions: features are SQL functions of the URL; a tree level is
fitted from one aggregation of gradients by node, feature and bin, of which the driver gets
a bounded number of rows; the finished model is one SQL expression.

Defined cases: a null URL, or one without ``://``, has an empty host and path, matches no
rule and is judged by its features; with no labelled URL all that no rule decides is
allowed; of rules of equal length the first listed wins; rows that repeat a page_id are
judged each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeflow.llm.common import scratch_table

#: (verdict, host, path) of the production rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: A URL is labelled as unwanted if a part of its host is one of these words, and as wanted otherwise.
UNWANTED = ("adult", "ads", "bets", "casino", "escort", "loans", "pills", "porn", "slots", "spam", "track", "viagra", "warez", "win", "xxx")
#: Labelled URLs that the trees are fitted on, at most in the mean; distinct URLs are chosen by their hash.
TRAIN_ROWS = 20_000
TREES, DEPTH, RATE, RIDGE, BINS = 10, 3, 0.4, 1.0, 24
#: Features and the range that their bins divide evenly.
RANGES = {
    "url_length": (10, 130), "host_length": (4, 52), "path_depth": (0, 12), "host_labels": (1, 7), "digit_ratio": (0, 0.6), "host_digits": (0, 12), "hyphens": (0, 6), "entropy": (1.5, 4.5),
    "parameters": (0, 6), "longest_label": (2, 26), "vowel_ratio": (0, 0.6), "suffix_rate": (0, 1),
}


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, with A-Z lower-cased, and the path of a URL; empty where there is no ``://``."""
    u = F.coalesce(url, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1), upper, upper.lower())
    return host, F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path in a row, and its verdict; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for say, name, start in sorted(reversed(rules), key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(say)).otherwise(verdict)
    return rule, verdict


def _size_of(text: Column, chars: str) -> Column:
    """How many characters of text are among the ASCII letters given."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def features(rows: DataFrame) -> DataFrame:
    """rows (url, host, path) with the lexical features, but for suffix_rate, and the host's suffix."""
    u, host = F.coalesce(F.col("url"), F.lit("")), F.col("host")
    chars = F.split(host, "")
    n = F.greatest(F.length(host), F.lit(1)).cast("double")
    share = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    entropy = F.aggregate(share, F.lit(0.0), lambda total, p: total - p * F.log2(p))
    labels = F.split(host, r"\.")
    length = F.greatest(F.length(u), F.lit(1))
    return rows.select(
        *rows.columns,
        F.length(u).cast("double").alias("url_length"),
        F.length(host).cast("double").alias("host_length"),
        _size_of(F.col("path"), "/").cast("double").alias("path_depth"),
        F.size(labels).cast("double").alias("host_labels"),
        (_size_of(u, "0123456789") / length).alias("digit_ratio"),
        _size_of(host, "0123456789").cast("double").alias("host_digits"),
        _size_of(host, "-").cast("double").alias("hyphens"),
        F.when(F.length(host) == 0, 0.0).otherwise(entropy).alias("entropy"),
        _size_of(u, "&=").cast("double").alias("parameters"),
        F.array_max(F.transform(labels, lambda x: F.length(x))).cast("double").alias("longest_label"),
        (_size_of(host, "aeiou") / n).alias("vowel_ratio"),
        F.substring_index(host, ".", -1).alias("suffix"),
    )


def weak_labels(host: Column) -> Column:
    """1 for a host that has an unwanted word between dots or hyphens, else 0."""
    return F.arrays_overlap(F.split(host, r"[.-]"), F.array(*map(F.lit, UNWANTED))).cast("double")


def binned(rows: DataFrame) -> DataFrame:
    """Each feature as a bin number from 0 to BINS + 1."""
    return rows.withColumns({f: F.coalesce(F.width_bucket(f, F.lit(float(lo)), F.lit(float(hi)), F.lit(BINS)), F.lit(0)).cast("int") for f, (lo, hi) in RANGES.items()})


@dataclass
class Node:
    value: float = 0.0
    feature: str = ""
    at: int = 0
    low: Node | None = None
    high: Node | None = None

    def column(self) -> Column:
        if self.low is None:
            return F.lit(self.value)
        return F.when(F.col(self.feature) <= self.at, self.low.column()).otherwise(self.high.column())

    def place(self, leaves: dict[int, Node]) -> Column:
        """The number of the open leaf that a row falls into; -1 for closed ones."""
        if self.low is None:
            return F.lit(next((k for k, x in leaves.items() if x is self), -1))
        return F.when(F.col(self.feature) <= self.at, self.low.place(leaves)).otherwise(self.high.place(leaves))


def margin(trees: list[Node], start: float) -> Column:
    return reduce(lambda total, tree: total + tree.column(), trees, F.lit(start))


def fit_trees(table: DataFrame, start: float) -> list[Node]:
    """Boost trees on a stored table of binned features with a weight n and a sum of labels."""
    trees: list[Node] = []
    names = list(RANGES)
    for _ in range(TREES):
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin(trees, start)))
        root = Node()
        leaves = {0: root}
        for level in range(DEPTH + 1):
            graded = table.select(*names, root.place(leaves).alias("node"), (F.col("n") * p - F.col("positive")).alias("g"), (F.col("n") * p * (1 - p)).alias("h")).filter("node >= 0")
            if level == DEPTH:
                sums = {r["node"]: (r["g"], r["h"]) for r in graded.groupBy("node").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()}
                for k, leaf in leaves.items():
                    g, h = sums.get(k, (0.0, 0.0))
                    leaf.value = -RATE * g / (h + RIDGE)
                break
            each = graded.select("node", "g", "h", F.posexplode(F.array(*names)).alias("f", "bin"))
            cells: dict[tuple[int, int], dict[int, tuple[float, float]]] = {}
            for r in each.groupBy("node", "f", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():  # 2 ** DEPTH nodes times features times bins at most
                cells.setdefault((r["node"], r["f"]), {})[r["bin"]] = (r["g"], r["h"])
            grown: dict[int, Node] = {}
            for k, leaf in leaves.items():
                best = (1e-6, -1, 0)
                for f in range(len(names)):
                    bins = cells.get((k, f), {})
                    g, h = sum(x[0] for x in bins.values()), sum(x[1] for x in bins.values())
                    gl = hl = 0.0
                    for b in sorted(bins)[:-1]:
                        gl, hl = gl + bins[b][0], hl + bins[b][1]
                        gain = gl * gl / (hl + RIDGE) + (g - gl) ** 2 / (h - hl + RIDGE) - g * g / (h + RIDGE)
                        if gain > best[0] + 1e-9:
                            best = (gain, f, b)
                if best[1] >= 0:
                    leaf.feature, leaf.at, leaf.low, leaf.high = names[best[1]], best[2], Node(), Node()
                    grown[2 * k], grown[2 * k + 1] = leaf.low, leaf.high
                else:
                    grown[2 * k] = leaf
            leaves = grown
        trees.append(root)
    return trees


@dataclass
class UrlModel:
    trees: list[Node]
    start: float
    #: Smoothed share of unwanted URLs by the last label of the host; a table of TRAIN_ROWS rows at most.
    suffixes: DataFrame
    overall: float

    def margins(self, rows: DataFrame) -> DataFrame:
        """rows (with url, host, path) and their margin: above 0 means unwanted."""
        wide = features(rows).join(F.broadcast(self.suffixes), "suffix", "left").withColumn("suffix_rate", F.coalesce("rate", F.lit(self.overall)))
        return binned(wide).select(*rows.columns, margin(self.trees, self.start).alias("margin"))


def fit(labelled: DataFrame) -> UrlModel:
    """labelled: url, host, path and label (1 unwanted, 0 wanted)."""
    known = labelled.filter(F.col("label").isNotNull() & F.col("url").isNotNull())
    # A URL counts once, with the mean of its labels, however many rows have it.
    known = scratch_table(known.groupBy("url", "host", "path").agg(F.avg("label").alias("label")), "labelled-urls")
    total = known.count()
    part = min(1.0, TRAIN_ROWS / max(total, 1))
    chosen = known.filter(F.pmod(F.xxhash64("url"), F.lit(1 << 62)) < int(part * (1 << 62)) if part < 1 else F.lit(True))
    wide = scratch_table(features(chosen), "url-features")
    n, positive = wide.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    overall = (positive + 1) / (n + 2)
    suffixes = scratch_table(wide.groupBy("suffix").agg(((F.sum("label") + 20 * overall) / (F.count(F.lit(1)) + 20)).alias("rate")), "url-suffixes")
    if not n:
        return UrlModel([], 0.0, suffixes, overall)
    rated = wide.join(F.broadcast(suffixes), "suffix").withColumn("suffix_rate", F.col("rate"))
    table = scratch_table(binned(rated).groupBy(*RANGES).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("label").alias("positive")).coalesce(1), "url-bins")
    start = math.log(overall / (1 - overall))
    return UrlModel(fit_trees(table, start), start, suffixes, overall)


def url_filter(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's margin for every row of pages.

    labelled gives url and label; without it, hosts with an unwanted word label the pages' own URLs.
    """

    def parsed(df: DataFrame, *more: str) -> DataFrame:
        host, path = host_and_path(F.col("url"))
        return df.select(*more, "url", host.alias("host"), path.alias("path"))

    rows = parsed(pages, "page_id")
    known = parsed(labelled, "label") if labelled is not None else rows.select("url", "host", "path", weak_labels(F.col("host")).alias("label"))
    judged = fit(known).margins(rows)
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("margin") > 0, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "margin")
