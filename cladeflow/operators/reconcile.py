"""Reconciliation of gene families with a species tree, one family per row or group of tasks.

Families come as nested tables (``splits.tables``). They are independent given the rates, so
likelihoods, fits, samples and chains are maps over families; what has to be summed over
families is an ordinary aggregation. The species tree and the rates travel with the task.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.functions.clade_table import pack_mask
from cladeflow.functions.quasi_newton import descend
from cladeflow.functions.simplex import minimise
from cladeflow.functions.species_tree import read_species_tree
from cladeflow.functions.undated_gradient import KINDS, PARTS, family_gradient, rate_gradient
from cladeflow.functions.undated_model import Rates, layout, likelihood, prepare, sample, species_of
from cladeflow.operators.splits import of_row

#: Bounds of fitted rates.
RATE_LOW, RATE_HIGH, ORIGIN_HIGH = 1e-10, 100.0, 1000.0

#: Rows that a task holds before it hands them on; one family's are held at once.
HELD_ROWS = 1000

#: Facts of a family, at most, whose value is kept for like ones, and values kept in a task.
LIKE_FACTS, LIKE_KEPT = 64, 10_000


def balanced(tables: DataFrame, tasks: int | None = None) -> DataFrame:
    """Families dealt to tasks by hash, apart for each class of size.

    The cost of a family is its number of facts; families within a factor of two share a class.
    """
    n = tasks or tables.sparkSession.sparkContext.defaultParallelism * 4
    cost = F.size("facts")
    # Families of like cost share a class; within it a hash deals them out, so no global order is needed.
    return tables.withColumn("_bin", F.pmod(F.xxhash64("family", F.floor(F.log2(cost + 1))), F.lit(n))).repartition(n, "_bin").drop("_bin")


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
    for pdf in batches:
        yield from pdf.to_dict("records")


def _seeded(seed: int, *parts) -> np.random.Generator:
    """A generator that depends on the seed and the family alone, never on the task."""
    return np.random.default_rng([seed, *(zlib.crc32(str(p).encode()) for p in parts)])


def _flat(tables: DataFrame) -> DataFrame:
    return tables.select("family", "leaves", "observations", "facts")


def map_families(tables: DataFrame, f: Callable[[dict], list[tuple]], schema: str) -> DataFrame:
    """Apply f to each family's nested row; it returns rows of the schema."""
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches):
        for pdf in batches:
            rows: list[tuple] = []
            for row in pdf.to_dict("records"):
                rows += f(row)
                if len(rows) >= HELD_ROWS:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

    # Tables are few bytes but dear, and would be merged into one task for their bytes.
    return balanced(_flat(tables)).mapInPandas(run, schema)


def once_for_like(value: Callable[[dict], float], rates) -> Callable[[dict], float]:
    """A value of nested rows that depends on species and counts alone, worked out once in a task for families that share them.

    Large families are seldom alike, and are worked out one by one.
    """
    kept: dict[tuple, float] = {}

    def run(row: dict) -> float:
        if len(row["facts"]) > LIKE_FACTS:
            return value(row)
        species = tuple(species_of(x, rates.separators, rates.species_field) for x in row["leaves"])
        facts = sorted((f["clade"], f["left"] or b"", f["right"] or b"", f["cnt"] or 0.0) for f in row["facts"])
        key = (row["observations"], species, tuple(facts))
        if key not in kept:
            if len(kept) >= LIKE_KEPT:
                kept.clear()
            kept[key] = value(row)
        return kept[key]

    return run


def loglik(tables: DataFrame, species: str, rates: Rates | None = None) -> DataFrame:
    """family, logl: log likelihood of each family at fixed rates."""
    rates = rates or Rates()
    tree = read_species_tree(species)
    b = prepare(tree, rates)
    value = once_for_like(lambda row: likelihood(layout(of_row(row), rates), b).log_likelihood, rates)
    return map_families(tables, lambda row: [(row["family"], value(row))], "family string, logl double")


def loglik_grid(tables: DataFrame, species: str, points: list[Rates]) -> DataFrame:
    """family, point, logl for several rate vectors in one job; each family is laid out once."""
    tree = read_species_tree(species)
    ready = [prepare(tree, r) for r in points]

    def run(row):
        fam = layout(of_row(row), points[0])
        return [(row["family"], k, likelihood(fam, b).log_likelihood) for k, b in enumerate(ready)]

    return map_families(tables, run, "family string, point int, logl double")


def branch_terms(tables: DataFrame, species: str, rates: Rates | DataFrame | None = None, options: Rates | None = None) -> DataFrame:
    """family, branch, extinction, origin_logl: the probability that a gene on a branch dies out, and the log likelihood of an origination there."""
    tree = read_species_tree(species)
    own = isinstance(rates, DataFrame)
    base = (options or Rates()) if own or rates is None else rates

    def run(batches):
        for row in _rows(batches):
            r = base.of(delta=row["delta"], tau=row["tau"], lambda_=row["lambda"], origin_root=row["origin_root"]) if own else base
            b = prepare(tree, r)
            done = likelihood(layout(of_row(row), r), b)
            yield pd.DataFrame([(row["family"], e, float(b.extinct[e]), float(x)) for e, x in enumerate(done.origin_log)], columns=["family", "branch", "extinction", "origin_logl"])

    rows = _flat(tables)
    if own:
        rows = rows.join(rates.select("family", "delta", "tau", "lambda", "origin_root"), "family")
    return rows.mapInPandas(run, "family string, branch int, extinction double, origin_logl double")


def origination_loglik(tables: DataFrame, species: str, rates: Rates | None = None) -> DataFrame:
    """family, branch, branch_name, logl: the log likelihood of an origination on each branch."""
    rates = rates or Rates()
    tree = read_species_tree(species)
    b = prepare(tree, rates)

    def run(row):
        fit = likelihood(layout(of_row(row), rates), b)
        return [(row["family"], e, tree.branch_name(e), float(x)) for e, x in enumerate(fit.origin_log)]

    return map_families(tables, run, "family string, branch int, branch_name string, logl double")


FITS = "family string, logl double, delta double, tau double, lambda double, origin_root double, evaluations int"


def _fit_one(table, tree, start: Rates, free: tuple[str, ...], transfer_ratio: float | None) -> tuple[Rates, float, int]:
    fam = layout(table, start)

    def rates_at(x: np.ndarray) -> Rates:
        r = replace(start, **dict(zip(free, map(float, x))))
        return replace(r, tau=r.delta * transfer_ratio) if transfer_ratio is not None else r

    def value(points: list[np.ndarray]) -> list[float]:
        return [-likelihood(fam, prepare(tree, rates_at(x))).log_likelihood for x in points]

    if not free:
        return start, -value([np.empty(0)])[0], 1
    high = np.array([ORIGIN_HIGH if k == "origin_root" else RATE_HIGH for k in free])
    x, v, n = minimise(value, np.array([getattr(start, k) for k in free]), np.full(len(free), RATE_LOW), high)
    return rates_at(x), -v, n


def fit(tables: DataFrame, species: str, start: Rates | None = None, fixed: tuple[str, ...] = (), transfer_ratio: float | None = None, fit_origin: bool = False) -> DataFrame:
    """Maximum-likelihood rates of each family.

    fixed names rates that keep their start values; transfer_ratio ties tau to delta;
    fit_origin frees the weight of an origination at the root.
    """
    start = start or Rates()
    tree = read_species_tree(species)
    free = tuple(k for k in ("delta", "tau", "lambda_", *(("origin_root",) if fit_origin else ())) if k not in fixed and not (k == "tau" and transfer_ratio is not None))

    def run(row):
        r, logl, n = _fit_one(of_row(row), tree, start, free, transfer_ratio)
        return [(row["family"], logl, r.delta, r.tau, r.lambda_, r.origin_root, n)]

    return map_families(tables, run, FITS)


SAMPLES = "family string, sample_no int, newick string, events array<struct<kind:string,branch:int,other:int>>"


def samples(tables: DataFrame, species: str, rates: Rates | DataFrame | None = None, n: int = 100, seed: int = 0, options: Rates | None = None) -> DataFrame:
    """n reconciled trees of each family with their events; rates may be a table of fits by family, made with the given options of the model."""
    tree = read_species_tree(species)
    names = [c.split()[0] for c in ("family string", "sample_no int", "newick string", "events x")]
    own = isinstance(rates, DataFrame)
    base = (options or Rates()) if own or rates is None else rates

    def run(batches):
        for row in _rows(batches):
            r = base.of(delta=row["delta"], tau=row["tau"], lambda_=row["lambda"], origin_root=row["origin_root"]) if own else base
            done = likelihood(layout(of_row(row), r), prepare(tree, r))
            out = []
            for k in range(n):
                text, events = sample(done, _seeded(seed, row["family"], k))
                out.append((row["family"], k, text, [{"kind": a, "branch": b, "other": c} for a, b, c in events]))
            yield pd.DataFrame(out, columns=names)

    rows = _flat(tables)
    if own:
        rows = rows.join(rates.select("family", "delta", "tau", "lambda", "origin_root"), "family")
    return rows.mapInPandas(run, SAMPLES)


def events(sampled: DataFrame) -> DataFrame:
    """The event fact table: family, sample_no, kind, branch, other."""
    return sampled.select("family", "sample_no", F.explode("events").alias("e")).select("family", "sample_no", "e.*")


TRAIL = "family string, sample_no int, clade binary, seq int, kind string, branch int, other int"


def trail_events(tables: DataFrame, species: str, rates: Rates | None = None, n: int = 100, seed: int = 0) -> DataFrame:
    """The events of ``samples`` with the gene clade they befell and their place along its lineage, the oldest first."""
    rates = rates or Rates()
    b = prepare(read_species_tree(species), rates)

    def run(row):
        done, out = likelihood(layout(of_row(row), rates), b), []
        size = done.family.table.n
        for k in range(n):
            trail: list = []
            sample(done, _seeded(seed, row["family"], k), trail)
            out += [(row["family"], k, pack_mask(g, size), *rest) for g, *rest in trail]
        return out

    return map_families(tables, run, TRAIL)


CHAIN = "family string, iteration int, logl double, log_prior double, origination double, delta double, tau double, lambda double, accepted boolean"


def _chain(tables: DataFrame, species: str, start: Rates, first: int, steps: int, burnin: int, thin: int, seed: int, means: tuple[float, float, float, float], state: DataFrame | None) -> DataFrame:
    """Steps first to first + steps - 1 of every family's chain: the rows to keep, and the last one as where to go on (kept tells them apart)."""
    tree = read_species_tree(species)
    goes_on = state is not None
    rows = _flat(tables).join(state.select("family", "origination", "delta", "tau", "lambda"), "family") if goes_on else _flat(tables)

    def run(batches):
        for row in _rows(batches):
            fam = layout(of_row(row), start)

            def logl(x):
                r = start.of(origin_root=x[0], delta=x[1], tau=x[2], lambda_=x[3])
                return likelihood(fam, prepare(tree, r)).log_likelihood  # noqa: B023

            prior = lambda x: float(sum(-np.log(m) - v / m for v, m in zip(x, means)))
            x = [row[c] for c in ("origination", "delta", "tau", "lambda")] if goes_on else [start.origin_root, start.delta, start.tau, start.lambda_]
            now, p, out = logl(x), prior(x), []
            for it in range(first, first + steps):
                rng = _seeded(seed, row["family"], it)  # a step's draws depend on its number, so a chain can go on from any
                k, s = int(rng.integers(4)), float(rng.choice([0.1, 1.0, 10.0]))
                step = s * (rng.random() - 0.5)
                y = list(x)
                y[k] = min(max(x[k] * np.exp(step), 1e-5), ORIGIN_HIGH if k == 0 else 10.0)
                ok = False
                if sum(y[1:]) <= 10:
                    new, q = logl(y), prior(y)
                    ok = bool(np.log(rng.random()) < new + q - now - p + step)
                    if ok:
                        x, now, p = y, new, q
                kept = it >= burnin and (it - burnin) % thin == 0
                if kept or it == first + steps - 1:
                    out.append((row["family"], it, now, p, *x, ok, kept))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in f"{CHAIN}, kept boolean".split(", ")])

    return balanced(rows).mapInPandas(run, f"{CHAIN}, kept boolean")


def mcmc(tables: DataFrame, species: str, start: Rates | None = None, steps: int = 1000, burnin: int = 100, thin: int = 10, seed: int = 0, means: tuple[float, float, float, float] = (1.0, 0.01, 0.01, 0.1)) -> DataFrame:
    """A Markov chain over origination weight and rates of each family, with exponential priors of the given means.

    A step scales one parameter by exp(s (u - 0.5)), s one of 0.1, 1 and 10; proposals with
    delta + tau + lambda above 10 are rejected. Tables are always those of the current rates.
    """
    return _chain(tables, species, start or Rates(), 0, steps, burnin, thin, seed, means, None).filter("kept").drop("kept")


def mcmc_blocks(tables: DataFrame, species: str, path: str, start: Rates | None = None, steps: int = 1000, every: int = 100, burnin: int = 100, thin: int = 10, seed: int = 0, means: tuple[float, float, float, float] = (1.0, 0.01, 0.01, 0.1)) -> DataFrame:
    """``mcmc`` in blocks of so many steps, each stored under path with the state that the next goes on from.

    A call goes on after the blocks that are there, whole ones of the same every, so a stopped
    run loses one block at most, and its trace is that of a run at once.
    """
    spark, start, at = tables.sparkSession, start or Rates(), 0
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    schema = f"{CHAIN}, kept boolean"
    while at < steps:
        n = min(every, steps - at)
        block = f"{path}/from={at}-{at + n}"
        if not files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{block}/_SUCCESS")):
            state = spark.read.schema(schema).parquet(f"{path}/from={at - every}-{at}").filter(F.col("iteration") == at - 1) if at else None
            _chain(tables, species, start, at, n, burnin, thin, seed, means, state).write.mode("overwrite").parquet(block)
        at += n
    return spark.read.schema(schema).parquet(*(f"{path}/from={k}-{min(k + every, steps)}" for k in range(0, steps, every))).filter("kept").drop("kept")


def chain_samples(tables: DataFrame, chain: DataFrame, species: str, start: Rates | None = None, n: int = 1, seed: int = 0) -> DataFrame:
    """n reconciled trees at each kept step of a chain: family, iteration, sample_no, newick, events.

    sample_no is unique within a family, so transfers, counts and consensus trees of a chain are
    read off as those of other samples are.
    """
    start = start or Rates()
    tree = read_species_tree(species)
    names = ["family", "iteration", "sample_no", "newick", "events"]
    # A family's table goes to each of its kept steps; the chain's thinning bounds their number.
    met = chain.select("family", "iteration", "origination", "delta", "tau", "lambda").join(_flat(tables), "family")

    def run(batches):
        for row in _rows(batches):
            r = start.of(origin_root=row["origination"], delta=row["delta"], tau=row["tau"], lambda_=row["lambda"])
            done, out = likelihood(layout(of_row(row), r), prepare(tree, r)), []
            for k in range(n):
                text, found = sample(done, _seeded(seed, row["family"], row["iteration"], k))
                out.append((row["family"], row["iteration"], row["iteration"] * n + k, text, [{"kind": a, "branch": b, "other": c} for a, b, c in found]))
            yield pd.DataFrame(out, columns=names)

    return met.mapInPandas(run, "family string, iteration int, sample_no int, newick string, events array<struct<kind:string,branch:int,other:int>>")


def fit_global(tables: DataFrame, species: str, start: Rates | None = None, rounds: int = 40) -> tuple[Rates, float]:
    """Rates that all families share, by simplex on the sum of log likelihoods: one job a round for all its points."""
    start, tables = start or Rates(), balanced(tables).persist()  # every round reads them; lost parts are made anew

    def value(points: list[np.ndarray]) -> list[float]:
        rates = [start.of(delta=float(d), tau=float(t), lambda_=float(l)) for d, t, l in points]
        got = {r["point"]: r["logl"] for r in loglik_grid(tables, species, rates).groupBy("point").agg(F.sum("logl").alias("logl")).collect()}
        return [-got[k] for k in range(len(points))]

    x, v, _ = minimise(value, np.array([start.delta, start.tau, start.lambda_]), np.full(3, RATE_LOW), np.full(3, RATE_HIGH), rounds)
    tables.unpersist()
    return start.of(delta=float(x[0]), tau=float(x[1]), lambda_=float(x[2])), -v


def fit_branchwise(tables: DataFrame, species: str, start: Rates | None = None, rounds: int = 3, kinds: tuple[str, ...] = ("delta", "tau_to", "tau_from", "lambda", "O")) -> tuple[Rates, float]:
    """Multipliers by branch for all families: each in turn is tried up and down, one job per kind and round."""
    rates, tables = start or Rates(), balanced(tables).persist()
    n = read_species_tree(species).n
    best = -np.inf
    for step in [4.0 / 2**k for k in range(rounds)]:
        for kind in kinds:
            points = [rates]
            for e in range(n):
                for f in (np.exp(step), np.exp(-step)):
                    own = dict(rates.multipliers.get(kind, {}))
                    own[e] = float(min(max(own.get(e, 1.0) * f, 1e-7), 1e4))
                    points.append(rates.of(multipliers={**rates.multipliers, kind: own}))
            got = {r["point"]: r["logl"] for r in loglik_grid(tables, species, points).groupBy("point").agg(F.sum("logl").alias("logl")).collect()}
            top = max(got, key=lambda k: (got[k], -k))
            if got[top] > best:
                best, rates = got[top], points[top]
    tables.unpersist()
    return rates, best


def gradients(tables: DataFrame, species: str, points: list[Rates]) -> list[tuple[float, dict[str, np.ndarray]]]:
    """At each point, the summed log likelihood of all families and its derivatives by rates and by the multipliers of each branch.

    One job for all points: tasks add up the derivatives of their families by what the rates give
    each branch, a few numbers for each, and only those sums travel; the driver goes on from there.
    """
    tree = read_species_tree(species)
    ready = [prepare(tree, r) for r in points]
    size = len(PARTS) * tree.n

    def run(batches):
        logl, sums = np.zeros(len(ready)), np.zeros((len(ready), size))
        for row in _rows(batches):
            fam = layout(of_row(row), points[0])
            for k, b in enumerate(ready):
                value, parts = family_gradient(fam, b)
                logl[k] += value
                sums[k] += parts.astype(float).ravel()
        every = np.concatenate([logl[:, None], sums], axis=1)
        yield pd.DataFrame({"point": np.repeat(np.arange(len(ready)), size + 1), "at": np.tile(np.arange(size + 1), len(ready)), "value": every.ravel()})

    out = np.zeros((len(points), size + 1))
    for r in _flat(tables).mapInPandas(run, "point int, at int, value double").groupBy("point", "at").agg(F.sum("value").alias("value")).collect():  # as many numbers as branches and points
        out[r["point"], r["at"]] = r["value"]
    return [(float(x[0]), rate_gradient(b, x[1:].reshape(len(PARTS), tree.n))) for x, b in zip(out, ready)]


def fit_joint(tables: DataFrame, species: str, start: Rates | None = None, rounds: int = 100, kinds: tuple[str, ...] = KINDS) -> tuple[Rates, float]:
    """Three shared rates and the multipliers of all branches moved together, by quasi-Newton steps on the sum of log likelihoods.

    All values stay within [1e-10, 1000]. A round is one job that gives the values and the
    gradients at all its step lengths, whatever the number of families and branches.
    """
    start = start or Rates()
    n, tables = read_species_tree(species).n, balanced(tables).persist()

    def rates_at(x: np.ndarray) -> Rates:
        own = {kind: {e: float(v) for e, v in enumerate(x[3 + k * n : 3 + (k + 1) * n])} for k, kind in enumerate(kinds)}
        return start.of(delta=float(x[0]), tau=float(x[1]), lambda_=float(x[2]), multipliers={**start.multipliers, **own})

    def value(points: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
        got = gradients(tables, species, [rates_at(x) for x in points])
        return [(-v, -np.concatenate([g["rates"], *(g[kind] for kind in kinds)])) for v, g in got]

    first = [start.delta, start.tau, start.lambda_, *(start.multipliers.get(kind, {}).get(e, 1.0) for kind in kinds for e in range(n))]
    x, v, _ = descend(value, np.array(first), np.full(len(first), RATE_LOW), np.full(len(first), ORIGIN_HIGH), rounds)
    tables.unpersist()
    return rates_at(x), -v


def loglik_trees(tables: DataFrame, trees: list[str], rates: Rates) -> list[float]:
    """The summed log likelihood of all families under each species tree, in one job.

    A family is laid out once and taken through all trees; a task returns one sum a tree.
    """
    ready = [prepare(read_species_tree(t), rates) for t in trees]

    def run(batches):
        sums = np.zeros(len(ready))
        for row in _rows(batches):
            fam = layout(of_row(row), rates)
            sums += [likelihood(fam, b).log_likelihood for b in ready]
        yield pd.DataFrame({"tree": np.arange(len(ready)), "logl": sums})

    got = {r["tree"]: r["logl"] for r in _flat(tables).mapInPandas(run, "tree int, logl double").groupBy("tree").agg(F.sum("logl").alias("logl")).collect()}  # a number for each tree of a round
    return [got[k] for k in range(len(trees))]


def search_species_tree(tables: DataFrame, species: str, rates: Rates | None = None, n_samples: int = 10, tries: int = 50, seed: int = 0) -> tuple[str, float]:
    """Hill climbing over species trees, one likelihood job a round.

    A round takes the regrafts along the most frequent sampled transfers, at most so many tries,
    and the interchanges around every inner branch, scores all of them together and moves to
    the best. When none is better, a last round takes every regraft there is; it goes on from
    the best of those, if there is one. Trees seen before are not computed again.
    """
    from cladeflow.functions import newick

    rates, tables = rates or Rates(), balanced(tables).persist()
    seen: set[str] = set()

    def key(text: str) -> str:
        """The tree without lengths, the children of a node in the order of their text."""
        done: dict[int, str] = {}
        root = newick.parse(text)
        for node in reversed(list(root.preorder())):
            done[id(node)] = node.name if node.is_leaf else "(" + ",".join(sorted(done[id(c)] for c in node.children)) + ")"
        return done[id(root)]

    def labelled(text: str) -> newick.Node:
        return newick.parse(read_species_tree(text).numbered())

    best = loglik_trees(tables, [species], rates)[0]
    seen.add(key(species))
    wide = False
    while True:
        tree = read_species_tree(species)
        pairs = [(a, b) for a in range(tree.n) for b in range(tree.n) if a != b] if wide else []
        if not wide:
            moves = events(samples(tables, species, rates, n_samples, seed)).filter("kind = 'T'").groupBy("branch", "other").count().orderBy(F.desc("count"), "branch", "other").limit(tries).collect()
            pairs = [(m["other"], m["branch"]) for m in moves]
        options = [newick.graft(labelled(species), tree.branch_name(a), tree.branch_name(b)) for a, b in pairs]
        for e in range(tree.n_leaves, tree.n):
            options += newick.interchanges(labelled(species), tree.branch_name(e))
        fresh: dict[str, str] = {}
        for option in options:
            text = newick.write(option)
            if key(text) not in seen:
                fresh.setdefault(key(text), text)
        seen |= fresh.keys()
        texts = list(fresh.values())
        got = loglik_trees(tables, texts, rates) if texts else []
        top = max(range(len(got)), key=lambda k: (got[k], -k), default=None)
        if top is not None and got[top] > best + 1e-6:
            species, best, wide = texts[top], got[top], False
        elif wide:
            break
        else:
            wide = True
    tables.unpersist()
    return species, best


def random_species_tree(names: list[str], seed: int = 0) -> str:
    """A start tree by joining random pairs."""
    rng = np.random.default_rng(seed)
    parts = [f"{x}:1" for x in sorted(names)]
    while len(parts) > 1:
        i, j = sorted(rng.choice(len(parts), 2, replace=False).tolist())
        b, a = parts.pop(j), parts.pop(i)
        parts.append(f"({a},{b}):1")
    return parts[0].rsplit(":", 1)[0] + ";"


def timings(tables: DataFrame, species: str, rates: Rates | None = None, repeats: int = 10) -> DataFrame:
    """time, clades, genes, species, file of each family: mean seconds of a likelihood, in the form that scheduling takes."""
    import time

    rates = rates or Rates()
    b = prepare(read_species_tree(species), rates)

    def run(row):
        fam = layout(of_row(row), rates)
        began = time.perf_counter()
        for _ in range(repeats):
            likelihood(fam, b)
        took = (time.perf_counter() - began) / repeats
        return [(took, len(fam.clades), fam.table.n, len(set(fam.leaf_species)), row["family"])]

    return map_families(tables, run, "time double, clades long, genes long, species long, file string")


def em_rates(tables: DataFrame, species: str, start: Rates | None = None, rounds: int = 5, n_samples: int = 20, seed: int = 0) -> tuple[Rates, DataFrame]:
    """Shared rates by turns: sample at the rates, estimate them anew from the mean counts. Returns them and the last likelihoods."""
    from cladeflow.operators.event_tables import branch_means, rate_estimates

    rates = start or Rates()
    for k in range(rounds):
        means = branch_means(events(samples(tables, species, rates, n_samples, seed + k)), n_samples, by=())
        got = rate_estimates(means, by_branch=False).first()
        rates = rates.of(delta=got["delta"], tau=got["tau"], lambda_=got["lambda"])
    return rates, loglik(tables, species, rates)
