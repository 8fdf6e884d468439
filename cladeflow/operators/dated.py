"""The dated model over families: likelihoods, fits, best and sampled reconciliations, chains."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame

from cladeflow.functions import dated_model, finite_model
from cladeflow.functions.dated_model import DatedRates, likelihood, prepare, trace
from cladeflow.functions.simplex import minimise
from cladeflow.functions.species_tree import read_species_tree
from cladeflow.functions.undated_model import layout
from cladeflow.operators.reconcile import _seeded, map_families, once_for_like
from cladeflow.operators.splits import of_row

#: Bounds of fitted rates and of the unsampled species' speciation rate.
RATE_LOW, RATE_HIGH, SIGMA_LOW, SIGMA_HIGH = 1e-5, 1.0, 1e-6, 10.0
EVENTS = "array<struct<kind:string,branch:int,time:double>>"


def _model(rates: DatedRates):
    """The module of a population of the rates' size."""
    return finite_model if rates.population else dated_model


def _limit_only(rates: DatedRates) -> None:
    if rates.population:
        raise ValueError("the best history is traced in the limit of many species only: set population to 0")


def loglik(tables: DataFrame, species: str, rates: DatedRates | None = None) -> DataFrame:
    """family, logl at fixed rates; with a population, in the model of so many species."""
    rates = rates or DatedRates()
    model = _model(rates)
    clock = model.prepare(read_species_tree(species), rates)
    value = once_for_like(lambda row: model.likelihood(layout(of_row(row), rates), clock).log_likelihood, rates)
    return map_families(tables, lambda row: [(row["family"], value(row))], "family string, logl double")


def fit(tables: DataFrame, species: str, start: DatedRates | None = None, fit_sigma: bool = False) -> DataFrame:
    """Maximum-likelihood rates of each family; fit_sigma frees the speciation rate of unsampled species."""
    start = start or DatedRates(delta=0.01, tau=0.01, lambda_=0.1)
    tree, model = read_species_tree(species), _model(start)
    free = ("delta", "tau", "lambda_", *(("sigma",) if fit_sigma else ()))

    def run(row):
        fam = layout(of_row(row), start)
        at = lambda x: replace(start, **dict(zip(free, map(float, x))))
        value = lambda points: [-model.likelihood(fam, model.prepare(tree, at(x))).log_likelihood for x in points]
        low = np.array([SIGMA_LOW if k == "sigma" else RATE_LOW for k in free])
        high = np.array([SIGMA_HIGH if k == "sigma" else RATE_HIGH for k in free])
        x, v, n = minimise(value, np.array([getattr(start, k) for k in free]), low, high, 60)
        r = at(x)
        return [(row["family"], -v, r.delta, r.tau, r.lambda_, r.sigma, n)]

    return map_families(tables, run, "family string, logl double, delta double, tau double, lambda double, sigma double, evaluations int")


def _event_rows(events):
    return [{"kind": a, "branch": b, "time": c} for a, b, c in events]


def best_reconciliation(tables: DataFrame, species: str, rates: DatedRates | None = None) -> DataFrame:
    """The history of greatest probability of each family: log probability, reconciled tree and events."""
    rates = rates or DatedRates()
    _limit_only(rates)
    clock = prepare(read_species_tree(species), rates)

    def run(row):
        done = likelihood(layout(of_row(row), rates), clock, maximise=True, keep=True)
        text, events = trace(done)
        return [(row["family"], done.log_likelihood, text, _event_rows(events))]

    return _map(tables, run, f"family string, logp double, newick string, events {EVENTS}", ["family", "logp", "newick", "events"])


def _map(tables: DataFrame, f, schema: str, names: list[str]) -> DataFrame:
    import pandas as pd

    def run(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                yield pd.DataFrame(f(row), columns=names)

    return tables.select("family", "leaves", "observations", "facts").mapInPandas(run, schema)


def samples(tables: DataFrame, species: str, rates: DatedRates | None = None, n: int = 100, seed: int = 0) -> DataFrame:
    """n reconciliations of each family drawn by probability, positions weighted by time."""
    rates = rates or DatedRates()
    model = _model(rates)
    clock = model.prepare(read_species_tree(species), rates)

    def run(row):
        done = model.likelihood(layout(of_row(row), rates), clock, keep=True)
        out = []
        for k in range(n):
            text, events = model.trace(done, _seeded(seed, row["family"], k))
            out.append((row["family"], k, text, _event_rows(events)))
        return out

    return _map(tables, run, f"family string, sample_no int, newick string, events {EVENTS}", ["family", "sample_no", "newick", "events"])


def mcmc(tables: DataFrame, species: str, start: DatedRates | None = None, steps: int = 200, burnin: int = 50, thin: int = 10, seed: int = 0) -> DataFrame:
    """A Metropolis chain over the rates of each family: additive steps of three sizes, clamped to [1e-6, 10), flat prior."""
    start = start or DatedRates(delta=0.01, tau=0.01, lambda_=0.1)
    tree, model = read_species_tree(species), _model(start)

    def run(row):
        rng = _seeded(seed, row["family"])
        fam = layout(of_row(row), start)
        logl = lambda x: model.likelihood(fam, model.prepare(tree, start.of(delta=x[0], tau=x[1], lambda_=x[2]))).log_likelihood
        x, out = [start.delta, start.tau, start.lambda_], []
        now = logl(x)
        for it in range(steps):
            k, s = int(rng.integers(3)), float(rng.choice([0.01, 0.1, 1.0]))
            y = list(x)
            y[k] = min(max(x[k] + s * (rng.random() - 0.5), 1e-6), 10.0)
            new = logl(y)
            ok = bool(np.log(rng.random()) < new - now)
            if ok:
                x, now = y, new
            if it >= burnin and (it - burnin) % thin == 0:
                out.append((row["family"], it, now, *x, ok))
        return out

    return map_families(tables, run, "family string, iteration int, logl double, delta double, tau double, lambda double, accepted boolean")


def mcmc_samples(tables: DataFrame, chain: DataFrame, species: str, start: DatedRates | None = None, n: int = 10, seed: int = 0) -> DataFrame:
    """n reconciliations at the rates of each accepted step of a chain: family, iteration, sample_no, newick, events."""
    start = start or DatedRates()
    tree, model = read_species_tree(species), _model(start)
    names = ["family", "iteration", "sample_no", "newick", "events"]
    # A family's table goes to each of its kept steps; the chain's thinning bounds their number.
    met = chain.filter("accepted").select("family", "iteration", "delta", "tau", "lambda").join(tables.select("family", "leaves", "observations", "facts"), "family")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for row in pdf.to_dict("records"):
                rates = start.of(delta=row["delta"], tau=row["tau"], lambda_=row["lambda"])
                done = model.likelihood(layout(of_row(row), rates), model.prepare(tree, rates), keep=True)
                out = []
                for k in range(n):
                    text, events = model.trace(done, _seeded(seed, row["family"], row["iteration"], k))
                    out.append((row["family"], row["iteration"], k, text, _event_rows(events)))
                yield pd.DataFrame(out, columns=names)

    return met.mapInPandas(run, f"family string, iteration int, sample_no int, newick string, events {EVENTS}")
