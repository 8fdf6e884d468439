"""Histories of the finite dated model by their shares of the likelihood, and exact parsimony."""

import math
from collections import Counter

import numpy as np
import pytest

from cladeflow.functions import dated_model, finite_model, newick, parsimony
from cladeflow.functions.clade_table import observe
from cladeflow.functions.dated_model import DatedRates
from cladeflow.functions.species_tree import read_species_tree
from cladeflow.functions.undated_model import layout

SPECIES = "((a:1,b:1):1,c:2);"
TREES = {"pair": ["(a_1,c_1);"], "three": ["((a_1,c_1),b_1);", "((a_1,b_1),c_1);", "((a_1,b_1),c_1);"], "four": ["((a_1,b_1),(c_1,a_2));", "((a_1,a_2),(c_1,b_1));"]}
RATES = DatedRates(delta=0.3, tau=0.6, lambda_=0.4, population=8.0)


@pytest.fixture(scope="module", params=sorted(TREES))
def fit(request):
    tree = read_species_tree(SPECIES)
    table = observe([(t, 1.0) for t in TREES[request.param]])
    return finite_model.likelihood(layout(table, RATES), finite_model.prepare(tree, RATES), keep=True)


def near(counts: Counter, shares: dict) -> None:
    """Counts within six standard errors and one count of what the shares give."""
    n = sum(counts.values())
    assert set(counts) <= {k for k, p in shares.items() if p > 0}
    for k, p in shares.items():
        assert abs(counts[k] - n * p) <= 6 * math.sqrt(n * p * (1 - p)) + 1


def test_origins_have_their_shares(fit):
    rng, clock, n = np.random.default_rng(1), fit.clock, 1500
    root, hid = len(fit.family.clades), clock.tree.n
    w = {(k, c): float(fit.history[k][root, c]) for k, p in enumerate(clock.points) for c in [*p.alive.tolist(), hid]}
    total = sum(w.values())
    times = {round(p.time, 12): k for k, p in enumerate(clock.points)}
    drawn, splits, speciations = Counter(), Counter(), []
    for _ in range(n):
        text, events = finite_model.trace(fit, rng)
        kinds = Counter(e[0] for e in events)
        assert kinds["O"] == 1 and kinds["C"] == fit.family.table.n
        assert sorted(x.split(".")[0] for x in newick.parse(text).leaf_names()) == fit.family.table.leaves
        assert all(0 <= t <= clock.points[-1].time for *_, t in events)
        drawn[times[round(events[0][2], 12)], events[0][1]] += 1
        speciations.append(kinds["S"])
        leaves = [{x.name.split(".")[0] for x in part.leaves()} for part in newick.parse(text).children] if fit.family.table.n > 1 else []
        splits[frozenset(map(frozenset, leaves))] += 1
    near(drawn, {k: v / total for k, v in w.items()})
    assert len(splits) <= len(fit.family.table.root_pairs())


def test_each_step_has_its_share(fit):
    """The options of a step add up to the value that the likelihood has one point further."""
    clock, q = fit.clock, fit.history
    for k in range(1, len(clock.points)):
        for c in [*clock.points[k].alive.tolist(), clock.tree.n]:
            if clock.points[k].born == c:
                continue
            for i in range(len(fit.family.clades) + 1):
                got = sum(float(o[0]) for o in finite_model._steps(fit, i, k - 1, c))
                assert got == pytest.approx(float(q[k][i, c]), rel=1e-9, abs=1e-300)


def test_limit_steps_add_up_too():
    tree, rates = read_species_tree(SPECIES), DatedRates(delta=0.3, tau=0.6, lambda_=0.4)
    fit = dated_model.likelihood(layout(observe([(t, 1.0) for t in TREES["four"]]), rates), dated_model.prepare(tree, rates), keep=True)
    for k in range(1, len(fit.clock.points)):
        for c in [*fit.clock.points[k].alive.tolist(), tree.n]:
            if fit.clock.points[k].born != c:
                for i in range(len(fit.family.clades) + 1):
                    got = sum(float(o[0]) for o in dated_model._steps(fit, i, k - 1, c))
                    assert got == pytest.approx(float(fit.history[k][i, c]), rel=1e-9, abs=1e-300)


def clades_of(rng, n: int, m: int) -> dict[int, float]:
    return {int(g): float(rng.integers(1, 9)) for g in rng.integers(1, (1 << n) - 1, m)}


@pytest.mark.parametrize(("n", "seed"), [(4, 0), (5, 1), (6, 2), (7, 3), (8, 4)])
def test_branch_and_bound_is_enumeration(n, seed):
    rng = np.random.default_rng(seed)
    states, weights = parsimony.characters(clades_of(rng, n, 14), n)
    first = parsimony._grown(list(range(n)))
    every = [first]
    for leaf in range(3, n):
        every = [parsimony._insert(t, leaf, a, b) for t in every for a, b in parsimony._edges(t, n)]
    least = min(parsimony.changes(t, states, weights) for t in every)
    tree, cost = parsimony.exact(states, weights)
    assert cost == pytest.approx(least) == pytest.approx(parsimony.changes(tree, states, weights))
    assert parsimony.ratchet(states, weights)[1] >= least - 1e-9


def test_ratchet_is_no_worse_than_one_search():
    for seed in range(3):
        states, weights = parsimony.characters(clades_of(np.random.default_rng(seed), 12, 30), 12)
        _, once = parsimony.search(states, weights)
        tree, cost = parsimony.ratchet(states, weights, rounds=6)
        assert cost <= once + 1e-9 and cost == pytest.approx(parsimony.changes(tree, states, weights)) and cost >= weights.sum() - 1e-9


def test_bounds():
    names = [f"x{k:02d}" for k in range(12)]
    clades = clades_of(np.random.default_rng(9), 12, 20)
    _, cost = parsimony.consensus(names, clades)
    assert parsimony.bound(names, clades, cost) <= cost
    few = {g & 255: w for g, w in clades.items() if 0 < g & 255 < 255}
    _, cost = parsimony.consensus(names[:8], few)
    assert parsimony.bound(names[:8], few, cost) == cost
