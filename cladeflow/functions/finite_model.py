"""The dated model in a population of a finite number of species.

Of the population's species some are branches of the tree and the others one extra column.
Speciations in the population balance extinctions, so unsampled species die out faster the
fewer there are. What a lineage keeps over a grid step without an event that is seen is its
propagator, solved together with extinction; events that are seen add to it in first order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from cladeflow.functions.dated_model import SUB_STEPS, DatedRates, Point, _gather, splits_of, timeline, walk
from cladeflow.functions.species_tree import SpeciesTree
from cladeflow.functions.undated_model import REAL, Family


@dataclass
class FiniteClock:
    tree: SpeciesTree
    rates: DatedRates
    points: list[Point]
    #: Extinction at each point, and the propagator over the step from it; the last column is that of unsampled species.
    extinct: np.ndarray
    stay: np.ndarray


@dataclass
class FiniteFit:
    family: Family
    clock: FiniteClock
    log_likelihood: float
    #: Values at each grid point, after a speciation where there is one; only if kept.
    history: list[np.ndarray]


def prepare(tree: SpeciesTree, rates: DatedRates, missing: dict[str, float] | None = None) -> FiniteClock:
    """Extinction and propagators by fourth-order Runge-Kutta; missing holds the fraction of genes not seen by species."""
    points, size = timeline(tree, rates), rates.population
    if size <= max(len(p.alive) for p in points):
        raise ValueError(f"a population of {size} does not hold the {max(len(p.alive) for p in points)} branches alive at once")
    n = len(points)
    extinct, stay = np.zeros((n, tree.n + 1)), np.zeros((n, tree.n + 1))
    now = np.array([(missing or {}).get(x, 0.0) for x in tree.names[: tree.n_leaves]] + [0.0] * (tree.n - tree.n_leaves) + [1.0])
    for k, pt in enumerate(points):
        if pt.born >= 0:
            now[pt.born] = now[tree.left[pt.born]] * now[tree.right[pt.born]]
        extinct[k] = now
        alive = len(pt.alive)
        gain = rates.sigma + rates.tau * (size - alive) / (size - 1)
        death = rates.sigma * size / (size - alive) + rates.lambda_
        pair = rates.tau / size

        def slope(state: np.ndarray) -> np.ndarray:
            (e, g), (h, u) = state[:, :-1], state[:, -1]
            lost = pair * (1 - e).sum()
            branch = gain * (1 - h)
            return np.array([
                [*(rates.lambda_ * (1 - e) - (rates.delta * (1 - e) + branch) * e), death * (1 - h) - (gain + rates.delta) * (1 - h) * h - lost * h],
                [*(-(rates.lambda_ + rates.delta * (1 - 2 * e) + branch) * g), -((gain + rates.delta) * (1 - 2 * h) + death + lost) * u],
            ])

        at = [*pt.alive.tolist(), tree.n]
        state, dt = np.array([now[at], np.ones(len(at))]), pt.dt / SUB_STEPS
        for _ in range(SUB_STEPS):
            a = slope(state)
            b = slope(state + dt / 2 * a)
            c = slope(state + dt / 2 * b)
            d = slope(state + dt * c)
            state = state + dt / 6 * (a + 2 * b + 2 * c + d)
        now[at], stay[k, at] = state
    return FiniteClock(tree, rates, points, extinct, stay)


def likelihood(family: Family, clock: FiniteClock, keep: bool = False) -> FiniteFit:
    """The log likelihood, with the origination anywhere on the grid alike."""
    tree, r = clock.tree, clock.rates
    m, hid = len(family.clades) + 1, tree.n
    at_leaf = {x: k for k, x in enumerate(tree.names)}
    unknown = {x for x in family.leaf_species if x not in at_leaf}
    if unknown:
        raise ValueError(f"species not in the tree: {sorted(unknown)}")
    q = np.zeros((m, tree.n + 1), dtype=REAL)
    if family.table.n == 1:
        q[0, at_leaf[family.leaf_species[0]]] = 1
    for k, g in enumerate(family.clades[: family.table.n]):
        q[k, at_leaf[family.leaf_species[g.bit_length() - 1]]] = 1
    left, right, p = family.split_left, family.split_right, family.split_p[:, None]
    total, places, history = REAL(0), 0, []
    for k, pt in enumerate(clock.points):
        ex, stay, a = clock.extinct[k], clock.stay[k], pt.alive
        if pt.born >= 0:
            f, g = int(tree.left[pt.born]), int(tree.right[pt.born])
            both = (q[left][:, [f]] * q[right][:, [g]] + q[left][:, [g]] * q[right][:, [f]]) * p
            q[:, pt.born] = q[:, f] * ex[g] + q[:, g] * ex[f] + _gather(family, both, m, False)[:, 0]
        if keep:
            history.append(q.copy())
        total += q[-1, a].sum() + q[-1, hid]
        places += len(a) + 1
        x, y, moved = q[left], q[right], r.tau / r.population * pt.dt
        apart = x[:, [hid]] * y[:, a] + x[:, a] * y[:, [hid]]
        hidden = (moved * apart.sum(axis=1, keepdims=True) + 2 * r.sigma * pt.dt * x[:, [hid]] * y[:, [hid]]) * p
        seen = (r.sigma * apart + 2 * r.delta * x[:, a] * y[:, a]) * pt.dt * p
        new = np.zeros_like(q)
        new[:, hid] = _gather(family, hidden, m, False)[:, 0] + moved * ex[hid] * q[:, a].sum(axis=1) + stay[hid] * q[:, hid]
        new[:, a] = _gather(family, seen, m, False) + r.sigma * pt.dt * ex[a] * q[:, [hid]] + stay[a] * q[:, a]
        q = new
    return FiniteFit(family, clock, float(np.log(total / places)) if total > 0 else -np.inf, history)


def _steps(fit: FiniteFit, i: int, k: int, c: int) -> list[tuple]:
    """What may have befallen clade i on column c within the step up from point k, the terms of the likelihood."""
    clock, fam = fit.clock, fit.family
    r, hid, pt, q = clock.rates, clock.tree.n, clock.points[k], fit.history[k]
    ex, stay, dt = clock.extinct[k], clock.stay[k], pt.dt
    moved = r.tau / r.population * dt
    options: list[tuple] = [(stay[c] * q[i, c], "stay")]
    if c == hid:
        options += [(moved * ex[hid] * q[i, e], "arrive", e) for e in pt.alive.tolist()]
        for x, y, p in splits_of(fam, i):
            options.append((2 * r.sigma * dt * q[x, hid] * q[y, hid] * p, "Sb", x, hid, y, hid))
            for e in pt.alive.tolist():
                options += [(moved * q[x, hid] * q[y, e] * p, "Tt", x, hid, y, e), (moved * q[x, e] * q[y, hid] * p, "Tt", x, e, y, hid)]
        return options
    options.append((r.sigma * dt * ex[c] * q[i, hid], "leave"))
    for x, y, p in splits_of(fam, i):
        options += [(r.sigma * dt * q[x, hid] * q[y, c] * p, "Tf", x, hid, y, c), (r.sigma * dt * q[x, c] * q[y, hid] * p, "Tf", x, c, y, hid), (2 * r.delta * dt * q[x, c] * q[y, c] * p, "D", x, c, y, c)]
    return options


def trace(fit: FiniteFit, rng: np.random.Generator) -> tuple[str, list[tuple[str, int, float]]]:
    """A reconciled tree and its events, as ``dated_model.trace`` gives them, drawn from kept tables by their shares of the likelihood."""
    root, hid = len(fit.family.clades), fit.clock.tree.n
    starts = [(fit.history[k][root, c], k, c) for k, pt in enumerate(fit.clock.points) for c in [*pt.alive.tolist(), hid]]
    return walk(fit, rng, starts, _steps)
