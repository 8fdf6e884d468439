"""Gradients of the undated likelihood by a backward pass, for rates and multipliers of all branches at once.

A family's pass gives the derivatives of its log likelihood by what ``prepare`` computed for
each branch; these add up over families. One pass back through ``prepare`` turns the sums into
derivatives by rates and multipliers. Where a value was raised to the least one, it counts as a constant.
"""

from __future__ import annotations

import numpy as np

from cladeflow.functions.undated_model import REAL, TINY, Branches, Family, Rates, likelihood, prepare

#: Quantities of a branch, in the order of a family's derivatives: duplication, speciation, norm of transfers, weight as a recipient, weight of barred recipients, extinction, loss after a transfer, origination.
PARTS = ("pd", "ps", "norm", "weight", "barred", "extinct", "gone", "origin")
#: Kinds of multipliers, in the order of the derivatives by branch.
KINDS = ("delta", "tau_to", "tau_from", "lambda", "O")


class _Sums:
    """Derivatives by the branches' quantities, added up row by row."""

    def __init__(self, b: Branches):
        self.b, self.moves = b, not b.no_transfer
        self.barred = b.blocked @ b.weight
        self.by = {k: np.zeros(b.tree.n, dtype=REAL) for k in PARTS}

    def moved(self, q: np.ndarray) -> np.ndarray:
        b = self.b
        fix = (q * b.weight) @ b.blocked.T if b.rates.exact_correction else q * self.barred
        return ((q @ b.weight)[:, None] - fix) / b.norm

    def back_moved(self, q: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The derivative by q of moved(q), weighted by u."""
        b = self.b
        z = u / b.norm
        self.by["norm"] -= (z * self.moved(q)).sum(axis=0)
        total = z.sum(axis=1)
        self.by["weight"] += total @ q
        if b.rates.exact_correction:
            t = z @ b.blocked
            self.by["weight"] -= (t * q).sum(axis=0)
            return total[:, None] * b.weight - t * b.weight
        self.by["barred"] -= (z * q).sum(axis=0)
        return total[:, None] * b.weight - z * self.barred


def _sweeps(family: Family, b: Branches) -> list[np.ndarray]:
    """The values after each sweep: those of the last are the likelihood's."""
    import dataclasses

    out = []
    for s in range(1, b.rates.sweeps + 1):
        part = dataclasses.replace(b, rates=b.rates.of(sweeps=s))
        out.append(likelihood(family, part).q)
    return out


def family_gradient(family: Family, b: Branches) -> tuple[float, np.ndarray]:
    """The log likelihood, and its derivatives by the branches' quantities, a row for each of PARTS."""
    tree, n = b.tree, b.tree.n
    qs = _sweeps(family, b)
    s_ = _Sums(b)
    by, inner = s_.by, np.arange(tree.n_leaves, n)
    lo, hi = tree.left[inner], tree.right[inner]
    gone = (b.mean_extinct - b.correction) / b.norm * s_.moves
    top = qs[-1][-1]
    mass, alive, weights = (top * b.origin).sum(), (1 - b.extinct).sum(), b.origin.sum()
    by["origin"] += top / mass - 1 / weights
    by["extinct"] += 1 / alive
    logl = float(np.log(mass) - np.log(alive) - np.log(weights) + np.log(REAL(n)))
    back = [np.zeros_like(q) for q in qs]
    back[-1][-1] = b.origin / mass
    present = np.zeros_like(qs[0], dtype=bool)
    place = {x: k for k, x in enumerate(tree.names)}
    for k, g in enumerate(family.clades[: family.table.n]):
        present[k, place[family.leaf_species[g.bit_length() - 1]]] = True
    if family.table.n == 1:
        present[0, place[family.leaf_species[0]]] = True
    for s in range(len(qs) - 1, -1, -1):
        q, old_all = qs[s], qs[s - 1] if s else np.zeros_like(qs[0])
        for first, last in reversed(family.groups):
            v, value = back[s][first:last], q[first:last]
            live = value > TINY
            for k in range(n - 1, tree.n_leaves - 1, -1):
                v[:, k] *= live[:, k]
                f, g = int(tree.left[k]), int(tree.right[k])
                by["ps"][k] += v[:, k] @ (value[:, f] * b.extinct[g] + value[:, g] * b.extinct[f])
                by["extinct"][g] += b.ps[k] * (v[:, k] @ value[:, f])
                by["extinct"][f] += b.ps[k] * (v[:, k] @ value[:, g])
                v[:, f] += v[:, k] * b.ps[k] * b.extinct[g]
                v[:, g] += v[:, k] * b.ps[k] * b.extinct[f]
            v[:, : tree.n_leaves] *= live[:, : tree.n_leaves]
            by["ps"] += (v * present[first:last]).sum(axis=0)
            if s:
                old = old_all[first:last]
                by["pd"] += (v * old).sum(axis=0) * 2 * b.extinct
                by["extinct"] += (v * old).sum(axis=0) * 2 * b.pd
                by["gone"] += (v * old).sum(axis=0)
                back[s - 1][first:last] += v * (2 * b.pd * b.extinct + gone)
                if s_.moves:
                    by["extinct"] += (v * s_.moved(old)).sum(axis=0)
                    back[s - 1][first:last] += s_.back_moved(old, v * b.extinct)
            i, j = family.at[first], family.at[last]
            if j > i:
                a, c = family.split_left[i:j], family.split_right[i:j]
                x, y = q[a], q[c]
                u = v[family.split_rows[i:j] - first] * family.split_p[i:j, None]
                by["pd"] += (u * x * y).sum(axis=0)
                dx, dy = u * b.pd * y, u * b.pd * x
                if s_.moves:
                    dx += u * s_.moved(y) + s_.back_moved(x, u * y)
                    dy += u * s_.moved(x) + s_.back_moved(y, u * x)
                w = u[:, inner]
                by["ps"][inner] += (w * (x[:, lo] * y[:, hi] + x[:, hi] * y[:, lo])).sum(axis=0)
                w = w * b.ps[inner]
                for part, other, of in ((lo, hi, y), (hi, lo, y)):
                    np.add.at(dx, (slice(None), part), w * of[:, other])
                for part, other, of in ((lo, hi, x), (hi, lo, x)):
                    np.add.at(dy, (slice(None), part), w * of[:, other])
                np.add.at(back[s], a, dx)
                np.add.at(back[s], c, dy)
    return logl, np.stack([by[k] for k in PARTS])


def rate_gradient(b: Branches, sums: np.ndarray) -> dict[str, np.ndarray]:
    """From derivatives by the branches' quantities to those by rates ("rates": delta, tau, lambda) and by the multipliers of each kind."""
    tree, r, n = b.tree, b.rates, b.tree.n
    pd, ps, norm, weight, barred, extinct, gone, origin = (np.array(x, dtype=REAL) for x in sums)
    moves = not b.no_transfer

    def multiplier(kind: str) -> np.ndarray:
        return np.array([r.multipliers.get(kind, {}).get(e, 1.0) for e in range(n)], dtype=REAL)

    scale = np.where(np.arange(n) == tree.root, 1.0, tree.length).astype(REAL) if r.scale_lengths else np.ones(n, dtype=REAL)
    d, t, l = (x * multiplier(k) * scale for x, k in ((REAL(r.delta), "delta"), (REAL(r.tau), "tau_from"), (REAL(r.lambda_), "lambda")))
    total = 1 + d + t + l
    pt, pl = t / total, l / total
    missing = np.zeros(n, dtype=REAL)
    for name, x in r.missing.items():
        if name in tree.names:
            missing[tree.names.index(name)] = x
    # Forward through the extinction rounds, keeping each.
    before, means, fixes, e, mean, fix = [], [], [], np.zeros(n, dtype=REAL), REAL(0), np.zeros(n, dtype=REAL)

    def climb(own: np.ndarray) -> np.ndarray:
        out = own.copy()
        for k in range(tree.n_leaves, n):
            out[k] = own[k] + b.ps[k] * out[tree.left[k]] * out[tree.right[k]]
        return out

    leaves = slice(0, tree.n_leaves)
    for sweep in range(r.sweeps):
        if sweep:
            fix = b.blocked @ (b.weight * e)
        before.append(e)
        means.append(mean)
        fixes.append(fix)
        e = climb(pl + b.pd * e * e + e * (mean - fix) / b.norm)
        mean = (b.weight * e).sum()
    before.append(e)
    means.append(mean)
    fixes.append(fix)
    own = pl + b.pd * e * e + e * (mean - fix) / b.norm
    own[leaves] = (1 - missing[leaves]) * e[leaves] + missing[leaves]  # the last round only lets what is missing in
    last = climb(own)
    after = [*before[1:], last]
    # And back.
    dl, dfix = np.zeros(n, dtype=REAL), [np.zeros(n, dtype=REAL) for _ in before]
    de = extinct
    if moves:
        dmean = (gone / b.norm).sum()
        dfix[-1] -= gone / b.norm
        norm = norm - gone * (b.mean_extinct - b.correction) / b.norm**2
        de = de + dmean * b.weight
        weight = weight + dmean * last
    for k in range(len(before) - 1, -1, -1):
        out, old = after[k], before[k]
        down = de.copy()
        for x in range(n - 1, tree.n_leaves - 1, -1):
            f, g = int(tree.left[x]), int(tree.right[x])
            ps[x] += down[x] * out[f] * out[g]
            down[f] += down[x] * b.ps[x] * out[g]
            down[g] += down[x] * b.ps[x] * out[f]
        kept = np.zeros(n, dtype=REAL)
        if k == len(before) - 1:
            kept[leaves] = down[leaves] * (1 - missing[leaves])
            down[leaves] = 0
        dl += down
        pd += down * old * old
        ways = (means[k] - fixes[k]) / b.norm
        norm = norm - down * old * ways / b.norm
        de = kept + down * (2 * b.pd * old + ways)
        dmean = (down * old / b.norm).sum()
        dfix[k] -= down * old / b.norm
        if k == len(before) - 1:
            dfix[k - 1] += dfix[k]  # the last round has the corrections of the one before
        elif k:
            t_ = b.blocked.T @ dfix[k]
            de = de + t_ * b.weight
            weight = weight + t_ * old
        if k:
            de = de + dmean * b.weight
            weight = weight + dmean * old
    weight = weight + b.blocked.T @ barred
    dt = np.zeros(n, dtype=REAL)
    if moves:
        finite = np.isfinite(b.norm)
        of = np.where(finite, norm, 0)
        across = np.where(finite, of / pt, 0)
        weight = weight + across.sum() - b.blocked.T @ across
        dt = np.where(finite, -of * np.where(finite, b.norm, 0) / pt, 0)
    shared = -(pd * b.pd + dt * pt + dl * pl + ps * b.ps) / total
    by_d, by_t, by_l = (x / total + shared for x in (pd, dt, dl))
    return {
        "rates": np.array([(by_d * multiplier("delta") * scale).sum(), (by_t * multiplier("tau_from") * scale).sum(), (by_l * multiplier("lambda") * scale).sum()], dtype=float),
        "delta": (by_d * r.delta * scale).astype(float), "tau_from": (by_t * r.tau * scale).astype(float), "lambda": (by_l * r.lambda_ * scale).astype(float),
        "tau_to": (weight * scale).astype(float), "O": origin.astype(float),
    }


def gradient(families: list[Family], tree, rates: Rates) -> tuple[float, dict[str, np.ndarray]]:
    """The summed log likelihood of some families and its derivatives."""
    b = prepare(tree, rates)
    got = [family_gradient(f, b) for f in families]
    return sum(g[0] for g in got), rate_gradient(b, sum(g[1] for g in got))
