"""The undated duplication-transfer-loss model: extinction, family likelihood, sampled reconciliations.

A gene on a branch of the species tree speciates, duplicates, is transferred to a branch that
is not an ancestor, or is lost. Clades of one size are computed together, a row each, with a
column for each branch; only inner branches, whose value needs that of their children, are
visited one by one. Numbers are 80-bit floats, so that families of hundreds of genes don't
underflow.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np

from cladeflow.functions.clade_table import CladeTable
from cladeflow.functions.species_tree import SpeciesTree

REAL = np.longdouble
TINY = np.finfo(REAL).tiny
#: Rounds of the fixed-point iteration, for extinction and for clades alike.
SWEEPS = 4
NO_TRANSFER = 1e-10


@dataclass(frozen=True)
class Rates:
    """Rates against a speciation weight of 1, per-branch multipliers by branch number, and the model's options."""

    delta: float = 0.01
    tau: float = 0.01
    lambda_: float = 0.1
    origin_root: float = 1.0
    seq_beta: float = 1.0
    min_bip_count: float = -1.0
    separators: str = "_@"
    species_field: int = 0
    sweeps: int = SWEEPS
    #: Transfers to dated ancestors are out as well.
    by_date: bool = False
    #: Transfers to ancestors are allowed, each branch being an equally likely recipient.
    any_recipient: bool = False
    #: The ancestor correction of clades uses each ancestor's own value instead of the donor's.
    exact_correction: bool = False
    #: Rates are scaled by branch lengths.
    scale_lengths: bool = False
    missing: dict[str, float] = field(default_factory=dict)
    #: kind ("delta", "tau_to", "tau_from", "lambda", "O") to branch number to multiplier; a negative origin multiplier means: only here.
    multipliers: dict[str, dict[int, float]] = field(default_factory=dict)

    def of(self, **changes) -> Rates:
        return replace(self, **changes)


@dataclass
class Branches:
    """What the rates give for each branch, the same for all families."""

    tree: SpeciesTree
    rates: Rates
    pd: np.ndarray
    pl: np.ndarray
    ps: np.ndarray
    #: Weights of recipients, and what a donor's transfers are divided by.
    weight: np.ndarray
    norm: np.ndarray
    blocked: np.ndarray  # ancestors, as numbers
    extinct: np.ndarray
    mean_extinct: float
    correction: np.ndarray
    origin: np.ndarray
    no_transfer: bool


def prepare(tree: SpeciesTree, rates: Rates) -> Branches:
    """Event probabilities and extinction probabilities of every branch."""
    n = tree.n

    def multiplier(kind: str) -> np.ndarray:
        out = np.ones(n, dtype=REAL)
        for e, x in rates.multipliers.get(kind, {}).items():
            out[int(e)] = x
        return out

    scale = np.where(np.arange(n) == tree.root, 1.0, tree.length).astype(REAL) if rates.scale_lengths else np.ones(n, dtype=REAL)
    weight = multiplier("tau_to") * scale
    d, t, l = (x * multiplier(k) * scale for x, k in ((REAL(rates.delta), "delta"), (REAL(rates.tau), "tau_from"), (REAL(rates.lambda_), "lambda")))
    total = 1 + d + t + l
    pd, pt, pl, ps = d / total, t / total, l / total, 1 / total
    blocked = (np.zeros((n, n)) if rates.any_recipient else tree.ancestors(rates.by_date)).astype(REAL)
    no_transfer = rates.tau < NO_TRANSFER
    with np.errstate(divide="ignore", invalid="ignore"):
        norm = (weight.sum() - blocked @ weight) / pt
    norm[~(norm > 0) | (blocked.min(axis=1) > 0)] = np.inf  # where all are barred the difference may be a rounding error
    missing = np.zeros(n, dtype=REAL)
    for name, x in rates.missing.items():
        if name in tree.names:
            missing[tree.names.index(name)] = x
    leaves, inner = slice(0, tree.n_leaves), range(tree.n_leaves, n)
    e, mean, fix = np.zeros(n, dtype=REAL), REAL(0), np.zeros(n, dtype=REAL)

    def climb(own: np.ndarray) -> None:
        for b in inner:
            e[b] = own[b] + ps[b] * e[tree.left[b]] * e[tree.right[b]]

    for sweep in range(rates.sweeps):
        if sweep:
            fix = blocked @ (weight * e)
        own = pl + pd * e * e + e * (mean - fix) / norm
        e[leaves] = own[leaves]
        climb(own)
        mean = (weight * e).sum()
    own = pl + pd * e * e + e * (mean - fix) / norm
    e[leaves] = (1 - missing[leaves]) * e[leaves] + missing[leaves]
    climb(own)
    mean = (weight * e).sum()
    origin = multiplier("O")
    if (origin < 0).any():
        origin = (origin < 0).astype(REAL)
    if origin[tree.root] == 1:
        origin[tree.root] = rates.origin_root
    return Branches(tree, rates, pd, pl, ps, weight, norm, blocked, e, mean, fix, origin, no_transfer)


def species_of(gene: str, separators: str = "_@", field_: int = 0) -> str:
    """The species in a gene's name: one of its parts, or with -1 all but the first."""
    import re

    parts = re.split("[" + re.escape(separators) + "]+", gene)
    return "_".join(parts[1:]) if field_ == -1 else parts[field_]


@dataclass
class Family:
    """A clade table laid out for the recursion: rows by size, splits in a row with their probabilities, the root last."""

    table: CladeTable
    clades: list[int]
    groups: list[tuple[int, int]]
    split_rows: np.ndarray
    split_left: np.ndarray
    split_right: np.ndarray
    split_p: np.ndarray
    at: np.ndarray
    leaf_species: list[str]


def layout(table: CladeTable, rates: Rates) -> Family:
    clades = table.order() if table.n > 1 else []
    row = {g: k for k, g in enumerate(clades)}
    splits = table.splits()
    left, right, p, at = [], [], [], [0]
    for g in clades:
        for a, b, _ in splits.get(g, ()):
            left.append(row[a])
            right.append(row[b])
            low = table.bips.get(g, 0.0) <= rates.min_bip_count
            p.append(0.0 if low else table.p_dip(g, a, b) ** rates.seq_beta)
        at.append(len(left))
    for a, b, q in table.root_pairs():
        left.append(row[a])
        right.append(row[b])
        low = max(table.bips.get(a, 0.0), table.bips.get(b, 0.0)) <= rates.min_bip_count and table.n >= 4
        p.append(0.0 if low else q**rates.seq_beta)
    at.append(len(left))
    groups, start = [], 0
    for k in range(1, len(clades) + 1):
        if k == len(clades) or clades[k].bit_count() != clades[start].bit_count():
            groups.append((start, k))
            start = k
    groups.append((len(clades), len(clades) + 1))
    names = [species_of(x, rates.separators, rates.species_field) for x in table.leaves]
    rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
    return Family(table, clades, groups, rows, np.array(left, dtype=np.int64), np.array(right, dtype=np.int64), np.array(p, dtype=REAL), np.array(at), names)


@dataclass
class Fit:
    """The filled tables of a family: value of each clade on each branch, and the likelihood."""

    family: Family
    branches: Branches
    q: np.ndarray
    log_likelihood: float
    origin_log: np.ndarray


def likelihood(family: Family, b: Branches) -> Fit:
    tree, table = b.tree, family.table
    n, m = tree.n, len(family.clades) + 1
    leaf_branch = {x: k for k, x in enumerate(tree.names)}
    unknown = [x for x in family.leaf_species if x not in leaf_branch]
    if unknown:
        raise ValueError(f"species not in the tree: {sorted(set(unknown))}")
    present = np.zeros((m, n), dtype=REAL)
    for k in range(table.n):
        present[k if table.n > 1 else 0, leaf_branch[family.leaf_species[k]]] = 1
    for k, g in enumerate(family.clades[: table.n]):
        present[k] = 0
        present[k, leaf_branch[family.leaf_species[g.bit_length() - 1]]] = 1
    q, mean, fix = np.zeros((m, n), dtype=REAL), np.zeros(m, dtype=REAL), np.zeros((m, n), dtype=REAL)
    inner = np.arange(tree.n_leaves, n)
    lo, hi = tree.left[inner], tree.right[inner]
    moves = 0 if b.no_transfer else 1
    gone = (b.mean_extinct - b.correction) / b.norm * moves
    own_blocked = b.blocked @ b.weight
    for _ in range(b.rates.sweeps):
        for first, last in family.groups:
            rows = slice(first, last)
            base = present[rows] * b.ps
            s, t = family.at[first], family.at[last]
            if t > s:
                a, c = family.split_left[s:t], family.split_right[s:t]
                x, y = q[a], q[c]
                each = b.pd * x * y
                if moves:
                    each += (x * (mean[c][:, None] - fix[c]) + y * (mean[a][:, None] - fix[a])) / b.norm
                each[:, inner] += b.ps[inner] * (x[:, lo] * y[:, hi] + x[:, hi] * y[:, lo])
                each *= family.split_p[s:t, None]
                filled = np.flatnonzero(np.diff(family.at[first : last + 1]))
                base[filled] += np.add.reduceat(each, family.at[first:last][filled] - s, axis=0)
            old = q[rows]
            value = base + old * (2 * b.pd * b.extinct + gone)
            if moves:
                value += (mean[rows][:, None] - fix[rows]) / b.norm * b.extinct
            value[:, : tree.n_leaves] = np.maximum(value[:, : tree.n_leaves], TINY)
            for k, f, g in zip(inner.tolist(), lo.tolist(), hi.tolist()):
                value[:, k] = np.maximum(value[:, k] + b.ps[k] * (value[:, f] * b.extinct[g] + value[:, g] * b.extinct[f]), TINY)
            q[rows] = value
            mean[rows] = value @ b.weight
            fix[rows] = (value * b.weight) @ b.blocked.T if b.rates.exact_correction else value * own_blocked
    top = q[-1]
    norm = b.origin.sum()
    with np.errstate(divide="ignore"):
        origin_log = np.log(top) + np.log(b.origin) - np.log(norm)
        total = float(np.log((top * b.origin).sum()) - np.log((1 - b.extinct).sum()) - np.log(norm) + np.log(REAL(n)))
    return Fit(family, b, q, total, origin_log.astype(float))


def sample(fit: Fit, rng: np.random.Generator, trail: list[tuple[int, int, str, int, int]] | None = None) -> tuple[str, list[tuple[str, int, int]]]:
    """One reconciled tree and its events (kind, branch, other branch or -1), drawn from the terms of the likelihood.

    Kinds: O origination, S speciation, C copy at a leaf, D duplication, T transfer (other:
    recipient), L loss. A label lists what befell a gene on its way from the node above, the
    youngest first: .e for a speciation of e, .D@e, .T@e->f. A list given as trail gets a row
    (clade, place from 0, kind, branch, other) for each event, along the lineage that ends in the
    clade's split or leaf, the oldest first; the origination is the first of the root's.
    """
    b, fam, q = fit.branches, fit.family, fit.q
    tree, table = b.tree, fam.table
    allowed = np.where(b.blocked > 0, 0, b.weight[None, :])
    events: list[tuple[str, int, int]] = []
    root = len(fam.clades)
    w = q[root] * b.origin
    e = int(rng.choice(tree.n, p=(w / w.sum()).astype(float)))
    events.append(("O", e, -1))
    text: dict[int, str] = {}
    serial = 0
    stack: list[tuple] = [(root, e, "", 0, True)]

    def pick(options: list[tuple]) -> tuple:
        w = np.array([o[0] for o in options], dtype=REAL)
        return options[int(rng.choice(len(w), p=(w / w.sum()).astype(float)))]

    def recipient(values: np.ndarray, donor: int) -> int:
        w = allowed[donor] * values
        return int(rng.choice(tree.n, p=(w / w.sum()).astype(float)))

    while stack:
        item = stack.pop()
        if item[0] == "join":
            _, slot, x, y, label = item
            text[slot] = f"({text.pop(x)},{text.pop(y)}){label}"
            continue
        i, e, label, slot, top = item
        past = len(events) - (1 if top else 0)
        size_one = i < table.n or (table.n == 1 and i == root)
        steps = 0
        while True:
            steps += 1
            options: list[tuple] = []
            if size_one:
                gene = table.leaves[0] if table.n == 1 else table.leaves[fam.clades[i].bit_length() - 1]
                if e < tree.n_leaves and tree.names[e] == species_of(gene, b.rates.separators, b.rates.species_field):
                    options.append((b.ps[e], "leaf", gene))
            inside = e >= tree.n_leaves
            f, g = (int(tree.left[e]), int(tree.right[e])) if inside else (-1, -1)
            move = 0 if b.no_transfer else 1
            for s in range(int(fam.at[i]), int(fam.at[i + 1])):
                x, y, p = int(fam.split_left[s]), int(fam.split_right[s]), fam.split_p[s]
                if inside:
                    options += [(b.ps[e] * q[x, f] * q[y, g] * p, "S", x, f, y, g), (b.ps[e] * q[x, g] * q[y, f] * p, "S", x, g, y, f)]
                options.append((b.pd[e] * q[x, e] * q[y, e] * p, "D", x, e, y, e))
                if move:
                    options += [(q[x, e] * (allowed[e] @ q[y]) / b.norm[e] * p, "T", x, e, y, -1), (q[y, e] * (allowed[e] @ q[x]) / b.norm[e] * p, "T", y, e, x, -1)]
            if inside:
                options += [(b.ps[e] * q[i, f] * b.extinct[g], "SL", f, g), (b.ps[e] * q[i, g] * b.extinct[f], "SL", g, f)]
            if move:
                options.append(((allowed[e] @ q[i]) / b.norm[e] * b.extinct[e], "TL"))
            # Duplications and transfers whose new copy dies out leave the gene where it is and change nothing seen.
            got = pick(options)
            kind = got[1]
            if kind == "SL":
                label = f".{tree.branch_name(e)}" + label
                events += [("S", e, -1), ("L", got[3], -1)]
                e = got[2]
                continue
            if kind == "TL":
                to = recipient(q[i], e)
                label = f".T@{tree.branch_name(e)}->{tree.branch_name(to)}" + label
                events += [("T", e, to), ("L", e, -1)]
                e = to
                continue
            break
        clade = fam.clades[i] if i < root else table.full

        def note(clade=clade, past=past):
            if trail is not None:
                trail.extend((clade, k, *event) for k, event in enumerate(events[past:]))

        if kind == "leaf":
            events.append(("C", e, -1))
            note()
            text[slot] = got[2] + label
            continue
        x, at_x, y, at_y = got[2:]
        if kind == "S":
            label = f".{tree.branch_name(e)}" + label
            events.append(("S", e, -1))
        elif kind == "D":
            label = f".D@{tree.branch_name(e)}" + label
            events.append(("D", e, -1))
        else:
            at_y = recipient(q[y], e)
            label = f".T@{tree.branch_name(e)}->{tree.branch_name(at_y)}" + label
            events.append(("T", e, at_y))
        note()
        one, two = serial + 1, serial + 2
        serial += 2
        stack += [("join", slot, one, two, label), (x, at_x, "", one, False), (y, at_y, "", two, False)]
    return text[0] + ";", events
