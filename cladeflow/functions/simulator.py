"""Simulated species and gene histories: a Moran population of species, genes within it, and their trees."""

from __future__ import annotations

import bisect
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass
class History:
    """Births of a population of n species, oldest first: (time, species that splits, species it replaces).

    Time runs down from start to 0. A split makes two new lineages, in both places.
    """

    n: int
    start: float
    events: list[tuple[float, int, int]]


def small_draws(rng: np.random.Generator) -> Callable[[int], int]:
    """The numbers that ``rng.integers(n)`` would give, for n below 2 ** 32, at a third of the cost of a call."""
    bits = rng.bit_generator.ctypes
    word, state = bits.next_uint32, bits.state

    def draw(n: int) -> int:
        if n == 1:
            return 0
        m = word(state) * n
        if m & 0xFFFFFFFF < n:
            least = (1 << 32) % n
            while m & 0xFFFFFFFF < least:
                m = word(state) * n
        return m >> 32

    return draw


def moran(n: int, rng: np.random.Generator, start: float = 2.0, sigma: float | None = None) -> History:
    """Pairs of birth and death at exponential times of rate sigma a species (n, unless given)."""
    if n < 2:
        raise ValueError("a population needs two species")
    rate = (n if sigma is None else sigma) * n
    out, t, scale = [], start, 1 / rate
    wait, draw = rng.standard_exponential, small_draws(rng)
    while True:
        t -= scale * wait()
        if t < 0:
            return History(n, start, out)
        dead, born = draw(n), draw(n - 1)
        out.append((t, born + (born >= dead), dead))


def species_tree(history: History, sampled: list[int]) -> str:
    """The tree of the species sampled at time 0, found backwards; lineages older than the population join at its start."""
    line = {k: (f"S{k}", 0.0) for k in sampled}
    for t, born, dead in reversed(history.events):
        if born in line and dead in line:
            (a, ta), (b, tb) = line[born], line.pop(dead)
            line[born] = (f"({a}:{t - ta:.10g},{b}:{t - tb:.10g})", t)
        elif dead in line:
            line[born] = line.pop(dead)
    parts = [line[k] for k in sorted(line)]
    while len(parts) > 1:
        (a, ta), (b, tb) = parts[0], parts[1]
        parts[:2] = [(f"({a}:{history.start - ta:.10g},{b}:{history.start - tb:.10g})", history.start)]
    return parts[0][0] + ";"


def random_tree(names: list[str], rng: np.random.Generator) -> str:
    """A tree on the same names by joining random pairs, with unit lengths."""
    parts = list(names)
    while len(parts) > 1:
        i, j = sorted(rng.choice(len(parts), 2, replace=False).tolist())
        b, a = parts.pop(j), parts.pop(i)
        parts.append(f"({a}:1,{b}:1)")
    return parts[0] + ";"


@dataclass
class GeneTree:
    newick: str
    n_genes: int
    duplications: int
    transfers: int
    losses: int


def gene_trees(history: History, sampled: list[int], rng: np.random.Generator, delta: float, tau: float, lambda_: float, omega: float = 0.0, start_genes: int = 1) -> list[GeneTree]:
    """Gene families along the species' history, and the trees of their copies in the sampled species.

    Genes duplicate, move to a species other than their own, and are lost, at rates a gene;
    families originate at rate omega a population. Species that split hand on all their genes.
    Events are drawn one after another; a tree keeps what survives, its labels what befell it.
    """
    genes: list[list[int]] = [[] for _ in range(history.n)]
    wait, each = rng.standard_exponential, delta + tau + lambda_
    up: list[tuple[int, float, str]] = []  # parent gene, time it arose, event that made it
    family: list[int] = []
    counts: dict[int, list[int]] = {}

    def new(parent: int, time: float, kind: str, of: int) -> int:
        up.append((parent, time, kind))
        family.append(of)
        return len(up) - 1

    def origin(species: int, time: float) -> None:
        f = len(counts)
        counts[f] = [0, 0, 0]
        genes[species].append(new(-1, time, "O", f))

    for species in range(history.n):
        for _ in range(start_genes):
            origin(species, history.start)
    t, n = history.start, history.n * start_genes  # n genes live now
    for at, born, dead in [*history.events, (0.0, -1, -1)]:
        while True:
            total = n * each + omega
            step = (1 / total) * wait() if total > 0 else np.inf
            if t - step <= at:
                break
            t -= step
            if rng.random() * total < omega:
                origin(int(rng.integers(history.n)), t)
                n += 1
                continue
            k = int(rng.integers(n))
            species = 0
            while k >= len(genes[species]):
                k -= len(genes[species])
                species += 1
            g = genes[species][k]
            what = rng.random() * each
            n += 1 if what < delta + tau else -1
            if what < delta:
                counts[family[g]][0] += 1
                genes[species][k] = new(g, t, "D", family[g])
                genes[species].append(new(g, t, "D", family[g]))
            elif what < delta + tau:
                counts[family[g]][1] += 1
                to = int(rng.integers(history.n - 1))
                genes[species][k] = new(g, t, "T", family[g])
                genes[to + (to >= species)].append(new(g, t, "T", family[g]))
            else:
                counts[family[g]][2] += 1
                genes[species].pop(k)
        t = at
        if born >= 0:
            old, first = genes[born], len(up)
            n += len(old) - len(genes[dead])
            genes[born] = list(range(first, first + len(old)))
            genes[dead] = list(range(first + len(old), first + 2 * len(old)))
            up += [(g, t, "S") for g in old] * 2
            family += [family[g] for g in old] * 2
    tips: dict[int, dict[int, str]] = {}
    for species in sampled:
        for k, g in enumerate(genes[species]):
            tips.setdefault(family[g], {})[g] = f"S{species}_{k}"
    out = []
    for f in sorted(tips):
        below: dict[int, tuple[str, float]] = {g: (name, 0.0) for g, name in tips[f].items()}
        todo = sorted(below)
        while todo:
            g = todo.pop()  # children have higher numbers than parents
            parent, time, kind = up[g]
            if parent < 0:
                text = below[g][0]
                out.append(GeneTree(text + ";", len(tips[f]), *counts[f]))
                break
            text, low = below.pop(g)
            if parent in below:
                other, other_low = below[parent]
                below[parent] = (f"({other}:{time - other_low:.10g},{text}:{time - low:.10g}).{kind}", time)
            else:
                below[parent] = (text, low)
                bisect.insort(todo, parent)
    return out
