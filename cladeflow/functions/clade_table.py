"""The clade table of one family as arrays: conditional clade probabilities and what follows from them.

Clades are integers with one bit for each leaf, leaves numbered by name. They are kept by
size, then value, so every split's parts come before it; the last row is the root, which
splits into every pair of complementary clades.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np

from cladeflow.functions import newick
from cladeflow.functions.clade_math import bipartitions, trees_with_clade, trees_with_split, unrooted_trees


@dataclass
class CladeTable:
    leaves: list[str]
    observations: float
    #: Counts of clades and of splits (clade, part, part) with part < part, and sums of branch lengths.
    bips: dict[int, float]
    dips: dict[tuple[int, int, int], float]
    lengths: dict[int, float]
    alpha: float = 0.0
    beta: float = 0.0
    _order: list[int] | None = field(default=None, repr=False)

    @property
    def n(self) -> int:
        return len(self.leaves)

    @property
    def full(self) -> int:
        return (1 << self.n) - 1

    @property
    def index(self) -> dict[str, int]:
        return {x: k for k, x in enumerate(self.leaves)}

    def order(self) -> list[int]:
        """All clades but the root, by size, then value."""
        if self._order is None:
            seen = {1 << k for k in range(self.n)} | set(self.bips) | {p for d in self.dips for p in d}
            seen.discard(self.full)
            self._order = sorted(seen, key=lambda c: (c.bit_count(), c))
        return self._order

    def splits(self) -> dict[int, list[tuple[int, int, float]]]:
        out: dict[int, list[tuple[int, int, float]]] = {}
        for (g, a, b), n in sorted(self.dips.items()):
            out.setdefault(g, []).append((a, b, n))
        return out

    def p_bip(self, clade: int) -> float:
        """Probability of a clade; of one never seen, what the prior alpha gives it."""
        if self.n < 4:
            return 1.0
        size = clade.bit_count()
        count = self.observations if size == 1 or size == self.n - 1 else self.bips.get(clade, 0.0)
        if self.alpha > 0:
            return (count + self.alpha * (trees_with_clade(self.n, size) / unrooted_trees(self.n))) / (self.observations + self.alpha)
        return count / self.observations

    def p_dip(self, clade: int, left: int, right: int) -> float:
        """Probability of a split given its clade; 0 if never seen and there is no prior."""
        if self.n < 4:
            return 1.0
        size = clade.bit_count()
        seen = clade in self.bips
        split = self.dips.get((clade, min(left, right), max(left, right)), 0.0) if seen else 0.0
        count = self.bips.get(clade, 0.0)
        if size == 1 or size == self.n - 1:
            count = self.observations
        if self.alpha > 0 or self.beta > 0:
            all_ = unrooted_trees(self.n)
            flat = self.beta if seen else 0.0
            top = split + self.alpha * (trees_with_split(self.n, left.bit_count(), right.bit_count()) / all_) + (flat / bipartitions(size) if size > 1 else 0.0)
            return top / (count + self.alpha * (trees_with_clade(self.n, size) / all_) + flat)
        return split / count if count else 0.0

    def score(self, tree: str) -> float:
        """log probability of a tree on these leaves; -inf if it has a split never seen and there is no prior.

        The tree is read from the branch of the first leaf: its clades without that leaf each
        contribute their split, and the branch itself its probability.
        """
        root = newick.parse(tree)
        index = self.index
        if sorted(root.leaf_names()) != self.leaves:
            return -math.inf
        if self.n < 4:
            return 0.0
        splits, _ = newick.directed_splits(root, index)
        total = math.log(self.p_bip(self.full ^ 1))
        for g, a, b in splits:
            if not g & 1:
                p = self.p_dip(g, a, b)
                if p <= 0:
                    return -math.inf
                total += math.log(p)
        return total

    def clade_share(self, tree: str) -> float:
        """Share of a tree's inner clades that the sample has."""
        splits, _ = newick.directed_splits(newick.parse(tree), self.index)
        got = [g in self.bips for g, _, _ in splits]
        return sum(got) / len(got) if got else 1.0

    def recompose(self, tree: str) -> dict[int, float]:
        """For each clade of a tree, the product of the split probabilities within it."""
        splits, _ = newick.directed_splits(newick.parse(tree), self.index)
        out = {1 << k: 1.0 for k in range(self.n)}
        for g, a, b in sorted(splits, key=lambda s: s[0].bit_count()):
            out[g] = self.p_dip(g, a, b) * out[a] * out[b]
        return out

    def count_trees(self) -> int:
        """Rooted trees that the splits can be put together to, counting each rooting."""
        n = {1 << k: 1 for k in range(self.n)}
        splits = self.splits()
        for g in self.order():
            if g.bit_count() > 1:
                n[g] = sum(n.get(a, 0) * n.get(b, 0) for a, b, _ in splits.get(g, ()))
        doubled = 0
        for g in self.bips:
            other = self.full ^ g
            a, b = g.bit_count(), other.bit_count()
            if a > b:
                doubled += 2 * n.get(g, 0) * n.get(other, 0)
            elif a == b:
                doubled += n.get(g, 0) * n.get(other, 0)
        return doubled // 2

    def best_tree(self) -> tuple[str, float]:
        """The tree of greatest probability among those the splits give, with supports and mean branch lengths, and its probability."""
        best, choice, share = {1 << k: 1.0 for k in range(self.n)}, {}, {}
        splits = self.splits()
        for g in self.order():
            if g.bit_count() > 1:
                values = [(self.p_dip(g, a, b) * best.get(a, 0.0) * best.get(b, 0.0), a, b) for a, b, _ in splits.get(g, ())]
                top = max(values, key=lambda v: (v[0], -v[1]), default=(0.0, 0, 0))
                best[g], choice[g] = top[0], top[1:]
                share[g] = top[0] / sum(v[0] for v in values) if top[0] else 0.0
        roots = sorted((best.get(g, 0.0) * best.get(self.full ^ g, 0.0) * self.p_bip(g), -g) for g in self.bips)
        if not roots or self.n < 3:
            names = [f"{x}:{self.mean_length(1 << k):.6g}" for k, x in enumerate(self.leaves)]
            return ("(" + ",".join(names) + ");" if self.n > 1 else f"{self.leaves[0]};"), 1.0
        p, root = roots[-1][0], -roots[-1][1]
        # Inner branches occur twice among the clades, once for either side.
        support = p / sum(r[0] for r in roots) * 2

        def render(clade: int) -> str:
            done, stack = {}, [(clade, False)]
            while stack:
                g, ready = stack.pop()
                if g.bit_count() == 1:
                    done[g] = f"{self.leaves[g.bit_length() - 1]}:{self.mean_length(g):.6g}"
                elif ready:
                    a, b = choice[g]
                    done[g] = f"({done[a]},{done[b]}){share[g]:.6g}:{self.mean_length(g):.6g}"
                else:
                    stack += [(g, True), *((x, False) for x in choice[g])]
            return done[clade]

        return f"({render(root)},{render(self.full ^ root)}){support:.6g}:{min(self.mean_length(root), 0.99):.6g};", p

    def mean_length(self, clade: int) -> float:
        n = self.observations if clade.bit_count() == 1 else self.bips.get(clade) or self.observations
        return self.lengths.get(clade, 0.0) / n if n else 0.0

    def random_tree(self, rng: np.random.Generator) -> str:
        """A tree drawn from the split probabilities, from a clade drawn by count; the priors' mass goes to splits drawn at random."""
        if self.n < 3:
            return "(" + ",".join(f"{x}:1" for x in self.leaves) + ");" if self.n > 1 else f"{self.leaves[0]};"
        clades = sorted(self.bips)
        w = np.array([self.bips[g] for g in clades])
        start = clades[int(rng.choice(len(clades), p=w / w.sum()))]
        splits = self.splits()

        def cut(g: int) -> tuple[int, int]:
            options = splits.get(g, [])
            p = np.array([self.p_dip(g, a, b) for a, b, _ in options])
            if len(p) and rng.random() < max(p.sum(), 0 if self.alpha or self.beta else 1):
                return options[int(rng.choice(len(p), p=p / p.sum()))][:2]
            bits = [k for k in range(self.n) if g >> k & 1]
            while True:
                a = sum(1 << k for k in bits if rng.random() < 0.5)
                if a and a != g:
                    return a, g ^ a

        done: dict[int, str] = {}
        for top in (start, self.full ^ start):
            stack: list[tuple[int, tuple[int, int] | None]] = [(top, None)]
            while stack:
                g, parts = stack.pop()
                if g.bit_count() == 1:
                    done[g] = self.leaves[g.bit_length() - 1] + ":1"
                elif parts:
                    done[g] = f"({done[parts[0]]},{done[parts[1]]}):1"
                else:
                    parts = cut(g)
                    stack += [(g, parts), (parts[0], None), (parts[1], None)]
        return f"({done[start]},{done[self.full ^ start]});"

    def restrict(self, keep: Iterable[str]) -> CladeTable:
        """The table of fewer leaves: clades are cut to those kept, counts of clades that become equal add up, lengths become 1."""
        keep = set(keep)
        old = [k for k, x in enumerate(self.leaves) if x in keep]
        names = [self.leaves[k] for k in old]
        full = (1 << len(old)) - 1
        moved: dict[int, int] = {}

        def cut(g: int) -> int:
            if g not in moved:
                moved[g] = sum(1 << i for i, k in enumerate(old) if g >> k & 1)
            return moved[g]

        bips: dict[int, float] = {}
        dips: dict[tuple[int, int, int], float] = {}
        for (g, a, b), n in self.dips.items():
            g, a, b = cut(g), cut(a), cut(b)
            if a and b and g != full:
                dips[g, min(a, b), max(a, b)] = dips.get((g, min(a, b), max(a, b)), 0.0) + n
        for (g, _, _), n in dips.items():
            bips[g] = bips.get(g, 0.0) + n
        if len(old) == 2:
            bips = {1: self.observations}
        lengths = {g: (bips.get(g) or self.observations) * 1.0 for g in {*bips, *(1 << k for k in range(len(old)))}}
        return CladeTable(names, self.observations, bips, dips, lengths, self.alpha, self.beta)

    def root_pairs(self) -> list[tuple[int, int, float]]:
        """Every pair of complementary clades once, with its probability."""
        if self.n == 1:
            return []
        return sorted((min(g, self.full ^ g), max(g, self.full ^ g), self.p_bip(g)) for g in {min(g, self.full ^ g) for g in self.bips})


def observe(trees: Iterable[tuple[str, float]], alpha: float = 0.0, beta: float = 0.0) -> CladeTable:
    """The clade table of weighted trees on the same leaves."""
    table: CladeTable | None = None
    index: dict[str, int] = {}
    for text, weight in trees:
        root = newick.parse(text)
        names = sorted(root.leaf_names())
        if table is None:
            table = CladeTable(names, 0.0, {}, {}, {}, alpha, beta)
            index = table.index
        elif names != table.leaves:
            raise ValueError("trees of one family have different leaves")
        table.observations += weight
        splits, lengths = newick.directed_splits(root, index) if len(names) > 1 else ([], {1: 1.0})
        if len(names) == 2:
            table.bips[1] = table.bips.get(1, 0.0) + weight
        for g, a, b in splits:
            table.dips[g, a, b] = table.dips.get((g, a, b), 0.0) + weight
            table.bips[g] = table.bips.get(g, 0.0) + weight
        for g, x in lengths.items():
            table.lengths[g] = table.lengths.get(g, 0.0) + x
    if table is None:
        raise ValueError("no trees")
    return table


def pack_mask(mask: int, n: int) -> bytes:
    """A clade as bytes, most significant first, so that byte order is numeric order."""
    return mask.to_bytes((n + 7) // 8, "big")


def unpack_mask(data: bytes) -> int:
    return int.from_bytes(data, "big")


def rooted_topologies(names: list[str]) -> Iterable[str]:
    """Every rooted binary topology on the names, by adding leaves to every branch in turn; few names only."""
    if len(names) == 1:
        yield names[0]
        return
    if len(names) > 8:
        raise ValueError("there are too many topologies of over 8 leaves")

    def insert(tree, leaf):
        yield (tree, leaf)
        if isinstance(tree, tuple):
            for t in insert(tree[0], leaf):
                yield (t, tree[1])
            for t in insert(tree[1], leaf):
                yield (tree[0], t)

    def text(tree) -> str:
        return f"({text(tree[0])},{text(tree[1])})" if isinstance(tree, tuple) else tree

    trees = [names[0]]
    for leaf in names[1:]:
        trees = [t for old in trees for t in insert(old, leaf)]
    for t in trees:
        yield text(t) + ";"
