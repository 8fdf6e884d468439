"""Species trees as arrays: branch numbers, closure, ages and time slices.

Branches are numbered leaves first, by name, then inner nodes generation by generation,
so children come before their parent and the root is last.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from cladeflow.functions import newick
from cladeflow.functions.newick import Node


@dataclass
class SpeciesTree:
    names: list[str]  # leaf names; inner branches are named by their number
    labels: list[str]
    left: np.ndarray
    right: np.ndarray
    parent: np.ndarray
    length: np.ndarray
    n_leaves: int
    newick: str

    @property
    def n(self) -> int:
        return len(self.parent)

    @property
    def root(self) -> int:
        return self.n - 1

    def ancestors(self, by_date: bool = False) -> np.ndarray:
        """ancestors[e, f]: f lies on the way from e to the root, both included.

        by_date adds every f that ends before e begins, so that transfers to the past are out too.
        """
        out = np.eye(self.n, dtype=bool)
        for e in range(self.n - 1, -1, -1):
            if self.parent[e] >= 0:
                out[e] |= out[self.parent[e]]
        if by_date:
            h = self.heights()
            start = np.where(self.parent >= 0, h[self.parent], np.inf)
            out |= start[:, None] < h[None, :]
        return out

    def heights(self) -> np.ndarray:
        """Distance down to the deepest leaf."""
        h = np.zeros(self.n)
        for e in range(self.n_leaves, self.n):
            h[e] = max(h[self.left[e]] + self.length[self.left[e]], h[self.right[e]] + self.length[self.right[e]])
        return h

    def ages(self) -> np.ndarray:
        """Node ages on a scale where the root has 1, each the mean over its leaves; equal ages of inner nodes are set apart."""
        total, count = np.zeros(self.n), np.ones(self.n)
        for e in range(self.n_leaves, self.n):
            a, b = self.left[e], self.right[e]
            count[e] = count[a] + count[b]
            total[e] = total[a] + total[b] + self.length[a] * count[a] + self.length[b] * count[b]
        age = total / count
        for e in range(self.n_leaves, self.n):
            age[e] = max(age[e], age[self.left[e]] + 1e-9, age[self.right[e]] + 1e-9) if e >= self.n_leaves else 0.0
        top = age[self.root] if age[self.root] > 0 else 1.0
        age = age / top
        inner = sorted(range(self.n_leaves, self.n), key=lambda e: (age[e], e))
        for a, b in zip(inner, inner[1:]):
            if age[b] <= age[a]:
                age[b] = age[a] + 1e-5
        age[: self.n_leaves] = 0.0
        return age

    def below(self) -> list[list[str]]:
        """Leaf names below each branch."""
        out: list[list[str]] = [[x] for x in self.names]
        for e in range(self.n_leaves, self.n):
            out.append(sorted(out[self.left[e]] + out[self.right[e]]))
        return out

    def branch_name(self, e: int) -> str:
        return self.names[e] if e < self.n_leaves else str(e)

    def numbered(self) -> str:
        """The tree with branch numbers as labels of inner nodes."""
        text = list(self.names)
        for e in range(self.n_leaves, self.n):
            a, b = self.left[e], self.right[e]
            text.append(f"({text[a]}:{self.length[a]:.12g},{text[b]}:{self.length[b]:.12g}){e}")
        return text[-1] + ";"


def read_species_tree(text: str) -> SpeciesTree:
    """A rooted binary species tree; a tree of one leaf is one branch."""
    root = newick.parse(text)
    leaves = sorted(root.leaves(), key=lambda n: n.name)
    if len({n.name for n in leaves}) != len(leaves):
        raise ValueError("species names must differ")
    number: dict[int, int] = {id(n): k for k, n in enumerate(leaves)}
    order: list[Node] = list(leaves)
    now = leaves
    while now:
        parents, seen = [], set()
        for n in now:
            p = n.parent
            if p is not None and id(p) not in seen and id(p) not in number and all(id(c) in number for c in p.children):
                if len(p.children) != 2:
                    raise ValueError("the species tree must be binary")
                seen.add(id(p))
                parents.append(p)
        for p in parents:
            number[id(p)] = len(order)
            order.append(p)
        now = parents
    n = len(order)
    left, right, parent = (np.full(n, -1, dtype=np.int64) for _ in range(3))
    length = np.array([x.length if x.length is not None else 0.0 for x in order])
    for x in order:
        k = number[id(x)]
        if x.parent is not None:
            parent[k] = number[id(x.parent)]
        if x.children:
            left[k], right[k] = (number[id(c)] for c in x.children)
    if len(order) != sum(1 for _ in root.preorder()):
        raise ValueError("the species tree must be binary")
    return SpeciesTree([x.name for x in leaves], [x.label for x in order], left, right, parent, length, len(leaves), text)


def slices(tree: SpeciesTree, ages: np.ndarray | None = None) -> list[tuple[float, float, list[int]]]:
    """Time slices from the leaves up: (lower age, upper age, branches alive), the branch pair that ends in the upper node last.

    The last slice is the stem above the root, of length 1 unless the root branch has one.
    """
    age = tree.ages() if ages is None else ages
    inner = sorted(range(tree.n_leaves, tree.n), key=lambda e: age[e])
    bounds = [0.0, *(age[e] for e in inner)]
    out = []
    for k, e in enumerate(inner):
        lo, hi = bounds[k], bounds[k + 1]
        alive = [b for b in range(tree.n) if age[b] <= lo and tree.parent[b] >= 0 and age[tree.parent[b]] >= hi]
        ends = [b for b in alive if tree.parent[b] == e]
        out.append((lo, hi, [b for b in alive if b not in ends] + ends))
    top = bounds[-1]
    stem = tree.length[tree.root] or 1.0
    out.append((top, top + stem, [tree.root]))
    return out


def grid(lower: float, upper: float, step: float, least: int) -> np.ndarray:
    """Ends of the equal sub-slices of a slice."""
    n = max(int(np.ceil((upper - lower) / step)), least)
    return lower + (upper - lower) * np.arange(n + 1) / n


def coalescent_lengths(tree: SpeciesTree) -> SpeciesTree:
    """The tree re-dated by rank: from the youngest inner node on, each is 1 / lineages higher than the one before; the root has 1."""
    age = tree.ages()
    inner = sorted(range(tree.n_leaves, tree.n), key=lambda e: age[e])
    n = tree.n_leaves
    height, at = np.zeros(tree.n), 0.0
    for rank, e in enumerate(inner):
        at += 1.0 / (n - rank)
        height[e] = at
    height /= max(at, 1e-300)
    length = np.where(tree.parent >= 0, height[tree.parent] - height, tree.length)
    return SpeciesTree(tree.names, tree.labels, tree.left, tree.right, tree.parent, length, tree.n_leaves, tree.newick)
