"""Consensus by parsimony: the tree on which the clades of a sample, as weighted two-state characters, change least.

An unrooted tree is an array of neighbours; node k below the number of leaves is leaf k.
"""

from __future__ import annotations

import numpy as np

from cladeflow.functions import newick


def characters(clades: dict[int, float], n: int) -> tuple[np.ndarray, np.ndarray]:
    """States (1 or 2) by leaf and character, and weights: one character for each split with two leaves or more on both sides."""
    full = (1 << n) - 1
    own: dict[int, float] = {}
    for g, w in clades.items():
        g = full ^ g if g & 1 else g
        if 2 <= g.bit_count() <= n - 2:
            own[g] = max(own.get(g, 0.0), w)
    kept = sorted(own)
    states = np.array([[2 if g >> k & 1 else 1 for g in kept] for k in range(n)], dtype=np.uint8).reshape(n, len(kept))
    return states, np.array([own[g] for g in kept])


Tree = list[list[int]]


def changes(tree: Tree, states: np.ndarray, weights: np.ndarray, start: int = 0) -> float:
    """The weighted least number of changes, counted from the leaves towards leaf start."""
    order, stack = [], [(tree[start][0], start)]
    while stack:
        at, up = stack.pop()
        order.append((at, up))
        stack += [(x, at) for x in tree[at] if x != up]
    sets: dict[int, np.ndarray] = {}
    total = 0.0
    for at, up in reversed(order):
        below = [sets.pop(x) for x in tree[at] if x != up]
        if not below:
            sets[at] = states[at]
            continue
        common = below[0] & below[1]
        empty = common == 0
        total += float(weights[empty].sum())
        sets[at] = np.where(empty, below[0] | below[1], common)
    return total + float(weights[(sets[tree[start][0]] & states[start]) == 0].sum())


def _insert(tree: Tree, leaf: int, a: int, b: int) -> Tree:
    """A copy with the leaf on the edge between a and b."""
    out = [list(x) for x in tree]
    new = len(out)
    out.append([a, b, leaf])
    out[a][out[a].index(b)] = new
    out[b][out[b].index(a)] = new
    out[leaf] = [new]
    return out


def _edges(tree: Tree, n: int, inner: bool = False) -> list[tuple[int, int]]:
    return [(a, b) for a in range(len(tree)) for b in tree[a] if a < b and (not inner or a >= n)]


def _exchanges(tree: Tree, a: int, b: int) -> list[Tree]:
    """Both trees that differ in the inner edge between a and b."""
    out = []
    x = next(k for k in tree[a] if k != b)
    for y in [k for k in tree[b] if k != a]:
        new = [list(k) for k in tree]
        new[a][new[a].index(x)], new[b][new[b].index(y)] = y, x
        new[x][new[x].index(a)], new[y][new[y].index(b)] = b, a
        out.append(new)
    return out


def search(states: np.ndarray, weights: np.ndarray) -> tuple[Tree, float]:
    """Leaves are added one by one where they cost least, then inner edges exchanged while that lowers the changes.

    Ties go to the first edge, so the result is the same each time.
    """
    n = len(states)
    if n < 3:
        return ([[1], [0]] if n == 2 else [[]] * n), 0.0
    tree = _grown(list(range(n)))
    for leaf in range(3, n):
        options = [_insert(tree, leaf, a, b) for a, b in _edges(tree, n)]
        tree = options[int(np.argmin([changes(t, states, weights) for t in options]))]
    return _exchanged(tree, states, weights)


#: Families of up to so many leaves are searched exhaustively, by branch and bound.
EXACT_LEAVES = 9
#: Rounds of the ratchet for larger ones.
RATCHET = 12


def _grown(order: list[int]) -> Tree:
    """The tree of the first three leaves of an order; other leaves have no place yet."""
    n = len(order)
    tree: Tree = [[] for _ in range(n)] + [list(order[:3])]
    for x in order[:3]:
        tree[x] = [n]
    return tree


def exact(states: np.ndarray, weights: np.ndarray) -> tuple[Tree, float]:
    """The least tree of all, by branch and bound.

    Leaves are added in an order that tells characters apart early. A partial tree costs at
    least its own changes and one for each character whose leaves so far agree though not all
    do; beyond the best cost found, it is not grown.
    """
    n = len(states)
    if n < 4:
        return search(states, weights)
    tree, best = search(states, weights)
    varied = np.bitwise_or.reduce(states, axis=0) == 3
    order = [0]
    while len(order) < n:
        apart = [(-float((weights * (states[x] != states[order]).sum(axis=0)).sum()), x) for x in range(n) if x not in order]
        order.append(min(apart)[1])
    left = []  # of so many leaves placed, what the rest costs at least
    for k in range(n + 1):
        same = np.bitwise_or.reduce(states[order[:k]], axis=0) != 3 if k else varied
        left.append(float(weights[varied & same].sum()))
    stack = [(_grown(order), 3)]
    while stack:
        now, k = stack.pop()
        if k == n:
            continue
        grown = []
        for a, b in _edges(now, n):
            new = _insert(now, order[k], a, b)
            cost = changes(new, states, weights, order[0])
            if cost + left[k + 1] < best - 1e-9:
                if k + 1 == n:
                    tree, best = new, cost
                else:
                    grown.append((cost, new))
        stack += [(t, k + 1) for _, t in sorted(grown, key=lambda x: -x[0])]  # the cheapest is grown first
    return tree, best


def _exchanged(tree: Tree, states: np.ndarray, weights: np.ndarray) -> tuple[Tree, float]:
    """Inner edges exchanged while that lowers the changes."""
    n, best = len(states), changes(tree, states, weights)
    while True:
        options = [t for a, b in _edges(tree, n, inner=True) for t in _exchanges(tree, a, b)]
        costs = [changes(t, states, weights) for t in options]
        if not costs or min(costs) >= best - 1e-9:
            return tree, best
        k = int(np.argmin(costs))
        tree, best = options[k], costs[k]


def ratchet(states: np.ndarray, weights: np.ndarray, rounds: int = RATCHET, seed: int = 0) -> tuple[Tree, float]:
    """Search, then by turns: weigh some characters more, exchange edges, and exchange again under the true weights; the best tree met."""
    tree, best = search(states, weights)
    if len(states) < 5:
        return tree, best
    rng, now = np.random.default_rng(seed), tree
    for _ in range(rounds):
        heavy = np.where(rng.random(len(weights)) < 0.25, 3.0, 1.0)
        now, _ = _exchanged(now, states, weights * heavy)
        now, cost = _exchanged(now, states, weights)
        if cost < best - 1e-9:
            tree, best = now, cost
    return tree, best


def bound(leaves: list[str], clades: dict[int, float], cost: float) -> float:
    """A number of changes that no tree is below: the cost of the tree found where the search was exhaustive, else one change for each character."""
    n = len(leaves)
    return cost if n <= EXACT_LEAVES else float(characters(clades, n)[1].sum())


def consensus(leaves: list[str], clades: dict[int, float]) -> tuple[newick.Node, float]:
    """The tree, rooted beside the first leaf, and its weighted number of changes."""
    n = len(leaves)
    if n < 3:
        root = newick.Node(leaves[0]) if n == 1 else newick.Node()
        for x in leaves if n == 2 else ():
            root.add(newick.Node(x))
        return root, 0.0
    states, weights = characters(clades, n)
    tree, cost = exact(states, weights) if n <= EXACT_LEAVES else ratchet(states, weights)
    root = newick.Node()
    root.add(newick.Node(leaves[0]))
    stack = [(tree[0][0], 0, root)]
    while stack:
        at, up, parent = stack.pop()
        node = newick.Node(leaves[at]) if at < n else newick.Node()
        parent.add(node)
        stack += [(x, at, node) for x in reversed(tree[at]) if x != up]
    return root, cost
