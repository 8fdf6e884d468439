"""Numbers of trees, as Python integers and as Spark columns of logarithms."""

from __future__ import annotations

from math import comb, log

from pyspark.sql import Column
from pyspark.sql import functions as F


def double_factorial(n: int) -> int:
    """n!! for odd n; 1 below 1."""
    out = 1
    while n > 1:
        out *= n
        n -= 2
    return out


def unrooted_trees(n_leaves: int) -> int:
    return double_factorial(2 * n_leaves - 5) if n_leaves >= 3 else 1


def rooted_trees(n_leaves: int) -> int:
    return double_factorial(2 * n_leaves - 3)


def bipartitions(n_leaves: int) -> int:
    """Ways to divide a leaf set in two."""
    return 2 ** (n_leaves - 1) - 1


def trees_with_clade(n_leaves: int, size: int) -> int:
    """Unrooted trees that have a branch with so many leaves on one side."""
    rest = n_leaves - size
    if size == 1 or rest == 1:
        return unrooted_trees(n_leaves)
    return rooted_trees(max(2, rest)) * rooted_trees(max(2, size))


def trees_with_split(n_leaves: int, left: int, right: int) -> int:
    """Unrooted trees that have a node with two sides of these sizes."""
    rest = n_leaves - left - right
    return rooted_trees(max(2, rest)) * rooted_trees(max(2, left)) * rooted_trees(max(2, right))


def binomial(n: int, m: int) -> int:
    return comb(n, m)


def trinomial(a: int, b: int, c: int) -> int:
    return comb(a + b + c, c) * comb(a + b, b)


def log_table(max_leaves: int) -> list[float]:
    """log of (2k - 3)!! for k from 0 to max_leaves."""
    out, total = [0.0, 0.0, 0.0], 0.0
    for k in range(3, max_leaves + 1):
        total += log(2 * k - 3)
        out.append(total)
    return out[: max_leaves + 1]


def _log_rooted(size: Column, max_leaves: int) -> Column:
    return F.element_at(F.array(*map(F.lit, log_table(max(max_leaves, 2)))), F.greatest(size, F.lit(2)).cast("int") + 1)


def log_trees_with_clade(n_leaves: Column, size: Column, max_leaves: int = 400) -> Column:
    rest = n_leaves - size
    edge = (size == 1) | (rest == 1)
    return F.when(edge, _log_rooted(F.greatest(n_leaves - 1, F.lit(2)), max_leaves)).otherwise(_log_rooted(rest, max_leaves) + _log_rooted(size, max_leaves))


def log_trees_with_split(n_leaves: Column, left: Column, right: Column, max_leaves: int = 400) -> Column:
    return _log_rooted(n_leaves - left - right, max_leaves) + _log_rooted(left, max_leaves) + _log_rooted(right, max_leaves)


def log_unrooted(n_leaves: Column, max_leaves: int = 400) -> Column:
    return _log_rooted(F.greatest(n_leaves - 1, F.lit(2)), max_leaves)


def _log_factorial(n: Column, most: int) -> Column:
    sums = [0.0]
    for k in range(1, most + 1):
        sums.append(sums[-1] + log(k))
    return F.element_at(F.array(*map(F.lit, sums)), n.cast("int") + 1)


def log_multinomial(*parts: Column, most: int = 400) -> Column:
    """log of the ways to deal a set of up to most members to parts of these sizes: two make a binomial coefficient, three a trinomial."""
    total = sum(parts[1:], parts[0])
    return _log_factorial(total, most) - sum((_log_factorial(p, most) for p in parts[1:]), _log_factorial(parts[0], most))
