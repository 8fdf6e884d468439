"""Downhill simplex in a box, on log-scaled coordinates, with as many function values asked for at once as possible."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def minimise(f: Callable[[list[np.ndarray]], list[float]], start: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 200, tolerance: float = 1e-6) -> tuple[np.ndarray, float, int]:
    """The best point found, its value and the number of evaluations.

    f takes a list of points and returns their values: each round asks for the reflected,
    expanded and both contracted points together, so that one distributed job can serve all.
    """
    lo, hi = np.log(np.maximum(low, 1e-300)), np.log(high)
    x0 = np.clip(np.log(np.maximum(start, 1e-300)), lo, hi)
    k = len(x0)
    points = [x0] + [np.clip(x0 + np.eye(k)[i] * (1.0 if x0[i] + 1.0 <= hi[i] else -1.0), lo, hi) for i in range(k)]
    ask = lambda xs: [float(v) if np.isfinite(v) else np.inf for v in f([np.exp(x) for x in xs])]
    values, n = ask(points), k + 1
    for _ in range(rounds):
        order = np.argsort(values, kind="stable")
        points, values = [points[i] for i in order], [values[i] for i in order]
        if abs(values[-1] - values[0]) <= tolerance * (abs(values[0]) + tolerance) and max(np.abs(points[-1] - points[0])) < 1e-2:
            break
        centre = np.mean(points[:-1], axis=0)
        way = centre - points[-1]
        tries = [np.clip(centre + c * way, lo, hi) for c in (1.0, 2.0, 0.5, -0.5)]
        reflected, expanded, outer, inner = ask(tries)
        n += 4
        if reflected < values[0] and expanded < reflected:
            points[-1], values[-1] = tries[1], expanded
        elif reflected < values[-2]:
            points[-1], values[-1] = tries[0], reflected
        elif reflected < values[-1] and outer <= reflected:
            points[-1], values[-1] = tries[2], outer
        elif inner < values[-1]:
            points[-1], values[-1] = tries[3], inner
        else:
            points = [points[0]] + [points[0] + (x - points[0]) / 2 for x in points[1:]]
            values[1:] = ask(points[1:])
            n += k
    best = int(np.argmin(values))
    return np.exp(points[best]), values[best], n
