"""Quasi-Newton descent in a box, on log-scaled coordinates, asking for all step lengths of a round at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Step lengths tried in a round, as shares of the quasi-Newton step.
STEPS = (1.0, 0.3, 0.1, 0.02)
#: Differences of points and gradients that the estimate of curvature comes from.
MEMORY = 10


def _direction(g: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], free: np.ndarray) -> np.ndarray:
    """Minus the gradient times the estimated inverse curvature, within the free coordinates."""
    q, kept = np.where(free, g, 0.0), []
    for s, y in reversed(pairs):
        s, y = np.where(free, s, 0.0), np.where(free, y, 0.0)
        if s @ y > 1e-12 * np.sqrt((s @ s) * (y @ y)) > 0:
            a = s @ q / (s @ y)
            q = q - a * y
            kept.append((s, y, a))
    if kept:
        s, y, _ = kept[0]
        q = q * (s @ y / (y @ y))
    for s, y, a in reversed(kept):
        q = q + (a - y @ q / (s @ y)) * s
    return -np.where(free, q, 0.0)


def descend(f: Callable[[list[np.ndarray]], list[tuple[float, np.ndarray]]], start: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 100, tolerance: float = 1e-7) -> tuple[np.ndarray, float, int]:
    """The best point found, its value and the number of rounds.

    f takes a list of points and returns the value and the gradient at each; a round is one
    call. It ends when the gradient that doesn't point out of the box is small, or no step helps.
    """
    lo, hi = np.log(np.maximum(low, 1e-300)), np.log(high)
    x = np.clip(np.log(np.maximum(start, 1e-300)), lo, hi)

    def ask(points: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
        at = [np.exp(p) for p in points]
        return [(v if np.isfinite(v) else np.inf, np.nan_to_num(g * p)) for (v, g), p in zip(f(at), at)]

    value, g = ask([x])[0]
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    done = 1
    while done < rounds:
        free = ~((x <= lo) & (g > 0) | (x >= hi) & (g < 0))
        if not free.any() or np.abs(g[free]).max() <= tolerance * max(1.0, abs(value)):
            break
        d = _direction(g, pairs, free)
        if d @ g >= 0:
            pairs, d = [], -np.where(free, g, 0.0)
        if not pairs:
            d = d / max(1.0, np.abs(d).max())  # the first step is at most e-fold in any coordinate
        d = np.clip(d, -3.0, 3.0)
        tries = [np.clip(x + t * d, lo, hi) for t in STEPS]
        got = ask(tries)
        done += 1
        best = min(range(len(tries)), key=lambda k: got[k][0])
        if got[best][0] >= value - 1e-12 * max(1.0, abs(value)):
            if not pairs:
                break
            pairs = []  # once more from the gradient alone
            continue
        pairs = [*pairs[-MEMORY + 1 :], (tries[best] - x, got[best][1] - g)]
        gain, x, (value, g) = value - got[best][0], tries[best], got[best]
        if gain <= tolerance * 1e-3 * max(1.0, abs(value)):
            break
    return np.exp(x), value, done
