"""Integrals of log densities on a grid that is dense where the density is."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def trapezoid(points: np.ndarray, values: np.ndarray) -> float:
    """ln of the integral over sorted points of log values."""
    if len(points) < 2:
        return float("-inf")
    with np.errstate(divide="ignore"):
        area = np.logaddexp(values[1:], values[:-1]) + np.log(np.diff(points) / 2)
    return float(np.logaddexp.reduce(area))


def adaptive(density: Callable[[float], float], lo: float, hi: float, resolution: float) -> float:
    """ln of the integral of exp(density) over lo..hi, for a density with one mode.

    The mode is searched by halving, with all points on the way kept; further points go in around it, ever wider apart,
    and the trapezoid rule sums over the grid that results. ``resolution`` is the least distance of two points.
    """
    if not lo <= hi or resolution <= 0:
        raise ValueError("the interval must be in order and the resolution positive")
    seen: dict[float, float] = {}

    def at(x: float) -> float:
        if x not in seen:
            seen[x] = float(density(x))
        return seen[x]

    a, b = lo, hi
    at(a)
    at(b)
    while b - a > resolution:
        mid, step = (a + b) / 2, min(resolution, (b - a) / 4)
        left, right = at(mid - step / 2), at(mid + step / 2)
        if left > right:
            b = mid
        elif right > left:
            a = mid
        elif left == float("-inf"):  # flat at nothing: look where there is something
            spots = [(at(x), x) for x in np.linspace(a, b, 33)]
            top, x = max(spots)
            if top == float("-inf"):
                break
            w = (b - a) / 32
            a, b = max(a, x - w), min(b, x + w)
        else:
            a, b = mid - step / 2, mid + step / 2
            break
    mode = max(seen, key=lambda x: seen[x])
    width = resolution
    while width < hi - lo:
        for x in np.linspace(max(lo, mode - width), min(hi, mode + width), 33):
            at(float(x))
        width *= 2
    for x in np.linspace(lo, hi, 65):
        at(float(x))
    points = np.array(sorted(seen))
    return trapezoid(points, np.array([seen[x] for x in points]))

