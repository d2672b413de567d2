"""Pair hidden Markov models: the probability that two sequences are related, summed over all alignments.

A batch of pairs goes along anti-diagonals together. x is the longer frame of a semiglobal alignment: y may start and
end anywhere in it. ``max_edit`` leaves out cells that no path of so few edits reaches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Stands for the log of 0: sums of several still fit a double, and differences of two are plain numbers.
LOW = -1e300
_BASES = b"ACGT"


def _ln(p: float) -> float:
    return float(np.log(p)) if p > 0 else LOW


def lse(*terms: np.ndarray) -> np.ndarray:
    """Log of the sum of exponentials of arrays, element by element."""
    top = terms[0]
    for x in terms[1:]:
        top = np.maximum(top, x)
    total = np.exp(terms[0] - top)
    for x in terms[1:]:
        total += np.exp(x - top)
    np.log(total, out=total)
    total += top
    return total


def lse_axis(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return np.log(np.exp(a - top).sum(axis)) + top.squeeze(axis)


@dataclass
class PairModel:
    """Probabilities; ``gap_x`` opens a gap in x (a symbol of y alone). Hops lengthen runs of one base (14-state model)."""

    gap_x: float = 2.8e-6
    gap_y: float = 5.1e-6
    gap_x_extend: float = 0.0
    gap_y_extend: float = 0.0
    substitution: float = 0.0021
    semiglobal: bool = True
    hop_x: tuple[float, ...] | float = 0.0
    hop_y: tuple[float, ...] | float = 0.0
    hop_x_extend: tuple[float, ...] | float = 0.0
    hop_y_extend: tuple[float, ...] | float = 0.0

    def per_base(self, name: str) -> list[float]:
        v = getattr(self, name)
        return list(v) if isinstance(v, (tuple, list)) else [v] * 4


def _pad(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(t) for t in texts])
    out = np.zeros((len(texts), int(n.max()) + 1), np.uint8)
    for k, t in enumerate(texts):
        out[k, : len(t)] = np.frombuffer(t.encode("latin-1", "replace"), np.uint8)
    return out, n


class _Edits:
    """Fewest edits by cell, kept for the last two diagonals."""

    def __init__(self, shape, limit: int | None, semiglobal: bool):
        self.limit, self.semi = limit, semiglobal
        self.two = np.full(shape, 1 << 20)
        self.one = np.full(shape, 1 << 20)

    def step(self, d: int, a: int, b: int, i: np.ndarray, j: np.ndarray, same: np.ndarray) -> np.ndarray | None:
        """The cells to leave out of diagonal d, rows a..b."""
        if self.limit is None:
            return None
        up = np.maximum(i - 1, 0)
        corner = np.where((i > 0) & (j > 0), self.two[:, up], 1 << 20)
        near = np.minimum(corner, np.minimum(np.where(i > 0, self.one[:, up], 1 << 20), np.where(j > 0, self.one[:, i], 1 << 20)))
        cost = np.minimum(corner + ~same, np.minimum(np.where(i > 0, self.one[:, up], 1 << 20), np.where(j > 0, self.one[:, i], 1 << 20)) + 1)
        cost = np.where(j == 0, 0 if self.semi else np.where(i == 0, 0, 1 << 20), cost)
        now = np.full_like(self.one, 1 << 20)
        now[:, i] = cost
        self.two, self.one = self.one, now
        return (near > self.limit) & (j > 0)


def pair_probability(xs: list[str], ys: list[str], p: PairModel, max_edit: int | None = None) -> np.ndarray:
    """Log probabilities of the three-state model, at most 0; minus infinity where either sequence is empty."""
    if not xs:
        return np.zeros(0)
    X, m = _pad(xs)
    Y, n = _pad(ys)
    rows, pairs = X.shape[1], len(xs)
    shape = (pairs, rows)
    same, other, alone = _ln(1 - p.substitution), _ln(p.substitution / 3), _ln(1 - p.substitution)
    none, open_x, open_y = _ln(1 - p.gap_x - p.gap_y), _ln(p.gap_x), _ln(p.gap_y)
    more_x, more_y, close_x, close_y = _ln(p.gap_x_extend), _ln(p.gap_y_extend), _ln(1 - p.gap_x_extend), _ln(1 - p.gap_y_extend)
    M2, X2, Y2, M1, X1, Y1 = (np.full(shape, LOW) for _ in range(6))
    total = np.full(pairs, LOW)
    edits = _Edits(shape, max_edit, p.semiglobal)
    big_m, big_n = int(m.max()), int(n.max())
    with np.errstate(invalid="ignore"):
        for d in range(big_m + big_n + 1):
            a, b = max(0, d - big_n), min(big_m, d)
            i = np.arange(a, b + 1)
            j = d - i
            up = np.maximum(i - 1, 0)
            eq = X[:, up] == Y[:, np.maximum(j - 1, 0)]
            inner = (i > 0) & (j > 0)
            mm = np.where(eq, same, other) + lse(none + M2[:, up], close_y + X2[:, up], close_x + Y2[:, up])
            xx = alone + lse(open_y + M1[:, up], more_y + X1[:, up])
            yy = alone + lse(open_x + M1[:, i], more_x + Y1[:, i])
            start = np.where(j == 0, np.where(i == 0, _ln(2.0) if p.semiglobal else 0.0, 0.0 if p.semiglobal else LOW), LOW)
            mm = np.where(inner, mm, start)
            xx, yy = np.where(inner, xx, LOW), np.where(inner, yy, LOW)
            out = edits.step(d, a, b, i, j, eq)
            if out is not None:
                mm, xx, yy = np.where(out, LOW, mm), np.where(out, LOW, xx), np.where(out, LOW, yy)
            M0, X0, Y0 = (np.full(shape, LOW) for _ in range(3))
            M0[:, i], X0[:, i], Y0[:, i] = mm, xx, yy
            here = lse(mm, xx, yy)
            at_end = (j == n[:, None]) & (i > 0) & ((i <= m[:, None]) if p.semiglobal else (i == m[:, None]))
            total = lse(total, lse_axis(np.where(at_end, here, LOW), 1))
            M2, X2, Y2, M1, X1, Y1 = M1, X1, Y1, M0, X0, Y0
    total[(m == 0) | (n == 0) | (total < LOW / 1e6)] = -np.inf
    return np.minimum(total, 0.0)


#: Cells of the 14-state model are plain probabilities times a power of 2 ** -STEP of their own; by how many steps lower a neighbour is, its factor.
STEP = 256
_LOWER = np.array([1.0, 2.0**-STEP, 2.0 ** (-2 * STEP), 2.0 ** (-3 * STEP), 0.0])
#: The power of a cell that nothing leads to.
_NOWHERE = -(1 << 29)


def homopolymer_probability(xs: list[str], ys: list[str], p: PairModel, max_edit: int | None = None) -> np.ndarray:
    """The same for 14 states: a match state for each base, gaps in x and y, and hops in x and y for each base.

    A mismatch is emitted by the match states of both its bases, each with half its probability. Hops lead back to
    every match state, the chance of any hop is the mean over the bases, and the end is summed once.

    Match states of a cell that can emit it have one probability, and bases whose hops have the same chances one sum of
    hops. What a cell sends on is worked out once: to the match states, to gaps and to hops.
    """
    if not xs:
        return np.zeros(0)
    X, m = _pad(xs)
    Y, n = _pad(ys)
    rows, pairs = X.shape[1], len(xs)
    chances = list(zip(*(p.per_base(k) for k in ("hop_x", "hop_y", "hop_x_extend", "hop_y_extend"))))
    kinds = sorted(set(chances))
    stay = max(0.0, 1 - p.gap_x - p.gap_y - sum(c[0] + c[1] for c in chances) / 4)
    alone, close_x, close_y = 1 - p.substitution, 1 - p.gap_x_extend, 1 - p.gap_y_extend
    size = [chances.count(k) for k in kinds]
    weight = np.zeros((len(kinds), 25))  # by 5 * base of x + base of y, 4 being no base
    for a in range(5):
        for b in range(5):
            for k in {a, b} - {4}:
                weight[kinds.index(chances[k]), 5 * a + b] += 1 - p.substitution if a == b else p.substitution / 6
    code = np.full(256, 4, np.uint8)
    code[list(_BASES)] = range(4)
    first, second = np.ascontiguousarray(5 * code[X.T]), np.ascontiguousarray(code[Y.T][::-1])
    count, big_m, big_n = 2 + 2 * len(kinds), int(m.max()), int(n.max())
    edits = _Edits((pairs, rows), max_edit, p.semiglobal)
    total, column = np.full(pairs, -np.inf), np.arange(pairs)
    match2, match1, match0 = (np.zeros((rows, pairs)) for _ in range(3))
    power2, power1, power0 = (np.full((rows, pairs), _NOWHERE, np.int32) for _ in range(3))
    one, now = (np.zeros((count, rows, pairs)) for _ in range(2))  # to gaps in x and y, and by kind to hops in x and y

    def send(at, cells, gaps, hops) -> None:
        every = sum(cells[1:], cells[0])
        match0[at] = stay * every + close_x * gaps[0] + close_y * gaps[1] + sum((1 - k[z]) * hops[z][g] for g, k in enumerate(kinds) for z in (0, 1))
        for z, opened, more in ((0, p.gap_x, p.gap_x_extend), (1, p.gap_y, p.gap_y_extend)):
            now[z, at] = alone * opened * every
            if more:
                now[z, at] += alone * more * gaps[z]
        for g, k in enumerate(kinds):
            for z in (0, 1):
                now[2 + 2 * g + z, at] = k[z] * cells[g]
                if k[2 + z]:
                    now[2 + 2 * g + z, at] += k[2 + z] * hops[z][g]

    for d in range(big_m + big_n + 1):
        power0[0], match0[0], now[:, 0] = _NOWHERE, 0, 0
        if d <= big_m:
            begin = (0.5 if d == 0 else 0.25) if p.semiglobal else 0.25 * (d == 0)
            power0[d] = 0 if begin else _NOWHERE
            send(d, [np.full(pairs, begin * k) for k in size], (0, 0), ([0] * len(kinds),) * 2)
        out = None
        if max_edit is not None:
            i = np.arange(max(0, d - big_n), min(big_m, d) + 1)
            out = edits.step(d, i[0], i[-1], i, d - i, X[:, np.maximum(i - 1, 0)] == Y[:, np.maximum(d - i - 1, 0)])[:, i > 0].T
        lo, hi = max(1, d - big_n), min(big_m, d - 1)
        if lo <= hi:
            here, left = slice(lo, hi + 1), slice(lo - 1, hi)
            power = np.maximum(np.maximum(power2[left], power1[here]), power1[left])
            corner, up, side = (_LOWER.take(np.minimum(power - q, 4)) for q in (power2[left], power1[here], power1[left]))
            corner *= match2[left]
            if out is not None:
                for x in (corner, up, side):
                    x[out[: hi - lo + 1]] = 0
            symbols = first[left] + second[len(second) - d + lo : len(second) - d + hi + 1]
            cells = [w.take(symbols) * corner for w in weight]
            gaps = [one[0, here] * up, one[1, left] * side]
            hops = [one[2 + 2 * g, here] * up for g in range(len(kinds))], [one[3 + 2 * g, left] * side for g in range(len(kinds))]
            states = [*cells, *gaps, *hops[0], *hops[1]]
            sums = sum(states[1:], states[0].copy())
            for low, factor, way in ((True, 2.0**STEP, -1), (False, 2.0**-STEP, 1)):
                k = np.flatnonzero(sums < 2.0**-STEP if low else sums > 2.0**STEP)
                if low and len(k):
                    power.reshape(-1)[k[sums.reshape(-1)[k] == 0]] = _NOWHERE
                    k = k[sums.reshape(-1)[k] > 0]
                while len(k):
                    for x in (*states, sums):
                        x.reshape(-1)[k] *= factor
                    power.reshape(-1)[k] += way
                    k = k[sums.reshape(-1)[k] < 2.0**-STEP if low else sums.reshape(-1)[k] > 2.0**STEP]
            power0[here] = power
            send(here, cells, gaps, hops)
            i = d - n
            ends = column[(i > 0) & (i <= m) & (n > 0) if p.semiglobal else (i == m) & (i > 0) & (n > 0)]
            at = i[ends] - lo
            with np.errstate(divide="ignore"):
                total[ends] = np.logaddexp(total[ends], np.log(sums[at, ends]) + power[at, ends] * (STEP * np.log(2)))
        match2, match1, match0 = match1, match0, match2
        power2, power1, power0 = power1, power0, power2
        one, now = now, one
    total[(m == 0) | (n == 0)] = -np.inf
    return np.minimum(total, 0.0)
