"""Approximate search: all places where a pattern ends within k edits, with starts and paths where asked for.

Patterns are bit vectors of Python integers, so they may be of any length.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np


@dataclass
class Pattern:
    """A pattern with symbols that match others (besides themselves) and text symbols that match anything."""

    text: str
    equal: dict[str, str] = field(default_factory=dict)
    wildcards: str = ""

    def __post_init__(self):
        if not self.text:
            raise ValueError("the pattern must not be empty")
        self.masks: dict[str, int] = {}
        for i, c in enumerate(self.text):
            for s in {c, *self.equal.get(c, "")}:
                self.masks[s] = self.masks.get(s, 0) | 1 << i
        for s in self.wildcards:
            self.masks[s] = (1 << len(self.text)) - 1

    def matches(self, i: int, c: str) -> bool:
        return bool(self.masks.get(c, 0) >> i & 1)


def find_all_end(p: Pattern, text: str, k: int) -> list[tuple[int, int]]:
    """(end, distance): every end (the last symbol's place) with a distance of at most k."""
    m = len(p.text)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, dist, out, get = full, 0, m, [], p.masks.get
    for i, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & top:
            dist += 1
        elif mh & top:
            dist -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if dist <= k:
            out.append((i, dist))
    return out


#: Cells of the table of symbols that a batch holds, and texts below which a batch is not worth its while.
CELLS, FEW = 2_000_000, 16


def ends_batch(p: Pattern, texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, end, distance) of all ends in all texts, by text and end: a batch of texts goes along together, one word each.

    Patterns above 63 symbols, and a few long texts, go one by one.
    """
    m = len(p.text)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    groups: list[list[int]] = []
    for i in order:
        if not groups or (len(groups[-1]) + 1) * len(texts[i]) > CELLS or len(texts[i]) > 2 * len(texts[groups[-1][0]]) + 64:
            groups.append([])
        groups[-1].append(i)
    for g in groups:
        if m > 63 or len(g) < FEW:
            for i in g:
                hits = np.array(find_all_end(p, texts[i], k), np.int64).reshape(-1, 2)
                found.append((np.full(len(hits), i), hits[:, 0], hits[:, 1]))
            continue
        size = np.array([len(texts[i]) for i in g])
        raw = np.frombuffer("".join(texts[i] for i in g).encode("utf-32-le"), np.uint32)
        symbols, code = np.unique(raw, return_inverse=True)
        mask = np.array([p.masks.get(chr(c), 0) for c in symbols], np.uint64)
        eqs = np.zeros((int(size.max()), len(g)), np.uint64)
        row = np.repeat(np.arange(len(g)), size)
        eqs[np.arange(len(raw)) - np.repeat(np.cumsum(size) - size, size), row] = mask[code] if len(raw) else 0
        full, top, one = np.uint64((1 << m) - 1), np.uint64(1 << (m - 1)), np.uint64(1)
        pv, mv, dist = np.full(len(g), full), np.zeros(len(g), np.uint64), np.full(len(g), m)
        at = np.array(g)
        for j, eq in enumerate(eqs):
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv) & full, pv & xh
            dist = dist + ((ph & top) != 0) - ((mh & top) != 0)
            ph, mh = ph << one & full, mh << one & full
            pv, mv = mh | ~(xv | ph) & full, ph & xv
            hit = np.flatnonzero((dist <= k) & (j < size))
            if len(hit):
                found.append((at[hit], np.full(len(hit), j), dist[hit]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    text, end, dist = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((end, text))
    return text[order], end[order], dist[order]


def distance(p: Pattern, text: str) -> int | None:
    """The least distance of the pattern to any part of the text; None for an empty text."""
    ends = find_all_end(p, text, len(p.text))
    return min((d for _, d in ends), default=None)


def find_best_end(p: Pattern, text: str) -> tuple[int, int] | None:
    """(end, distance) of the least distance, the first of ties."""
    ends = find_all_end(p, text, len(p.text))
    return min(ends, key=lambda e: (e[1], e[0])) if ends else None


def path_at(p: Pattern, text: str, end: int, dist: int) -> tuple[int, str]:
    """(start, operations) of the match that ends with a symbol: of equal ways a substitution goes before an insertion (pattern alone), this before a deletion (text alone), this before a match."""
    m = len(p.text)
    lo = max(0, end + 1 - m - dist)
    part = text[lo : end + 1]
    rows = np.zeros((m + 1, len(part) + 1), np.int64)
    rows[:, 0] = np.arange(m + 1)
    same = np.array([[not p.matches(i, c) for c in part] for i in range(m)], np.int64).reshape(m, len(part))
    for j in range(1, len(part) + 1):
        col = np.minimum(rows[:-1, j - 1] + same[:, j - 1], rows[1:, j - 1] + 1)
        run = np.minimum.accumulate(np.concatenate(([0], col)) - np.arange(m + 1)) + np.arange(m + 1)
        rows[:, j] = run
    i, j, ops = m, len(part), []
    while i > 0:
        d = rows[i, j]
        if j > 0 and rows[i - 1, j - 1] + 1 == d and same[i - 1, j - 1]:
            ops.append("S")
            i, j = i - 1, j - 1
        elif rows[i - 1, j] + 1 == d:
            ops.append("I")
            i -= 1
        elif j > 0 and rows[i, j - 1] + 1 == d:
            ops.append("D")
            j -= 1
        else:
            ops.append("M")
            i, j = i - 1, j - 1
    return lo + j, "".join(reversed(ops))


def find_all(p: Pattern, text: str, k: int) -> list[tuple[int, int, int, str]]:
    """(start, end, distance, operations) of every match; the end is exclusive."""
    out = []
    for e, d in find_all_end(p, text, k):
        start, ops = path_at(p, text, e, d)
        out.append((start, e + 1, d, ops))
    return out


def ukkonen(pattern: str, text: str, k: int, cost: Callable[[str, str], int] = lambda a, b: int(a != b)) -> list[tuple[int, int]]:
    """(end, distance) with a substitution cost of one's own and 1 for each insertion and deletion.

    Only rows above the last one within k are computed.
    """
    m = len(pattern)
    col, last, out = list(range(m + 1)), min(k, m), []
    for j, c in enumerate(text):
        prev, top = col[0], min(last + 1, m)
        for i in range(1, top + 1):
            keep = col[i]
            below = keep if i <= last else k + 1
            col[i] = min(prev + cost(pattern[i - 1], c), below + 1, col[i - 1] + 1)
            prev = keep
        last = top
        while last > 0 and col[last] > k:
            last -= 1
        if last == m:
            out.append((j, col[m]))
    return out
