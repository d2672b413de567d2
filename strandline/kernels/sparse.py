"""Sparse seeds of a pair of sequences: k-mer matches and their best chains."""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from dataclasses import dataclass


@dataclass
class Chain:
    path: list[int]
    score: int
    scores: list[int]


def find_kmer_matches(x: str, y: str, k: int) -> list[tuple[int, int]]:
    """All (i, j) with x[i:i+k] == y[j:j+k], sorted; the shorter sequence is indexed."""
    if len(x) > len(y):
        return sorted((j, i) for i, j in find_kmer_matches(y, x, k))
    index = defaultdict(list)
    for i in range(len(x) - k + 1):
        index[x[i : i + k]].append(i)
    return sorted((i, j) for j in range(len(y) - k + 1) for i in index.get(y[j : j + k], ()))


def expand_matches(x: str, y: str, k: int, matches: list[tuple[int, int]], mismatches: int) -> list[tuple[int, int]]:
    """The matches with those diagonal neighbours that hold at most ``mismatches`` mismatches on the way, to the left and
    to the right, stopping at the next match of the diagonal. Every added place still begins k symbols of either text."""
    seen = set(matches)
    out = set(matches)
    for i, j in matches:
        left, a, b = mismatches, i - 1, j - 1
        while a >= 0 and b >= 0 and (a, b) not in seen:
            left -= x[a] != y[b]
            if left < 0:
                break
            out.add((a, b))
            a, b = a - 1, b - 1
        left, a, b = mismatches, i + 1, j + 1
        while a + k <= len(x) and b + k <= len(y) and (a, b) not in seen:
            left -= x[a + k - 1] != y[b + k - 1]
            if left < 0:
                break
            out.add((a, b))
            a, b = a + 1, b + 1
    return sorted(out)


class PrefixMax:
    """Fenwick tree of maxima over positions."""

    def __init__(self, size: int):
        self.tree = [(float("-inf"), -1)] * (size + 1)

    def put(self, at: int, value: tuple[float, int]) -> None:
        at += 1
        while at < len(self.tree):
            if value > self.tree[at]:
                self.tree[at] = value
            at += at & -at

    def get(self, at: int) -> tuple[float, int]:
        best = (float("-inf"), -1)
        at += 1
        while at > 0:
            if self.tree[at] > best:
                best = self.tree[at]
            at -= at & -at
        return best


def _chain(matches: list[tuple[int, int]], k: int, match: int, gap_open: int, gap_extend: int, gaps: bool) -> Chain:
    """Chains where the next match begins after the last one ends, or goes on along its diagonal by one symbol."""
    if any(a > b for a, b in zip(matches, matches[1:])):
        raise ValueError("matches must be sorted")
    n = len(matches)
    score, prev = [0] * n, [-1] * n
    ends = sorted({y + k for _, y in matches})
    tree = PrefixMax(len(ends))
    place = {m: i for i, m in enumerate(matches)}
    pending = sorted(range(n), key=lambda i: matches[i][0] + k)  # by the place in x where they end
    done = 0
    for i, (x, y) in enumerate(matches):
        while done < n and matches[pending[done]][0] + k <= x:
            p = pending[done]
            ex, ey = matches[p][0] + k, matches[p][1] + k
            plane = score[p] - gap_extend * (ex + ey) if gaps else score[p]
            tree.put(bisect_left(ends, ey), (plane, -p))
            done += 1
        score[i] = k * match
        at = bisect_left(ends, y + 1) - 1
        best, p = tree.get(at) if at >= 0 else (float("-inf"), 1)
        if p <= 0 and best > float("-inf"):
            p = -p
            ex, ey = matches[p][0] + k, matches[p][1] + k
            gap = max(x - ex, y - ey)
            cost = (gap_open + gap_extend * gap if gap else 0) if gaps else 0
            score[i], prev[i] = max((score[i], prev[i]), (max(0, score[p] + cost + k * match), p))
        q = place.get((x - 1, y - 1))
        if q is not None:
            score[i], prev[i] = max((score[i], prev[i]), (score[q] + match, q))
    if not n:
        return Chain([], 0, [])
    at = max(range(n), key=lambda i: (score[i], -i))
    path, total = [], score[at]
    while at >= 0:
        path.append(at)
        at = prev[at]
    return Chain(path[::-1], int(total), score)


def lcskpp(matches: list[tuple[int, int]], k: int) -> Chain:
    """The chain that covers most symbols."""
    return _chain(matches, k, 1, 0, 0, False)


def sdpkpp(matches: list[tuple[int, int]], k: int, match: int, gap_open: int, gap_extend: int) -> Chain:
    """The chain of the best score; a gap between matches costs ``gap_open`` and ``gap_extend`` for each symbol skipped
    in that sequence which skips more. The match before a gap is the one that is best if both sequences' skips counted."""
    if match <= 0 or gap_open > 0 or gap_extend > 0:
        raise ValueError("matches must score above 0 and gaps not above 0")
    return _chain(matches, k, match, gap_open, gap_extend, True)


def union_path(matches: list[tuple[int, int]], k: int, match: int, gap_open: int, gap_extend: int) -> list[int]:
    """The chain with gap costs, led on by the covering chain: by what that has before the first and behind the last match
    of the former. Where the two share no such match, all of the covering chain is led on behind, and nothing before."""
    core, cover = sdpkpp(matches, k, match, gap_open, gap_extend).path, lcskpp(matches, k).path
    if not core:
        return cover
    place = {m: i for i, m in enumerate(cover)}
    return cover[: place.get(core[0], 0)] + core + cover[place.get(core[-1], len(cover)) + 1 :]
