"""Affine-gap pairwise alignment, a batch of pairs at a time along anti-diagonals.

A gap of k symbols costs ``gap_open + gap_extend * (k - 1)``. Clipping a prefix or suffix of x or y costs a fixed
penalty; with the default, minus infinity, it is not allowed. At equal scores a cell prefers match or substitution,
then insertion (a symbol of x alone), then deletion (a symbol of y alone), then a clipped start.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np

MIN_SCORE = -858_993_459
#: Cells of a band beyond which a pair is not aligned, and of a matrix that may be held whole.
MAX_CELLS, SMALL = 5_000_000, 500_000


@dataclass
class Scoring:
    gap_open: int
    gap_extend: int
    table: np.ndarray  # 256 x 256
    xclip_prefix: int = MIN_SCORE
    xclip_suffix: int = MIN_SCORE
    yclip_prefix: int = MIN_SCORE
    yclip_suffix: int = MIN_SCORE

    def __post_init__(self):
        if self.gap_open > 0 or self.gap_extend > 0:
            raise ValueError("gap scores must not be positive")
        for c in (self.xclip_prefix, self.xclip_suffix, self.yclip_prefix, self.yclip_suffix):
            if c > 0:
                raise ValueError("clip penalties must not be positive")

    @classmethod
    def from_scores(cls, gap_open: int, gap_extend: int, match: int, mismatch: int) -> Scoring:
        if match < 0 or mismatch > 0:
            raise ValueError("a match must not score below 0, nor a mismatch above")
        table = np.full((256, 256), mismatch, np.int64)
        np.fill_diagonal(table, match)
        return cls(gap_open, gap_extend, table)

    @classmethod
    def from_function(cls, gap_open: int, gap_extend: int, score: Callable[[int, int], int]) -> Scoring:
        return cls(gap_open, gap_extend, np.array([[score(a, b) for b in range(256)] for a in range(256)], np.int64))

    def plain(self) -> tuple[int, int] | None:
        """(match, mismatch) where these are all that the table says."""
        same, other = int(self.table[0, 0]), int(self.table[0, 1])
        return (same, other) if (self.table == np.where(np.eye(256, dtype=bool), same, other)).all() else None

    def xclip(self, p: int) -> Scoring:
        return replace(self, xclip_prefix=p, xclip_suffix=p)

    def yclip(self, p: int) -> Scoring:
        return replace(self, yclip_prefix=p, yclip_suffix=p)

    def with_mode(self, mode: str) -> Scoring:
        if mode == "custom":
            return self
        if mode == "global":
            return self.xclip(MIN_SCORE).yclip(MIN_SCORE)
        if mode == "semiglobal":
            return self.xclip(MIN_SCORE).yclip(0)
        if mode == "local":
            return self.xclip(0).yclip(0)
        raise ValueError(f"no such mode: {mode}")


@dataclass
class Alignment:
    score: int
    xstart: int
    xend: int
    ystart: int
    yend: int
    xlen: int
    ylen: int
    ops: str  # M match, S substitution, I insertion, D deletion
    mode: str

    def clipped(self) -> list[tuple[str, int]]:
        """Runs of operations with the clips that a custom alignment has: Y before X at either end."""
        runs = [("Y", self.ystart), ("X", self.xstart)]
        for c in self.ops:
            if runs[-1][0] == c:
                runs[-1] = (c, runs[-1][1] + 1)
            else:
                runs.append((c, 1))
        runs += [("X", self.xlen - self.xend), ("Y", self.ylen - self.yend)]
        return [r for r in runs if r[1]]

    def pretty(self, x: str, y: str, width: int = 80) -> str:
        """Three lines a block: x, the operations, y."""
        a, mid, b, i, j = [], [], [], self.xstart, self.ystart
        for c in self.ops:
            a.append("-" if c == "D" else x[i])
            b.append("-" if c == "I" else y[j])
            mid.append({"M": "|", "S": "\\", "I": "+", "D": "x"}[c])
            i += c != "D"
            j += c != "I"
        rows = ["".join(r) for r in (a, mid, b)]
        return "\n\n".join("\n".join(r[k : k + width] for r in rows) for k in range(0, max(1, len(mid)), width))


def encode(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("latin-1", "replace"), np.uint8)


def align_batch(xs: list[str], ys: list[str], scoring: Scoring, mode: str = "custom", bands: list[tuple[np.ndarray, np.ndarray]] | None = None) -> list[Alignment]:
    """Best alignments of pairs, all cells being held. ``bands`` gives for each pair the first and last row i of every anti-diagonal i + j that count."""
    sc = scoring.with_mode(mode)
    n_pairs = len(xs)
    if not n_pairs:
        return []
    m, n = np.array([len(x) for x in xs]), np.array([len(y) for y in ys])
    big_m, big_n = int(m.max()), int(n.max())
    X, Y = np.zeros((n_pairs, big_m + 1), np.uint8), np.zeros((n_pairs, big_n + 1), np.uint8)
    for k, (x, y) in enumerate(zip(xs, ys)):
        X[k, : len(x)], Y[k, : len(y)] = encode(x), encode(y)
    low = -500_000_000
    shape = (n_pairs, big_m + 1)
    s1, s2, ins, dele = (np.full(shape, low, np.int32) for _ in range(4))
    trace = np.zeros((big_m + big_n + 1, n_pairs, big_m + 1), np.uint8)
    weight = (big_n + 2) * (big_m + 1)
    best, at = np.full(n_pairs, 4 * low * weight, np.int64), np.zeros((2, n_pairs), np.int64)
    go, ge = sc.gap_open, sc.gap_extend
    plain = sc.plain()
    back = np.ascontiguousarray(Y[:, :big_n][:, ::-1])  # along a diagonal j falls as i rises
    x_begin, y_begin = max(sc.xclip_prefix, low), max(sc.yclip_prefix, low)
    begin = x_begin + y_begin
    bound = None
    if bands is not None:
        bound = np.zeros((2, big_m + big_n + 1, n_pairs), np.int64)
        bound[0], bound[1] = big_m + 1, -1
        for k, (lo, hi) in enumerate(bands):
            bound[0, : len(lo), k], bound[1, : len(hi), k] = lo, hi
    for d in range(big_m + big_n + 1):
        a, b = max(0, d - big_n), min(big_m, d)
        if bound is not None:
            a, b = max(a, int(bound[0, d].min())), min(b, int(bound[1, d].max()))
        s0, i0, d0 = (np.full(shape, low, np.int32) for _ in range(3))
        first, last = max(a, 1), min(b, d - 1)
        if first <= last:  # i and j above 0
            here, up = slice(first, last + 1), slice(first - 1, last)
            x, y = X[:, up], back[:, big_n - d + first : big_n - d + last + 1]
            score = s2[:, up] + (np.where(x == y, *plain) if plain else sc.table[x, y]).astype(np.int32)
            ext, opn = ins[:, up] + ge, s1[:, up] + go
            code = (ext > opn).view(np.uint8) << 2
            iv = np.maximum(ext, opn)
            ext, opn = dele[:, here] + ge, s1[:, here] + go
            code |= (ext > opn).view(np.uint8) << 3
            dv = np.maximum(ext, opn)
            kind = (iv > score).view(np.uint8) + np.uint8(1)
            np.maximum(score, iv, out=score)
            kind[dv > score] = 3
            np.maximum(score, dv, out=score)
            if begin > low:
                kind[begin > score] = 0
                np.maximum(score, begin, out=score)
            s0[:, here], i0[:, here], d0[:, here], trace[d, :, here] = score, iv, dv, code | kind
        if a == 0 and d == 0:
            s0[:, 0] = 0
        elif a == 0:  # i = 0
            ext, opn = dele[:, 0] + ge, s1[:, 0] + go
            d0[:, 0] = np.maximum(ext, opn)
            s0[:, 0] = np.maximum(d0[:, 0], y_begin)
            trace[d, :, 0] = np.where(y_begin > d0[:, 0], 0, 3) + np.where(ext > opn, 8, 0)
        if b == d and d > 0:  # j = 0
            ext, opn = ins[:, d - 1] + ge, s1[:, d - 1] + go
            i0[:, d] = np.maximum(ext, opn)
            s0[:, d] = np.maximum(i0[:, d], x_begin)
            trace[d, :, d] = np.where(x_begin > i0[:, d], 0, 2) + np.where(ext > opn, 4, 0)
        if a > b:
            s2, s1, ins, dele = s1, s0, i0, d0
            continue
        if bound is not None:
            i = np.arange(a, b + 1)
            out = (i < bound[0, d][:, None]) | (i > bound[1, d][:, None])
            for cells in (s0, i0, d0):
                cells[:, a : b + 1][out] = low
        if sc.xclip_suffix <= low:  # only all of x may be aligned
            r = np.flatnonzero((m >= a) & (m <= b) & (d - m <= n))
            i = m[r]
        else:
            r, i = slice(None), np.arange(a, b + 1)
        j = d - i
        if isinstance(r, slice):
            end = s0[:, a : b + 1].astype(np.int64) + np.where(i == m[:, None], 0, max(sc.xclip_suffix, low)) + np.where(j == n[:, None], 0, max(sc.yclip_suffix, low))
            end = np.where((i <= m[:, None]) & (j <= n[:, None]), end, 4 * low)
            key = end * weight + np.where(j == n[:, None], big_n + 1, big_n - j) * (big_m + 1) + (big_m - i)
            k = key.argmax(1)
            top, i, r = key[np.arange(n_pairs), k], i[k], np.arange(n_pairs)
        else:
            top = (s0[r, i].astype(np.int64) + np.where(j == n[r], 0, max(sc.yclip_suffix, low))) * weight + np.where(j == n[r], big_n + 1, big_n - j) * (big_m + 1) + (big_m - i)
        new = top > best[r]
        r, i = r[new], i[new]
        best[r], at[0, r], at[1, r] = top[new], i, d - i
        s2, s1, ins, dele = s1, s0, i0, d0
    return [_trace(trace[:, k], None, X[k], Y[k], int(at[0, k]), int(at[1, k]), int(best[k] // weight), int(m[k]), int(n[k]), mode) for k in range(n_pairs)]


def _align_bands(xs: list[str], ys: list[str], scoring: Scoring, mode: str, bands: list[tuple[np.ndarray, np.ndarray]]) -> list[Alignment]:
    """The same within bands, that give for each pair the first and last row i of every anti-diagonal i + j.

    Only cells of bands are held: a column stands for a row counted from the band's first one on the diagonal.
    """
    sc = scoring.with_mode(mode)
    pairs = len(xs)
    if not pairs:
        return []
    m, n = np.array([len(x) for x in xs]), np.array([len(y) for y in ys])
    big_m, big_n = int(m.max()), int(n.max())
    X, Y = np.zeros((pairs, big_m + 1), np.uint8), np.zeros((pairs, big_n + 1), np.uint8)
    for k, (x, y) in enumerate(zip(xs, ys)):
        X[k, : len(x)], Y[k, : len(y)] = encode(x), encode(y)
    diagonals = int((m + n).max()) + 1
    lo, hi = np.zeros((diagonals, pairs), np.int64), np.full((diagonals, pairs), -1, np.int64)
    for k, (a, b) in enumerate(bands):
        lo[: len(a), k], hi[: len(b), k] = a, b
    width = max(int((hi - lo).max()) + 1, 1)
    low = np.int64(-(10**12))
    c, r = np.arange(width)[None, :], np.arange(pairs)[:, None]
    s1, s2, ins, dele = (np.full((pairs, width), low) for _ in range(4))
    trace = np.zeros((diagonals, pairs, width), np.uint8)
    weight = (big_n + 2) * (big_m + 1)
    best, at = np.full(pairs, low * 2 * weight), np.zeros((2, pairs), np.int64)
    M, N = m[:, None], n[:, None]

    def before(cells: np.ndarray, d: int, back: int, up: int) -> np.ndarray:
        """The cells of the diagonal ``back`` before d, at ``up`` rows less."""
        if d < back:
            return np.full((pairs, width), low)
        k = c + (lo[d] - lo[d - back] - up)[:, None]
        return np.where((k >= 0) & (k < width), cells[r, np.clip(k, 0, width - 1)], low)

    for d in range(diagonals):
        i = lo[d][:, None] + c
        j = d - i
        inside = (i <= hi[d][:, None]) & (i <= M) & (j <= N) & (j >= 0)
        above, left = i > 0, j > 0
        score = np.where(above & left, before(s2, d, 2, 1) + sc.table[X[r, np.clip(i - 1, 0, big_m)], Y[r, np.clip(j - 1, 0, big_n)]], low)
        code = np.ones(score.shape, np.uint8)
        ext, opn = before(ins, d, 1, 1) + sc.gap_extend, before(s1, d, 1, 1) + sc.gap_open
        iv = np.where(above, np.maximum(ext, opn), low)
        code |= np.where(ext > opn, 4, 0).astype(np.uint8)
        ext, opn = before(dele, d, 1, 0) + sc.gap_extend, before(s1, d, 1, 0) + sc.gap_open
        dv = np.where(left, np.maximum(ext, opn), low)
        code |= np.where(ext > opn, 8, 0).astype(np.uint8)
        for k, other in ((2, iv), (3, dv), (0, np.where(above, sc.xclip_prefix, 0) + np.where(left, sc.yclip_prefix, 0))):
            better = other > score
            score = np.where(better, other, score)
            code = np.where(better, (code & 12) | k, code).astype(np.uint8)
        score, iv, dv = np.where(inside, score, low), np.where(inside, iv, low), np.where(inside, dv, low)
        trace[d] = code
        end = np.where(inside, score + np.where(i == M, 0, sc.xclip_suffix) + np.where(j == N, 0, sc.yclip_suffix), 2 * low)
        key = np.maximum(end, 2 * low) * weight + np.where(j == N, big_n + 1, big_n - j) * (big_m + 1) + (big_m - i)
        k = key.argmax(1)
        top = key[np.arange(pairs), k]
        new = top > best
        best = np.where(new, top, best)
        at[0] = np.where(new, i[np.arange(pairs), k], at[0])
        at[1] = np.where(new, j[np.arange(pairs), k], at[1])
        s2, s1, ins, dele = s1, score, iv, dv
    return [_trace(trace[:, k], lo[:, k], X[k], Y[k], int(at[0, k]), int(at[1, k]), int(best[k] // weight), int(m[k]), int(n[k]), mode) for k in range(pairs)]


def _trace(codes: np.ndarray, base: np.ndarray | None, x: np.ndarray, y: np.ndarray, i: int, j: int, score: int, m: int, n: int, mode: str) -> Alignment:
    xend, yend, ops, layer = i, j, [], 0
    while True:
        code = int(codes[i + j, i if base is None else i - base[i + j]])
        if layer == 0:
            layer = code & 3
            if layer == 0:
                break
            if layer == 1:
                i, j = i - 1, j - 1
                ops.append("M" if x[i] == y[j] else "S")
                layer = 0
        elif layer == 2:
            ops.append("I")
            layer = 2 if code & 4 else 0
            i -= 1
        else:
            ops.append("D")
            layer = 3 if code & 8 else 0
            j -= 1
    return Alignment(score, i, xend, j, yend, m, n, "".join(reversed(ops)), mode)


def align(x: str, y: str, scoring: Scoring, mode: str = "custom") -> Alignment:
    return align_batch([x], [y], scoring, mode)[0]


def band_around(path: list[tuple[int, int]], m: int, n: int, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last row of each anti-diagonal within ``w`` of a chain of k-mer matches; without one the whole matrix.

    The chain is joined from corner to corner by straight lines; every point of it lets cells within w rows in.
    """
    d = np.arange(m + n + 1)
    full = np.maximum(0, d - n), np.minimum(m, d)
    if not path:
        return full
    pts = [(0, 0)]
    for x, y in path:
        pts += [(x, y), (x + k, y + k)]
    pts.append((m, n))
    mid = np.zeros(m + n + 1)
    lo_, hi_ = np.full(m + n + 1, m + 1.0), np.full(m + n + 1, -1.0)
    for (x0, y0), (x1, y1) in zip(pts, pts[1:]):
        a, b = x0 + y0, x1 + y1
        if b < a:
            continue
        t = np.linspace(0, 1, b - a + 1) if b > a else np.zeros(1)
        mid = x0 + t * (x1 - x0)
        lo_[a : b + 1], hi_[a : b + 1] = np.minimum(lo_[a : b + 1], mid), np.maximum(hi_[a : b + 1], mid)
        # a jump off the diagonal may be taken at either end of it
        wide = abs((x1 - y1) - (x0 - y0))
        lo_[a : b + 1] -= wide
        hi_[a : b + 1] += wide
    lo = np.maximum(full[0], np.floor(lo_).astype(int) - w)
    hi = np.minimum(full[1], np.ceil(hi_).astype(int) + w)
    # at the ends of y anything may be clipped: a semiglobal start lies anywhere on the first row
    x0, y0 = path[0]
    lo[: x0 + y0 + 1] = np.minimum(lo[: x0 + y0 + 1], full[0][: x0 + y0 + 1])
    x1, y1 = path[-1][0] + k, path[-1][1] + k
    lo[x1 + y1 :] = np.minimum(lo[x1 + y1 :], np.maximum(full[0][x1 + y1 :], x1 - w))
    hi[x1 + y1 :] = np.maximum(hi[x1 + y1 :], full[1][x1 + y1 :])
    return lo, hi


def align_banded(xs: list[str], ys: list[str], scoring: Scoring, k: int, w: int, mode: str = "custom", paths: list[list[tuple[int, int]]] | None = None, max_cells: int = MAX_CELLS) -> list[Alignment]:
    """Alignments within a band around the best chain of shared k-mers. A pair whose band has more than ``max_cells``
    cells comes back empty, with the least score."""
    from strandline.kernels.sparse import find_kmer_matches, sdpkpp

    out: list[Alignment | None] = [None] * len(xs)
    todo, bands = [], []
    for p, (x, y) in enumerate(zip(xs, ys)):
        if paths is None:
            hits = find_kmer_matches(x, y, k)
            chain = [hits[i] for i in sdpkpp(hits, k, max(1, int(scoring.table.max())), scoring.gap_open, scoring.gap_extend).path]
        else:
            chain = paths[p]
        lo, hi = band_around(chain, len(x), len(y), k, w)
        if int(np.maximum(hi - lo + 1, 0).sum()) > max_cells:
            out[p] = Alignment(MIN_SCORE, 0, 0, 0, 0, len(x), len(y), "", mode)
        else:
            todo.append(p)
            bands.append((lo, hi))
    # small matrices, of which a band is a good part, are held whole; else pairs of bands of like width go together
    size = [int((hi - lo).max()) + 1 for lo, hi in bands]
    whole = [k for k, p in enumerate(todo) if 4 * size[k] > len(xs[p]) + 1 and (len(xs[p]) + len(ys[p]) + 1) * (len(xs[p]) + 1) < SMALL]
    for k, a in zip(whole, align_batch([xs[todo[k]] for k in whole], [ys[todo[k]] for k in whole], scoring, mode, [bands[k] for k in whole])):
        out[todo[k]] = a
    order = sorted(set(range(len(todo))) - set(whole), key=lambda k: (size[k], len(bands[k][0])))
    group: list[int] = []
    for k in [*order, -1]:
        if group and (k < 0 or (len(group) + 1) * size[k] * max(len(bands[g][0]) for g in (*group, k)) > MAX_CELLS):
            got = _align_bands([xs[todo[g]] for g in group], [ys[todo[g]] for g in group], scoring, mode, [bands[g] for g in group])
            for g, a in zip(group, got):
                out[todo[g]] = a
            group = []
        group.append(k)
    return out


def align_with_path(x: str, y: str, scoring: Scoring, k: int, w: int, path: list[tuple[int, int]], mode: str = "custom") -> Alignment:
    """Within the band around a given chain of k-mer matches."""
    return align_banded([x], [y], scoring, k, w, mode, [path])[0]


def align_with_matches(x: str, y: str, scoring: Scoring, k: int, w: int, matches: list[tuple[int, int]], mode: str = "custom", mismatches: int = 0, union: bool = False) -> Alignment:
    """Within the band around the best chain of given matches.

    With ``mismatches`` the matches are led on along their diagonals first; with ``union`` the chain is led on by the covering one.
    """
    from strandline.kernels.sparse import expand_matches, sdpkpp, union_path

    hits = expand_matches(x, y, k, sorted(matches), mismatches) if mismatches else sorted(matches)
    match = max(1, int(scoring.table.max()))
    path = union_path(hits, k, match, scoring.gap_open, scoring.gap_extend) if union else sdpkpp(hits, k, match, scoring.gap_open, scoring.gap_extend).path
    return align_with_path(x, y, scoring, k, w, [hits[i] for i in path], mode)


def show_band(x: str, y: str, band: tuple[np.ndarray, np.ndarray], alignment: Alignment | None = None) -> str:
    """The matrix as text, a line for each symbol of x and one before them: ``.`` outside of the band, ``x`` inside, ``\\`` on the alignment's path."""
    lo, hi = band
    rows = [["." for _ in range(len(y) + 1)] for _ in range(len(x) + 1)]
    for d, (a, b) in enumerate(zip(lo, hi)):
        for i in range(max(int(a), 0, d - len(y)), min(int(b), len(x), d) + 1):
            rows[i][d - i] = "x"
    if alignment is not None:
        i, j = alignment.xstart, alignment.ystart
        rows[i][j] = "\\"
        for op in alignment.ops:
            i, j = i + (op != "D"), j + (op != "I")
            rows[i][j] = "\\"
    return "\n".join("".join(r) for r in rows)


def read_matrix(text: str) -> np.ndarray:
    """A 256 x 256 table from a substitution matrix in its usual text form: ``#`` comments, a head line of symbols, rows.

    Lower case scores as upper case; a symbol that the matrix lacks scores as its ``*``.
    """
    rows = [r.split() for r in text.splitlines() if r.strip() and not r.startswith("#")]
    head = rows[0]
    scores = {(r[0], c): int(float(v)) for r in rows[1:] for c, v in zip(head, r[1:])}
    table = np.zeros((256, 256), np.int64)
    for a in range(256):
        for b in range(256):
            p, q = chr(a).upper(), chr(b).upper()
            p, q = p if p in head else "*", q if q in head else "*"
            table[a, b] = scores.get((p, q), scores.get((q, p), 0))
    return table
