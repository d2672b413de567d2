"""Suffix arrays and what is built on them, for one text at a time."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from typing import Protocol

import numpy as np


class Suffixes(Protocol):
    """What serves as a suffix array: places by rank."""

    def __len__(self) -> int: ...

    def __getitem__(self, rank: int) -> int: ...


class Indexed(Protocol):
    """What can be searched backwards: counts of symbols before a row, and places of rows."""

    less: list[int]

    def occ(self, symbol: int, row: int) -> int: ...

    def backward_search(self, pattern: str) -> tuple[str, int, int, int]: ...

    def positions(self, lo: int, hi: int) -> list[int]: ...


def suffix_array(text: str) -> np.ndarray:
    """Places of the suffixes in sorted order, by prefix doubling.

    The text must end in its smallest symbol, the sentinel. Where the sentinel occurs more than once, its occurrences
    are distinct symbols, a later one being the smaller.
    """
    if not text:
        raise ValueError("the text must not be empty")
    raw = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    if raw[-1] != raw.min():
        raise ValueError("the text must end with its smallest symbol, the sentinel")
    n = len(raw)
    ends = np.flatnonzero(raw == raw[-1])
    rank = raw + n
    rank[ends] = len(ends) - 1 - np.arange(len(ends))
    return _double(rank)


def suffix_array_int(values: np.ndarray) -> np.ndarray:
    """The same over whole numbers; the last one must be the smallest and occur once."""
    values = np.asarray(values, np.int64)
    if not len(values) or (values[:-1] <= values[-1]).any():
        raise ValueError("the last number must be the smallest and occur once")
    return _double(values - values.min())


def _double(rank: np.ndarray) -> np.ndarray:
    """Prefix doubling, from as many symbols as fit one number."""
    n = len(rank)
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    bits = int(rank.max() + 1).bit_length()
    k = min(max(1, 62 // bits), n)
    key = np.zeros(n, np.int64)
    for j in range(k):
        key <<= bits
        key[: n - j] |= rank[j:] + 1  # 0 stands behind the end
    while True:
        sa = np.argsort(key)
        key = key[sa]
        rank = np.empty(n, np.int64)
        rank[sa] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        if rank[sa[-1]] == n - 1 or k >= n:
            return sa
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1
        k *= 2


def lcp_array(text: str, sa: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it; -1 at both ends. Sentinels match nothing."""
    n = len(sa)
    raw = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    end = raw[-1]
    inv = np.empty(n, np.int64)
    inv[sa] = np.arange(n)
    lcp = np.full(n + 1, -1, np.int64)
    h = 0
    for i in range(n):
        r = inv[i]
        if r == 0:
            h = 0
            continue
        j = sa[r - 1]
        while i + h < n and j + h < n and raw[i + h] == raw[j + h] and raw[i + h] != end:
            h += 1
        lcp[r] = h
        h = max(0, h - 1)
    return lcp


def shortest_unique(sa: np.ndarray, lcp: np.ndarray) -> list[int | None]:
    """For each place the length of the shortest substring that begins there and occurs nowhere else, or None."""
    n = len(sa)
    need = 1 + np.maximum(lcp[:-1], lcp[1:])
    out: list[int | None] = [None] * n
    for r in range(n):
        p, k = int(sa[r]), int(max(need[r], 1))
        if p + k <= n:
            out[p] = k
    return out


def bwt(text: str, sa: np.ndarray) -> str:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)[sa - 1].tobytes().decode("utf-32-le")


def bwt_links(b: str) -> np.ndarray:
    """For each row the row of the next symbol of the text: the stable order of the transform's symbols."""
    return np.argsort(np.frombuffer(b.encode("utf-32-le"), np.uint32), kind="stable")


def invert_bwt(b: str) -> str:
    links = bwt_links(b)
    r, out = int(links[0]), []
    for _ in b:
        r = int(links[r])
        out.append(b[r])
    return "".join(out)


class FMIndex:
    """Backward search over a text. Occurrence counts are kept at every ``rate``-th row, suffixes at every ``sample``-th place."""

    def __init__(self, text: str, rate: int = 64, sample: int = 1):
        sa = suffix_array(text)
        self.n, self.rate, self.sample = len(text), rate, sample
        b = bwt(text, sa)
        self.bwt = b
        codes = np.frombuffer(b.encode("utf-32-le"), np.uint32)
        symbols, at = np.unique(codes, return_inverse=True)
        self.symbols = [chr(c) for c in symbols]
        self.less = [0, *np.cumsum(np.bincount(at, minlength=len(symbols))).tolist()]
        self.index = {c: i for i, c in enumerate(self.symbols)}
        self.check = []
        for i in range(len(symbols)):
            hot = np.zeros(-(-self.n // rate) * rate, np.int64)
            hot[: self.n] = at == i
            self.check.append([0, *np.cumsum(hot.reshape(-1, rate).sum(1)).tolist()])
        kept = np.flatnonzero(sa % sample == 0)
        self.kept = dict(zip(kept.tolist(), sa[kept].tolist())) if sample > 1 else None
        self.sa = sa if sample == 1 else None

    def occ(self, symbol: int, row: int) -> int:
        """How often the symbol (its number) stands before the row in the transform."""
        block = row // self.rate
        return self.check[symbol][block] + self.bwt.count(self.symbols[symbol], block * self.rate, row)

    def backward_search(self, pattern: str) -> tuple[str, int, int, int]:
        """(Complete, Partial or Absent; rows lo..hi; length of the longest suffix of the pattern that occurs)."""
        lo, hi, k = 0, self.n, 0
        for c in reversed(pattern):
            a = self.index.get(c)
            if a is None:
                break
            p, q = self.less[a] + self.occ(a, lo), self.less[a] + self.occ(a, hi)
            if p >= q:
                break
            lo, hi, k = p, q, k + 1
        if k == len(pattern):
            return "Complete", lo, hi, k
        return ("Partial", lo, hi, k) if k else ("Absent", 0, 0, 0)

    def search_batch(self, patterns: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lo, hi, length) as ``backward_search`` gives them, of patterns that go along together; lo = hi = 0 where nothing occurs."""
        if not hasattr(self, "_rows"):
            blocks = self.n // self.rate + 1
            cells = np.full(blocks * self.rate, 255, np.uint8)
            codes = np.frombuffer(self.bwt.encode("utf-32-le"), np.uint32)
            cells[: self.n] = np.searchsorted(np.array([ord(c) for c in self.symbols], np.uint32), codes)
            self._rows = cells.reshape(blocks, self.rate)
            self._sums = np.array([c[: blocks + 1] + [c[-1]] * (blocks + 1 - len(c)) for c in self.check], np.int64)
            self._less = np.array(self.less, np.int64)
        size = np.array([len(p) for p in patterns], np.int64)
        raw = np.frombuffer("".join(patterns).encode("utf-32-le"), np.uint32)
        table = np.array([ord(c) for c in self.symbols], np.uint32)
        at = np.minimum(np.searchsorted(table, raw), len(table) - 1)
        symbol = np.where(table[at] == raw, at, -1)
        end = np.cumsum(size)
        lo, hi, done = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64), np.zeros(len(patterns), np.int64)
        inside = np.arange(self.rate)

        def rows(a, row):
            block = row // self.rate
            part = (self._rows[block] == a[:, None]) & (inside < (row - block * self.rate)[:, None])
            return self._less[a] + self._sums[a, block] + part.sum(1)

        live = np.flatnonzero(size > 0)
        while len(live):
            a = symbol[end[live] - 1 - done[live]]
            live, a = live[a >= 0], a[a >= 0]
            p, q = rows(a, lo[live]), rows(a, hi[live])
            ok = p < q
            live = live[ok]
            lo[live], hi[live] = p[ok], q[ok]
            done[live] += 1
            live = live[done[live] < size[live]]
        none = done == 0
        lo[none], hi[none] = 0, 0
        return lo, hi, done

    def locate(self, row: int) -> int:
        if self.sa is not None:
            return int(self.sa[row])
        steps = 0
        while row not in self.kept:
            a = self.index[self.bwt[row]]
            row, steps = self.less[a] + self.occ(a, row), steps + 1
        return (self.kept[row] + steps) % self.n

    def positions(self, lo: int, hi: int) -> list[int]:
        return [self.locate(r) for r in range(lo, hi)]


_COMPLEMENT = str.maketrans("ACGTNacgtn", "TGCANtgcan")


class FMDIndex(FMIndex):
    """An index of ``T$revcomp(T)$`` that searches both strands at once.

    A bi-interval is (lo, lo of the reverse complement, size, matched length).
    """

    def __init__(self, text: str, rate: int = 64):
        if set(text) - set("ACGTNacgtn$"):
            raise ValueError("the alphabet must be that of bases and the sentinel")
        super().__init__(text, rate)

    def init_interval(self, c: str) -> tuple[int, int, int, int]:
        a, r = self.index.get(c), self.index.get(c.translate(_COMPLEMENT))
        if a is None or r is None:
            return 0, 0, 0, 0
        return self.less[a], self.less[r], self.less[a + 1] - self.less[a], 1

    def backward_ext(self, iv: tuple[int, int, int, int], c: str) -> tuple[int, int, int, int]:
        lo, rev, size, k = iv
        parts = {}
        for a, symbol in enumerate(self.symbols):
            p, q = self.occ(a, lo), self.occ(a, lo + size)
            parts[symbol] = (self.less[a] + p, q - p)
        # the reverse strand's rows are ordered by the complements
        for s in sorted(parts, key=lambda s: s.translate(_COMPLEMENT)):
            if s == c:
                return parts[s][0], rev, parts[s][1], k + 1
            rev += parts[s][1]
        return 0, 0, 0, k + 1

    def forward_ext(self, iv: tuple[int, int, int, int], c: str) -> tuple[int, int, int, int]:
        lo, rev, size, k = iv
        r, l, s, k = self.backward_ext((rev, lo, size, k), c.translate(_COMPLEMENT))
        return l, r, s, k

    def all_smems(self, pattern: str, min_len: int = 1) -> list[tuple[int, int, int, int, int]]:
        """(lo, lo of the reverse complement, size, start in the pattern, length) of the super-maximal exact matches."""
        spans: list[tuple[int, int]] = []  # (start, end); only the longest match that ends at each place can be one
        for end in range(1, len(pattern) + 1):
            k = self._longest(pattern, end)
            start = end - k
            if k and spans and spans[-1][0] == start:
                spans[-1] = (start, end)
            elif k:
                spans.append((start, end))
        out = []
        for start, end in spans:
            if end - start >= min_len:
                iv = self.init_interval(pattern[end - 1])
                for c in reversed(pattern[start : end - 1]):
                    iv = self.backward_ext(iv, c)
                out.append((*iv[:3], start, end - start))
        return out

    def _longest(self, pattern: str, end: int) -> int:
        """Length of the longest match that ends before ``end``."""
        lo, hi, k = 0, self.n, 0
        while k < end:
            a = self.index.get(pattern[end - k - 1])
            if a is None:
                break
            p, q = self.less[a] + self.occ(a, lo), self.less[a] + self.occ(a, hi)
            if p >= q:
                break
            lo, hi, k = p, q, k + 1
        return k

    def smems(self, pattern: str, at: int, min_len: int = 1) -> list[tuple[int, int, int, int, int]]:
        """Those that cover a place of the pattern."""
        return [s for s in self.all_smems(pattern, min_len) if s[3] <= at < s[3] + s[4]]


#: Codes of three bits: 0 parts texts, 6 is a read's symbol that matches nothing, 7 a read's end.
_CODES = np.zeros(128, np.uint8)
for _i, _c in enumerate("ACGTN", 1):
    _CODES[[ord(_c), ord(_c.lower())]] = _i
_OTHER_STRAND = np.array([0, 4, 3, 2, 1, 5], np.uint8)
_POWERS = 8 ** np.arange(21, dtype=np.int64)
#: Symbols of a prefix; zeros behind the last symbol, so that a key may begin at any.
PREFIX, _PAD = 4, np.zeros(48, np.uint8)
#: Prefixes that begin with a symbol that may match.
FIRST, LAST = 8 ** (PREFIX - 1), 6 * 8 ** (PREFIX - 1)
#: Symbols of reads with long matches that are held at once, about.
FOLLOWED = 32_000_000


def _codes(s: str) -> np.ndarray:
    raw = np.frombuffer(s.encode("utf-32-le"), np.uint32)
    return np.where(raw < 128, _CODES[np.minimum(raw, 127)], 0).astype(np.uint8)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols two keys begin alike with."""
    return 21 - np.searchsorted(_POWERS, a ^ b, "right")


def packed_texts(texts: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, spans of both strands at which no match may begin) of texts.

    Texts are (symbols, number of first places at which matches may begin, the same of the other strand).
    """
    size = np.array([len(t[0]) for t in texts], np.int64)
    begin = np.cumsum(size + 1) - size
    codes = _codes("".join(["$", *(t[0] + "$" for t in texts)]))
    own, own_back = (np.array([t[k] for t in texts], np.int64) for k in (1, 2))
    back = 2 * len(codes) - begin - size
    skip = np.concatenate((np.stack((begin + own, begin + size), 1), np.stack((back + own_back, back + size), 1)))
    return codes, skip[skip[:, 0] < skip[:, 1]].astype(np.int32)


def packed_reads(reads: list[str]) -> np.ndarray:
    """Codes of reads, each closed by an end."""
    codes = _codes("".join(s + "$" for s in reads))
    codes[codes == 0] = 6
    codes[np.cumsum([len(s) + 1 for s in reads]) - 1] = 7
    return codes


class Places:
    """Places of codes, their prefixes and 21-symbol keys."""

    def __init__(self, codes: np.ndarray, skip: np.ndarray | None = None):
        """With ``skip``, codes are those of texts and go on with those of the other strand."""
        self.codes = np.concatenate((codes, _PAD) if skip is None else (codes, _OTHER_STRAND[codes[::-1]], _PAD))
        self.skip = None if skip is None else skip[np.argsort(skip[:, 0])]

    @staticmethod
    def _prefixes(codes: np.ndarray) -> np.ndarray:
        two = codes << 3
        two[:-1] |= codes[1:]
        out = two.astype(np.uint16)
        out <<= 6
        out[:-2] |= two[2:]
        return out

    def _blocks(self, size: int = 1 << 16):
        """(where it begins, prefixes of a block and of the 20 places behind it), in blocks that caches hold."""
        for a in range(0, len(self.codes) - len(_PAD), size):
            yield a, self._prefixes(self.codes[a : min(a + size, len(self.codes) - len(_PAD)) + 24])[:-4]

    def prefixes(self) -> np.ndarray:
        return self._prefixes(self.codes)[: -len(_PAD)]

    def loads(self) -> np.ndarray:
        """How many matches may begin with each prefix."""
        n = sum((np.bincount(p[:-20], minlength=8**PREFIX) for _, p in self._blocks()), np.zeros(8**PREFIX, np.int64))
        for a, b in () if self.skip is None else self.skip:
            n -= np.bincount(self._prefixes(self.codes[a : b + PREFIX])[: b - a], minlength=8**PREFIX)
        n[:FIRST], n[LAST:] = 0, 0
        return n

    def starts(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """(places whose prefixes are at least ``lo`` and below ``hi`` and where matches may begin, their keys)."""
        places, keys = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for a, p in self._blocks():
            at = np.flatnonzero(p[:-20] - np.uint16(lo) < np.uint16(hi - lo))
            if self.skip is not None and len(self.skip):
                i = np.searchsorted(self.skip[:, 0], at + a, "right") - 1
                at = at[(i < 0) | (at + a >= self.skip[i, 1])]
            key = p[at].astype(np.int64)
            for k in range(PREFIX, 20, PREFIX):
                key <<= 3 * PREFIX
                key |= p[at + k]
            key <<= 3
            key |= p[at + 20] >> 3 * (PREFIX - 1)
            places.append((at + a).astype(np.int32))
            keys.append(key)
        return np.concatenate(places), np.concatenate(keys)

    def keys(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for k in range(21):
            out <<= 3
            out |= self.codes[at + k]
        return out

    def reads_of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes of the reads that have these places, the places there)."""
        ends = np.flatnonzero(self.codes == 7)
        size = np.diff(ends, prepend=-1)
        read = np.searchsorted(ends, at)
        kept = np.zeros(len(ends), bool)
        kept[read] = True
        gone = np.cumsum(np.where(kept, 0, size))
        return self.codes[: len(self.codes) - len(_PAD)][np.repeat(kept, size)], at - gone[read]


class Longest:
    """Longest matches of the places of reads whose prefixes lie in a range with both strands of all texts.

    ``reads(names)`` and ``texts(names)`` give (name, Places) of one part after the other, those of these names or all. The
    keys of all ``size`` places of texts in the range are held, sorted, without their places; these are kept, with the
    keys behind them, where a key may be one of a read's.
    """

    def __init__(self, reads: Callable, texts: Callable, lo: int, hi: int, size: int, min_len: int):
        self.reads, self.texts, self.min_len = reads, texts, min_len
        self.starts = {name: p.starts(lo, hi) for name, p in reads(None)}
        bits = min(26, max(16, 3 + sum(len(keys) for _, keys in self.starts.values()).bit_length()))
        seen = np.zeros(1 << bits, bool)
        slot = lambda keys: (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
        for _, keys in self.starts.values():
            seen[slot(keys)] = True
        self.sorted, n, self.some = np.empty(size, np.int64), 0, {}
        for name, p in texts(None):
            at, keys = p.starts(lo, hi)
            self.sorted[n : n + len(keys)] = keys
            n += len(keys)
            maybe = np.flatnonzero(seen[slot(keys)])
            self.some[name] = keys[maybe], at[maybe], p.keys(at[maybe] + 21)
        self.sorted.sort()

    def found(self, most: int = 2_000_000):
        """(part of the reads, longest matches of its places in the range, places of texts that have them): no places are counted, and lengths may be 0, for those below min_len.

        ``most`` places are searched at once, or those of a part.
        """
        got, far, names, n = {}, {}, [], 0
        for name in [*self.starts, None]:
            size = 0 if name is None else len(self.starts[name][1])
            if names and (name is None or n + size > most):
                keys = np.concatenate([self.starts[x][1] for x in names])
                longest, count = self._short(keys)
                a = 0
                for x in names:
                    at, keys = self.starts.pop(x)
                    got[x] = longest[a : a + len(at)], count[a : a + len(at)]
                    a += len(at)
                    if len(f := np.flatnonzero(got[x][0] == 21)):
                        far[x] = f, at[f], keys[f]
                names, n = [], 0
            if name is not None:
                names.append(name)
                n += size
        held, n = [], 0
        for name, p in itertools.chain(self.reads(set(far)) if far else (), [(None, None)]):
            if p is not None:
                held.append((name, *p.reads_of(far[name][1])))
                n += len(held[-1][1])
            if held and (p is None or n > FOLLOWED):
                begin = np.cumsum([0, *(len(c) for _, c, _ in held)])
                x = np.concatenate([at + b for (_, _, at), b in zip(held, begin)])
                length, count = self._follow(Places(np.concatenate([c for _, c, _ in held])), x, np.concatenate([far[k][2] for k, _, _ in held]))
                a = 0
                for k, _, at in held:
                    f, longest = far[k][0], got[k][0].astype(np.int64)
                    longest[f], got[k][1][f] = length[a : a + len(f)], count[a : a + len(f)]
                    got[k] = longest, got[k][1]
                    a += len(f)
                held, n = [], 0
        for name, (longest, count) in got.items():
            yield name, longest.astype(np.int64), count.astype(np.int64)

    def _short(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(longest match up to 21 symbols, places of texts that have it); of matches of 21 symbols places are not counted."""
        longest, count = np.zeros(len(keys), np.uint8), np.zeros(len(keys), np.int32)
        if not len(self.sorted):
            return longest, count
        order = np.argsort(keys)
        keys = keys[order]
        up = np.searchsorted(self.sorted, keys)
        apart = np.minimum(self.sorted[np.maximum(up - 1, 0)] ^ keys, self.sorted[np.minimum(up, len(self.sorted) - 1)] ^ keys)
        best = _common(apart, np.int64(0))  # with the nearer neighbour
        best[best < min(self.min_len, 21)] = 0
        longest[order] = best
        near = np.flatnonzero((best > 0) & (best < 21))
        shift = 3 * (21 - best[near])
        low = keys[near] >> shift
        count[order[near]] = np.searchsorted(self.sorted, (low + 1) << shift) - np.searchsorted(self.sorted, low << shift)
        return longest, count

    def _follow(self, reads: Places, x: np.ndarray, keys: np.ndarray, most: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
        """(longest match, how many places have it) of places of the reads whose 21 symbols, the keys, occur; ``most`` pairs are held at once, or those of one place of a text."""
        order = np.argsort(keys)
        keys, behind = keys[order], reads.keys(x + 21)
        longest, count = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)

        def add(row, length):
            before = longest[row]
            np.maximum.at(longest, row, length)
            count[row[longest[row] > before]] = 0
            np.add.at(count, row[length == longest[row]], 1)

        def pairs(name):
            """(rows of x, places of a part of the texts, how many symbols up to 42 they begin alike with)."""
            some, at, after = self.some[name]
            lo = np.searchsorted(keys, some)
            live = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == some)
            at, after, lo, hi = at[live], after[live], lo[live], np.searchsorted(keys, some[live], "right")
            total = np.concatenate(([0], np.cumsum(hi - lo)))
            a = 0
            while a < len(at):
                b = max(a + 1, int(np.searchsorted(total, total[a] + most, "right")) - 1)
                n = (hi - lo)[a:b]
                row = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - lo[a:b], n)]
                yield row, np.repeat(at[a:b], n).astype(np.int64), 21 + _common(behind[row], np.repeat(after[a:b], n))
                a = b

        longer = set()
        for name in self.some:
            for row, _, length in pairs(name):
                known = length < 42
                if not known.all():
                    longer.add(name)
                add(row[known], length[known])
        for name, text in self.texts(longer) if longer else ():
            for row, y, length in pairs(name):
                live = np.flatnonzero(length == 42)
                row, y, length = row[live], y[live], length[live]
                live = np.arange(len(row))
                while len(live):
                    more = _common(reads.keys(x[row[live]] + length[live]), text.keys(y[live] + length[live]))
                    length[live] += more
                    live = live[more == 21]
                add(row, length)
        return longest, count


def super_maximal(codes: np.ndarray, longest: np.ndarray, min_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, reads, starts) of the super-maximal matches of at least min_len symbols among the longest ones at each place of packed reads."""
    ends = np.flatnonzero(codes == 7)
    begin = np.concatenate(([0], ends[:-1] + 1))
    end = np.arange(len(codes)) + longest
    new = end > np.concatenate(([-1], end[:-1]))
    new[begin] = True
    at = np.flatnonzero(new & (longest >= min_len))
    read = np.searchsorted(ends, at)
    return at, read, at - begin[read]


class Ends:
    """Numbers of the symbols before a place, the nearest first, over the symbols that patterns have; others of a text match nothing."""

    def __init__(self, symbols: np.ndarray):
        self.symbols = np.unique(symbols).astype(np.uint32)
        self.bits = (len(self.symbols) + 1).bit_length()
        self.count = 63 // self.bits  # symbols of a number
        self.powers = 1 << (self.bits * np.arange(self.count, dtype=np.int64))

    def codes(self, strings: list[str]) -> np.ndarray:
        raw = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(self.symbols):
            return np.zeros(len(raw), np.int64)
        at = np.minimum(np.searchsorted(self.symbols, raw), len(self.symbols) - 1)
        return np.where(self.symbols[at] == raw, at + 1, 0)

    def numbers(self, codes: np.ndarray, count: int = 0) -> np.ndarray:
        """For each place the symbols that begin there, in one number; zeros follow the last."""
        count = count or self.count
        if count == 1:
            return codes.astype(np.int64)
        half = self.numbers(codes, count // 2)
        shift = lambda x, n: np.concatenate((x[n:], np.zeros(min(n, len(x)), np.int64)))
        out = half << (self.bits * (count // 2)) | shift(half, count // 2)
        return out << self.bits | shift(codes, count - 1) if count % 2 else out

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols two numbers begin alike with."""
        return self.count - np.searchsorted(self.powers, a ^ b, "right")

    def patterns(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers at all places of the patterns read backwards, where each begins); a code that no text has parts them."""
        size = np.array([len(x) for x in strings], np.int64)
        begin = np.cumsum(size + 1) - size - 1
        codes = np.full(int((size + 1).sum()), len(self.symbols) + 1, np.int64)
        inside = np.ones(len(codes), bool)
        inside[begin + size] = False
        codes[inside] = self.codes([x[::-1] for x in strings])
        return self.numbers(codes), begin


class Backwards:
    """Places of texts sorted by the symbols before them, for patterns that are searched from their ends.

    Patterns are given by the numbers of their last symbols; ``take`` gives those of some of them whole, as ``Ends.patterns`` does.
    """

    def __init__(self, texts: list[str], ends: Ends):
        codes = [np.zeros(1, np.int64)]
        for t in texts:
            codes += [ends.codes([t]), codes[0]]
        self.begins = np.cumsum([1, *(len(t) + 1 for t in texts)])[:-1]
        back = np.concatenate(codes)[::-1]
        self.ends, self.last, self.at = ends, len(back) - 1, ends.numbers(back)
        live = np.flatnonzero(back > 0).astype(np.int32)
        self.places = live[np.argsort(self.at[live])]
        self.sorted = self.at[self.places]

    @staticmethod
    def _places(lo: np.ndarray, hi: np.ndarray, most: int = 500_000):
        """(rows, ranks from lo to hi of each), ``most`` of them at once or those of one row."""
        total = np.concatenate(([0], np.cumsum(hi - lo)))
        a = 0
        while a < len(lo):
            b = max(a + 1, int(np.searchsorted(total, total[a] + most, "right")) - 1)
            n = (hi - lo)[a:b]
            yield np.repeat(np.arange(a, b), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - lo[a:b], n)
            a = b

    def _follow(self, numbers: np.ndarray, starts: np.ndarray):
        """(rows, places, lengths) of the matches of patterns whose first number occurs."""
        lo, hi = (np.searchsorted(self.sorted, numbers[starts], side) for side in ("left", "right"))
        for row, rank in self._places(lo, hi):
            x, y = starts[row], self.places[rank].astype(np.int64)
            length, live = np.full(len(row), self.ends.count), np.arange(len(row))
            while len(live):
                more = self.ends.common(numbers[x[live] + length[live]], self.at[y[live] + length[live]])
                length[live] += more
                live = live[more == self.ends.count]
            yield row, y, length

    def longest(self, keys: np.ndarray, take) -> np.ndarray:
        """Length of the longest suffix of each pattern that occurs."""
        if not len(self.sorted):
            return np.zeros(len(keys), np.int64)
        up = np.searchsorted(self.sorted, keys)
        best = np.maximum(self.ends.common(self.sorted[np.maximum(up - 1, 0)], keys), self.ends.common(self.sorted[np.minimum(up, len(self.sorted) - 1)], keys))
        far = np.flatnonzero(best == self.ends.count)
        if len(far):
            for row, _, length in self._follow(*take(far)):
                np.maximum.at(best, far[row], length)
        return best

    def found(self, keys: np.ndarray, length: np.ndarray, take):
        """(patterns, where their suffixes of these lengths begin in the texts, each followed by one symbol), in bounded parts."""
        near = np.flatnonzero((length > 0) & (length < self.ends.count))
        shift = self.ends.bits * (self.ends.count - length[near])
        low = keys[near] >> shift
        lo = np.searchsorted(self.sorted, low << shift)
        some = np.flatnonzero(lo < len(self.sorted))
        some = some[self.sorted[lo[some]] >> shift[some] == low[some]]
        near, lo, low, shift = near[some], lo[some], low[some], shift[some]
        hi = np.searchsorted(self.sorted, (low + 1) << shift)
        for row, rank in self._places(lo, hi):
            yield near[row], self.last - self.places[rank].astype(np.int64) - length[near[row]] + 1
        far = np.flatnonzero(length >= self.ends.count)
        at = np.searchsorted(self.sorted, keys[far]) if len(self.sorted) else np.zeros(0, np.int64)
        far = far[self.sorted[np.minimum(at, len(self.sorted) - 1)] == keys[far]] if len(self.sorted) else far[:0]
        if len(far):
            for row, y, n in self._follow(*take(far)):
                whole = n == length[far[row]]
                yield far[row[whole]], self.last - y[whole] - n[whole] + 1


def wavelet_rank(text: str, symbol: str, at: int) -> int:
    """How often a symbol occurs up to a place, it included."""
    return text.count(symbol, 0, at + 1)
