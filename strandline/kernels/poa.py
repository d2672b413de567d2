"""Partial-order alignment: sequences aligned to a growing graph, linear gaps, back-pointers kept."""

from __future__ import annotations

import numpy as np


class Graph:
    """Bases as nodes in a topological order; an edge's weight counts the sequences that take it."""

    def __init__(self, first: str):
        self.base = list(first)
        self.out: list[dict[int, int]] = [{} for _ in first]
        self.into: list[dict[int, int]] = [{} for _ in first]
        self.twins: list[set[int]] = [set() for _ in first]
        self.order = list(range(len(first)))
        for a, b in zip(self.order, self.order[1:]):
            self._edge(a, b)

    def _edge(self, a: int, b: int) -> None:
        self.out[a][b] = self.out[a].get(b, 0) + 1
        self.into[b][a] = self.into[b].get(a, 0) + 1

    def _node(self, base: str) -> int:
        self.base.append(base)
        self.out.append({})
        self.into.append({})
        self.twins.append(set())
        return len(self.base) - 1

    def _sort(self) -> None:
        left = [len(p) for p in self.into]
        ready = [v for v in range(len(self.base)) if not left[v]]
        self.order = []
        while ready:
            v = ready.pop()
            self.order.append(v)
            for w in self.out[v]:
                left[w] -= 1
                if not left[w]:
                    ready.append(w)

    def edges(self) -> list[tuple[int, int, int]]:
        return [(a, b, w) for a, nxt in enumerate(self.out) for b, w in nxt.items()]

    def align(self, query: str, match: int = 1, mismatch: int = -1, gap: int = -1, mode: str = "global", band: int | None = None) -> tuple[int, list[tuple[str, int, int]]]:
        """(score, [(op, node, place in the query)]): op M, D (node alone) or I (query symbol alone).

        Modes: global; semiglobal (the query whole, the graph's ends free); local. ``band`` keeps the alignment within
        so many places of the node's distance from a source.
        """
        n = len(query)
        q = np.array(list(query))
        free = mode != "global"
        place = {v: r + 1 for r, v in enumerate(self.order)}
        low = -(10**8)
        S = np.full((len(self.order) + 1, n + 1), low, np.int32)
        B = np.full((len(self.order) + 1, n + 1), low, np.int32)  # before a query symbol alone
        slope = (gap * np.arange(n + 1)).astype(np.int32)
        S[0] = 0 if mode == "local" else slope
        subs = {c: np.where(q == c, match, mismatch).astype(np.int32) for c in set(self.base)}
        depth = np.zeros(len(self.order) + 1, np.int64)
        rows_of = [[place[p] for p in self.into[v]] or [0] for v in self.order]
        for r, (v, preds) in enumerate(zip(self.order, rows_of), 1):
            sub, row = subs[self.base[v]], B[r]
            for p in preds if not free or 0 in preds else [*preds, 0]:
                np.maximum(row[1:], S[p, :-1] + sub, out=row[1:])
            for p in preds:
                np.maximum(row, S[p] + gap, out=row)
            if free:
                row[0] = max(row[0], 0)
            run = np.maximum.accumulate(row - slope) + slope
            if mode == "local":
                np.maximum(run, 0, out=run)
            if band is not None:
                depth[r] = max(depth[p] for p in preds) + 1
                run[np.abs(np.arange(n + 1) - depth[r]) > band] = low
            S[r] = run
        if mode == "local":
            r, c = np.unravel_index(int(S.argmax()), S.shape)
        elif mode == "semiglobal":
            r, c = int(S[:, n].argmax()), n
        else:
            ends = [place[v] for v in self.order if not self.out[v]] or [0]
            r, c = max(ends, key=lambda e: S[e, n]), n
        # of equal ways a match goes first, then a node alone, then a symbol alone
        score, ops = int(S[r, c]), []
        while r > 0 or c > 0:
            if r == 0:
                if mode == "local":
                    break
                c -= 1
                ops.append(("I", -1, int(c)))
                continue
            here, preds, v = int(S[r, c]), rows_of[r - 1], self.order[r - 1]
            if here > B[r, c]:
                if mode == "local" and (c == 0 or int(S[r, c - 1]) + gap < 0):
                    break
                c -= 1
                ops.append(("I", -1, int(c)))
                continue
            sub = int(subs[self.base[v]][c - 1]) if c else 0
            p = next((p for p in (preds if not free or 0 in preds else [*preds, 0]) if c and int(S[p, c - 1]) + sub == here), None)
            if p is not None:
                ops.append(("M", v, int(c) - 1))
                r, c = p, c - 1
                continue
            p = next((p for p in preds if int(S[p, c]) + gap == here), None)
            if p is None:
                break
            ops.append(("D", v, -1))
            r = p
        return score, ops[::-1]

    def add(self, query: str, ops: list[tuple[str, int, int]]) -> None:
        """Thread an aligned query through the graph; ends that the alignment left out become branches of their own."""
        steps: list[tuple[int | None, str]] = []
        used = [j for op, _, j in ops if op != "D"]
        lead = used[0] if used else len(query)
        steps += [(None, c) for c in query[:lead]]
        steps += [(v if op == "M" else None, query[j]) for op, v, j in ops if op != "D"]
        steps += [(None, c) for c in query[used[-1] + 1 :]] if used else []
        last = None
        for v, c in steps:
            if v is None:
                node = self._node(c)
            elif self.base[v] == c:
                node = v
            else:
                node = next((t for t in sorted(self.twins[v]) if self.base[t] == c), None)
                if node is None:
                    node = self._node(c)
                    for t in [v, *self.twins[v]]:
                        self.twins[t].add(node)
                        self.twins[node].add(t)
            if last is not None:
                self._edge(last, node)
            last = node
        self._sort()

    def consensus(self) -> str:
        """The heaviest path: at each node the heaviest way in, the heavier history deciding ties."""
        best, prev = {}, {}
        for v in self.order:
            way = max(((w, best[p], -p) for p, w in self.into[v].items()), default=None)
            best[v] = way[0] + way[1] if way else 0
            prev[v] = -way[2] if way else None
        if not best:
            return ""
        v = max(self.order, key=lambda u: (best[u], -u))
        out = []
        while v is not None:
            out.append(self.base[v])
            v = prev[v]
        return "".join(reversed(out))

    def rows(self, seqs: list[str], match: int = 1, mismatch: int = -1, gap: int = -1) -> list[str]:
        """The sequences in aligned rows over common columns."""
        column, k = {}, 0
        for v in self.order:
            known = [column[t] for t in self.twins[v] if t in column]
            column[v] = known[0] if known else k
            k += not known
        out = []
        for s in seqs:
            line = ["-"] * k
            for op, v, j in self.align(s, match, mismatch, gap)[1]:
                if op == "M":
                    line[column[v]] = s[j]
            out.append("".join(line))
        return out


def consensus_of(seqs: list[str], match: int = 1, mismatch: int = -1, gap: int = -1, mode: str = "global") -> str:
    seqs = [s for s in seqs if s]
    if not seqs:
        return ""
    g = Graph(seqs[0])
    for s in seqs[1:]:
        g.add(s, g.align(s, match, mismatch, gap, mode)[1])
    return g.consensus()
