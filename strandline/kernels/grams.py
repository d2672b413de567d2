"""q-grams of many texts as runs of neighbours that share a bucket, and the pairs of places with one q-gram.

The bucket of a q-gram follows from its least m-gram, so neighbours mostly share it: a run travels as its symbols, about
four for each q-gram, and no q-gram as a row of its own. Fingerprints only find candidates, symbols decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Symbols that are cut into runs at once, about, and places of a text at which a run may begin in one piece.
GROUP, PIECE = 2_000_000, 1_000_000
#: Pairs of places put out at once, about.
PAIRS = 1_000_000
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


def fingerprints(c: np.ndarray, q: int) -> np.ndarray:
    """One 64-bit number for each place with q symbols ahead, by doubling."""
    if len(c) < q:
        return np.zeros(0, np.uint64)
    block, size, out, done = c.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        power = np.uint64(pow(_BASE, size, 1 << 64))
        if q & size:
            n = len(c) - done - size + 1
            out = block if out is None else out[:n] * power + block[done : done + n]
            done += size
        if 2 * size > q:
            break
        block = block[:-size] * power + block[size:]
        size *= 2
    out = out ^ (out >> np.uint64(32))
    out *= _MIX
    return out ^ (out >> np.uint64(29))


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    size = 1
    while 2 * size <= w:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return h if size == w else np.minimum(h[: len(h) - w + size], h[w - size :])


def _codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all texts as bytes, or as 32-bit numbers if any is not ASCII, lengths)."""
    t = texts.cast(pa.large_string())
    if not len(t):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    ends = np.frombuffer(t.buffers()[1], np.int64)[t.offset : t.offset + len(t) + 1]
    c = np.frombuffer(t.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    if not len(c) or c.max() < 128:
        return c, np.diff(ends)
    strings = t.to_pylist()
    return np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32), np.array([len(s) for s in strings], np.int64)


def runs(ids: pa.Array, texts: pa.Array, q: int, buckets: int) -> Iterator[tuple[int, bytes, int, bytes]]:
    """(bucket, runs, bytes of a symbol, symbols) for each bucket of each group of the texts. Neither column has nulls in texts."""
    c, size = _codes(texts)
    begin = np.cumsum(size) - size
    group, total = [], 0
    for i in np.flatnonzero(size >= q).tolist():
        for at in range(0, int(size[i]) - q + 1, PIECE):
            n = min(PIECE + q - 1, int(size[i]) - at)
            group.append((i, at, n))
            total += n
            if total >= GROUP:
                yield from _cut(ids, c, begin, group, q, buckets)
                group, total = [], 0
    if group:
        yield from _cut(ids, c, begin, group, q, buckets)


def _cut(ids: pa.Array, codes: np.ndarray, begin: np.ndarray, group: list, q: int, buckets: int) -> Iterator[tuple[int, bytes, int, bytes]]:
    row, at, n = (np.array(x, np.int64) for x in zip(*group))
    c = np.concatenate([codes[b : b + k] for b, k in zip((begin[row] + at).tolist(), n.tolist())])
    m = min(q, max(7, q // 4))
    low = _least((fingerprints(c, m) >> np.uint64(32)).astype(np.uint32), q - m + 1)
    bucket = ((low * np.uint32(0x9E3779B1)) >> np.uint32(4)).astype(np.int64) % buckets
    first = np.cumsum(n) - n
    last = first + n - q  # the last place of each piece with q symbols ahead
    step = np.zeros(len(bucket) + q, np.int8)
    step[first] += 1
    step[last + 1] -= 1
    bucket[np.cumsum(step[: len(bucket)], dtype=np.int8) == 0] = -1
    edge = np.ones(len(bucket), bool)
    edge[1:] = bucket[1:] != bucket[:-1]
    edge[first] = True
    s = np.flatnonzero(edge)
    k = np.diff(s, append=len(bucket))
    live = bucket[s] >= 0
    s, k = s[live], k[live]
    order = np.argsort(bucket[s], kind="stable")
    s, k = s[order], k[order]
    piece = np.searchsorted(first, s, "right") - 1
    width = k + q - 1
    ends = np.cumsum(width)
    symbols = c[np.repeat(s - ends + width, width) + np.arange(ends[-1])]
    names, where, count = ids.take(pa.array(row[piece])), pa.array(s - first[piece] + at[piece]), pa.array(k.astype(np.int32))
    own = bucket[s]
    bounds = np.flatnonzero(np.diff(own, prepend=-1, append=-1))
    codec = pa.Codec("zstd")
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        part = pa.RecordBatch.from_arrays([names.slice(a, b - a), where.slice(a, b - a), count.slice(a, b - a)], ["id", "at", "n"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(part)
        yield int(own[a]), sink.getvalue().to_pybytes(), c.itemsize, codec.compress(symbols[ends[a] - width[a] : ends[b - 1]].tobytes(), asbytes=True)


class Side:
    """The q-grams of one side of a bucket."""

    def __init__(self, parts: list[tuple[bytes, int, bytes]], q: int):
        tables = [pa.ipc.open_stream(r).read_all() for r, _, _ in parts]
        t = pa.concat_tables(tables).combine_chunks()
        self.id = pa.concat_arrays(t["id"].chunks)
        self.at, n = t["at"].to_numpy(), t["n"].to_numpy().astype(np.int64)
        codec = pa.Codec("zstd")
        texts = [np.frombuffer(codec.decompress(s, int(np.sum(x["n"].to_numpy().astype(np.int64) + q - 1)) * w), np.uint8 if w == 1 else np.uint32) for x, (_, w, s) in zip(tables, parts)]
        self.c = np.concatenate(texts)
        self.ends = np.cumsum(n)
        self.begin = np.cumsum(n + q - 1) - (n + q - 1)
        self.place = np.repeat(self.begin - self.ends + n, n) + np.arange(self.ends[-1])
        self.h = fingerprints(self.c, q)[self.place]
        self.gram = np.arange(len(self.h))

    def keep(self, live: np.ndarray) -> None:
        self.h, self.gram, self.place = self.h[live], self.gram[live], self.place[live]

    def of(self, k: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """Ids and places of the k-th q-grams."""
        run = np.searchsorted(self.ends, self.gram[k], "right")
        return self.id.take(pa.array(run)), pa.array((self.at[run] + self.place[k] - self.begin[run]).astype(np.int32))


def pairs(xs: list, ys: list, q: int) -> Iterator[pa.RecordBatch]:
    """(x_id, y_id, x, y): all pairs of places of a bucket's two sides with one q-gram."""
    if not xs or not ys:
        return
    x, y = Side(xs, q), Side(ys, q)
    for a, b in ((x, y), (y, x)):
        seen = np.zeros(1 << 24, bool)
        seen[a.h >> np.uint64(40)] = True
        b.keep(seen[b.h >> np.uint64(40)])
    x.keep(np.argsort(x.h, kind="stable"))
    lo, hi = np.searchsorted(x.h, y.h, "left"), np.searchsorted(x.h, y.h, "right")
    y.keep(hi > lo)
    lo, n = lo[hi > lo], (hi - lo)[hi > lo]
    ends = np.cumsum(n)
    a = 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] - n[a] + PAIRS, "right")))
        k, size = np.repeat(np.arange(a, b), n[a:b]), n[a:b]
        i = np.repeat(lo[a:b] - np.cumsum(size) + size, size) + np.arange(len(k))
        same = np.ones(len(k), bool)
        for d in range(q):
            same &= x.c[x.place[i] + d] == y.c[y.place[k] + d]
        i, k = i[same], k[same]
        (xi, xp), (yi, yp) = x.of(i), y.of(k)
        yield pa.RecordBatch.from_arrays([xi, yi, xp, yp], ["x_id", "y_id", "x", "y"])
        a = b
