"""Problem 7: long exact spans shared between records, by recompression.

Rounds of run and pair compression rename the text: a maximal run of one symbol, and a pair of neighbours whose names
fall on opposite sides of a coin flipped per name and round, become one symbol. Names are fingerprints of what they
stand for, so they are global without a dictionary and rounds need no shuffle. Every symbol carries its *dependence
span*, the stretch of text that alone decides that the symbol arises there; a window of text therefore holds the same
interior symbols wherever it occurs. Of a window's interior symbols on a level whose dependence spans are about a third
of a window long, the one with the least fingerprint is its key, which neighbouring windows share; windows without such a
symbol go a level down, and at the bottom are their own keys. Keys found in one record only exclude their windows; windows
of shared keys are verified symbol by symbol (48 bases packed into 96 bits, without loss), so that the result is exact:
no shared window is missed and none is invented.

Records are parsed in overlapping pieces, and whatever is put together per record goes by pieces first.

Defined results: a null sequence and one shorter than the window share nothing; symbols other than A, C, G, T end a
stretch; a null id is left out; repeated rows with one id count as one record; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.alphabets import chunks
from strandline.llm.sequences import clean_seq
from strandline.session import materialize

WINDOW = 48
#: Symbols of the pieces in which records are parsed.
CHUNK = 65_536
_BASES = np.full(256, 255, np.uint8)
for _i, _c in enumerate(b"ACGT"):
    _BASES[_c] = _i
#: An odd root for polynomials modulo 2**64 and its inverse.
_ROOT = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Symbols that a worker parses at once, about.
GROUP = 1_000_000
#: Ranks below this are tried first: about a third.
_FEW = (1 << 64) // 3
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mix32(x: np.ndarray) -> np.ndarray:
    """Names of symbols: two that are equal by chance cost a candidate, never a result."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


#: Names and values of the codes of single symbols; two of the four bases fall on either side of the first coin.
_NAMES = mix32(np.arange(2001, 2257, dtype=np.uint32))
_VALUES = mix(np.arange(11, 267, dtype=np.uint64))


def rounds_for(window: int) -> int:
    """Rounds after which dependence spans are about a third of a window long: they grow by about a half each round."""
    return max(1, round(math.log(max(window, 12) / 6) / math.log(1.5)) - 2)


def recompress(codes: np.ndarray, rounds: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Dependence spans (ds, de) of the symbols of every level, lowest first; both rise along the text."""
    at = np.arange(len(codes), dtype=np.int32)
    name = _NAMES[codes]
    ds, de = at, at + 1
    levels = [(ds, de)]
    for level in range(rounds):
        head = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))  # runs
        k = np.diff(np.append(head, len(name)))
        tail = head + k - 1
        name = name[head]
        long = np.flatnonzero(k > 1)
        name[long] = mix32(name[long] ^ (k[long].astype(np.uint32) << np.uint32(1)))
        ds, de = ds[np.maximum(head - 1, 0)], de[np.minimum(tail + 1, len(de) - 1)]
        levels.append((ds, de))
        side = (mix32(name + np.uint32(level * 2 + 1)) & np.uint32(1)).astype(bool)  # pairs: left where False, right where True
        pair = np.flatnonzero(~side[:-1] & side[1:])
        keep = np.ones(len(name), bool)
        keep[pair + 1] = False
        lone = side & keep  # looks to its left; one that is no right side looks to its right
        new_ds, new_de = ds.copy(), de.copy()
        new_ds[1:][lone[1:]] = ds[:-1][lone[1:]]
        new_de[:-1][~side[:-1]] = de[1:][~side[:-1]]
        name[pair] = mix32(name[pair] * np.uint32(3) ^ mix32(name[pair + 1]))
        name, ds, de = name[keep], new_ds[keep], new_de[keep]
        levels.append((ds, de))
        if len(ds) < 2:
            break
    return levels


def _powers(of: str, root: np.uint64, n: int) -> np.ndarray:
    if len(_POWERS.get(of, ())) < n:
        _POWERS[of] = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, root))))
    return _POWERS[of][:n]


def _prints(codes: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function that gives the fingerprints of the stretches a..b: polynomials modulo 2**64, from sums of powers."""
    n = len(codes)
    back = _powers("back", _INVERSE, n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[codes] * _powers("forth", _ROOT, n), out=sums[1:])
    return lambda a, b: mix((sums[b] - sums[a]) * back[a] ^ ((b - a).astype(np.uint64) << np.uint64(48)))


def window_keys(codes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, end of windows, key) for runs of windows that one key covers. codes holds a break at both ends."""
    n = len(codes)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none
    bad = np.concatenate((np.zeros(1, np.int32), np.cumsum(codes > 3, dtype=np.int32)))
    starts = np.flatnonzero(bad[window:] == bad[:-window])
    if not len(starts):
        return none, none, none
    prints = _prints(codes)
    lo, hi = starts.copy(), starts + window  # a window that no symbol keys is its own key
    open_ = np.arange(len(starts))
    for ds, de in reversed(recompress(codes, rounds_for(window))):
        inside = (de - ds >= window // 3) & (de - ds <= window)
        ds, de = ds[inside], de[inside]
        if not len(ds):
            continue
        rank = prints(ds, de)
        for few in (rank < np.uint64(_FEW), slice(None)):  # where there is one of low rank, it is the least
            s, e, r = ds[few], de[few], rank[few]
            if not len(s) or not len(open_):
                continue
            p = starts[open_]
            if len(p) * 16 > n:  # spans that begin before the window, and those that end within it
                first = np.cumsum(np.bincount(s + 1, minlength=n + 2), dtype=np.int32)[p]
                last = np.cumsum(np.bincount(e, minlength=n + 2), dtype=np.int32)[p + window] - 1
            else:
                first, last = np.searchsorted(s, p), np.searchsorted(e, p + window, side="right") - 1
            change = np.flatnonzero(np.concatenate(([True], (first[1:] != first[:-1]) | (last[1:] != last[:-1]))))
            a, b = first[change], last[change]
            least, at = np.full(len(a), np.iinfo(np.uint64).max), np.full(len(a), -1)
            live = np.flatnonzero(a <= b)
            k = a[live]
            while len(live):
                own = r[k]
                less = np.flatnonzero(own < least[live])
                at[live[less]], least[live[less]] = k[less], own[less]
                k = k + 1
                more = np.flatnonzero(k <= b[live])
                live, k = live[more], k[more]
            at = np.repeat(at, np.diff(np.append(change, len(p))))
            ok = at >= 0
            lo[open_[ok]], hi[open_[ok]] = s[at[ok]], e[at[ok]]
            open_ = open_[~ok]
        if not len(open_):
            break
    change = np.flatnonzero(np.concatenate(([True], (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]) | (starts[1:] != starts[:-1] + 1))))
    first, end = starts[change], np.append(starts[change[1:] - 1], starts[-1]) + 1
    key = prints(lo[change], hi[change])
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (first[1:] != end[:-1])))  # along a run of one symbol all windows are alike
    last = np.append(np.flatnonzero(new)[1:], len(key)) - 1
    return first[new], end[last], key[new].view(np.int64)


def _groups(texts: pa.Array) -> list[tuple[int, int]]:
    """(first, how many) of the rows to parse together: about GROUP symbols, and a row at least."""
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    cut = np.flatnonzero(np.diff(size // GROUP)) + 1
    return [(int(a), int(b - a)) for a, b in zip([0, *cut], [*cut, len(texts)]) if b > a]


def _encode(seqs: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All records of a batch in one array, parted and framed by breaks; the place where each begins."""
    parts = [(s or "").encode("ascii", "replace") for s in seqs]
    raw = np.frombuffer(b"\n" + b"\n".join(parts) + b"\n", np.uint8)
    begin = 1 + np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts[:-1]]))).astype(np.int64)
    return _BASES[raw], begin


def pack(codes: np.ndarray, starts: np.ndarray, window: int) -> list[np.ndarray]:
    """The windows at ``starts`` as signed words of 24 bases, without loss."""
    words = []
    for w in range(0, window, 24):
        x = np.zeros(len(starts), np.int64)
        for j in range(w, min(w + 24, window)):
            x = (x << 2) | codes[starts + j]
        words.append(x)
    return words


def pieces(df: DataFrame, id_col: str, seq_col: str, window: int, chunk: int) -> DataFrame:
    """(rec_id, of, at, text): records in pieces that overlap by a window less one; ``of`` tells apart the sequences of one id."""
    recs = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("rec_id"), clean_seq(seq_col).alias("seq"))
    cut = recs.select("rec_id", F.xxhash64("seq").alias("of"), F.posexplode(chunks("seq", chunk, window - 1)).alias("at", "text"))
    return cut.filter(F.length("text") >= window)


def shared_windows(df: DataFrame, id_col: str = "rec_id", seq_col: str = "seq", window: int = WINDOW, chunk: int = CHUNK) -> DataFrame:
    """(rec_id, at, pos): every window that also occurs in another record, with the piece it lies in."""
    id_type = df.schema[id_col].dataType.simpleString()
    cut = pieces(df, id_col, seq_col, window, chunk)

    def keys(batches):
        for b in batches:
            for k, n in _groups(b.column(3)):
                part = b.slice(k, n)
                codes, begin = _encode(part.column(3).to_pylist())
                first, end, key = window_keys(codes, window)
                c = np.searchsorted(begin, first, side="right") - 1
                row = pa.array(c)
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(row) for i in range(3)), pa.array((first - begin[c]).astype(np.int32)), pa.array((end - begin[c]).astype(np.int32)), pa.array(key)], ["rec_id", "of", "at", "w_from", "w_to", "key"])

    anchors = materialize(cut.mapInArrow(keys, f"rec_id {id_type}, of bigint, at int, w_from int, w_to int, key bigint"), "p7-keys")
    revealed = anchors.groupBy("key").agg(F.min("rec_id").alias("lo"), F.max("rec_id").alias("hi")).filter("lo <> hi").select("key")
    # at most ``chunk`` spans to a piece; written, so that their size decides how the texts are joined
    spans = materialize(anchors.join(revealed, "key", "left_semi").groupBy("rec_id", "of", "at").agg(F.collect_set(F.struct("w_from", "w_to")).alias("spans")), "p7-spans")
    todo = cut.join(spans, ["rec_id", "of", "at"]).select("rec_id", "at", "text", "spans")

    n_words = -(-window // 24)
    cols = ", ".join(f"k{i} bigint" for i in range(n_words))

    def windows(batches):
        for b in batches:
            for k, rows in _groups(b.column(2)):
                part = b.slice(k, rows)
                codes, begin = _encode(part.column(2).to_pylist())
                lists = part.column(3)
                off = np.asarray(lists.offsets)
                flat = lists.values.slice(off[0], off[-1] - off[0])
                f, n = flat.field(0).to_numpy().astype(np.int64), (flat.field(1).to_numpy() - flat.field(0).to_numpy()).astype(np.int64)
                r = np.repeat(np.repeat(np.arange(part.num_rows), np.diff(off)), n)
                pos = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(f, n)
                words = pack(codes, pos + begin[r], window)
                at = part.column(1).take(pa.array(r))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(r)), at, pa.array(pos + at.to_numpy().astype(np.int64) * chunk), *map(pa.array, words)], ["rec_id", "at", "pos", *(f"k{i}" for i in range(n_words))])

    seen = materialize(todo.mapInArrow(windows, f"rec_id {id_type}, at int, pos bigint, {cols}"), "p7-windows")
    names = [f"k{i}" for i in range(n_words)]
    common = seen.groupBy(*names).agg(F.min("rec_id").alias("lo"), F.max("rec_id").alias("hi")).filter("lo <> hi").select(*names)
    return seen.join(common, names, "left_semi").select("rec_id", "at", "pos")


def shared_spans(df: DataFrame, id_col: str = "rec_id", seq_col: str = "seq", window: int = WINDOW, chunk: int = CHUNK) -> DataFrame:
    """(rec_id, span_start, span_end): the maximal spans of a record covered by its shared windows.

    Spans are formed within pieces first; only these are put together over a record.
    """

    def islands(rows: DataFrame, keys: list[str]) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy("a", "b")
        reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn("new", (reach.isNull() | (F.col("a") > reach)).cast("int"))
        rows = rows.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        return rows.groupBy(*keys, "island").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("island")

    w = shared_windows(df, id_col, seq_col, window, chunk).select("rec_id", "at", F.col("pos").alias("a"), (F.col("pos") + window).alias("b"))
    return islands(islands(w, ["rec_id", "at"]), ["rec_id"]).select("rec_id", F.col("a").alias("span_start"), F.col("b").alias("span_end"))


def shared_fraction(df: DataFrame, id_col: str = "rec_id", seq_col: str = "seq", window: int = WINDOW) -> DataFrame:
    """(rec_id, n_symbols, n_shared, share): for every record how much of it occurs elsewhere; null sequences have 0 symbols."""
    spans = shared_spans(df, id_col, seq_col, window).groupBy("rec_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("n_shared"))
    recs = df.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("rec_id")).agg(F.max(F.coalesce(F.length(clean_seq(seq_col)), F.lit(0))).cast("bigint").alias("n_symbols"))
    out = recs.join(spans, "rec_id", "left").withColumn("n_shared", F.coalesce("n_shared", F.lit(0)).cast("bigint"))
    return out.withColumn("share", F.when(F.col("n_symbols") > 0, F.round(F.col("n_shared") / F.col("n_symbols"), 6)).otherwise(F.lit(0.0)))
