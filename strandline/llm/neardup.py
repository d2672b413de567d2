"""Problem 2: near-duplicate records with small edits, by a byte-position inverted index with count filtering.

A record is the set of its 12-symbol substrings. A substring of bases packs into three bytes: the upper two are a
*position*, the last one the *byte* at it, so a record is a sparse string of positional bytes. How many records' bytes
fall on each of the 2**24 slots (position and byte) is counted first, over all records, in one table of fixed size whatever the
size of the data; it puts the bytes of a record into one order common to all records, rare ones first. Two sets whose
intersection is at least half of their union share at least a third of the sum of their sizes; if ``t`` is that number,
the first ``n - ceil(n/2) + L`` bytes of each, in the common order, have at least ``min(L, t)`` in common. Of these bytes
those are indexed that occur more than once at all, as others have no partner; shared ones are tallied per pair, pairs
below the guaranteed minimum dropped, and the rest verified on the records themselves. Nothing is lost: the filter is a
bound, not a guess.

Exact copies are folded onto one representative before and unfolded after.

Defined results: null ids are left out; null, empty and short sequences (below 12 symbols) have no substring and no
partner; N and any other symbol is a symbol like the rest; equal ids are one record; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.sequences import clean_seq
from strandline.session import materialize

WIDTH, THRESHOLD, LEVEL = 12, 0.5, 4
#: Slots of the table of loads, 256 bytes at each of 65,536 positions; loads above 255 count as 255.
SLOTS = 1 << 24
_BLOCK = 1 << 16
#: Records that a worker takes at once, and pairs that it verifies at once.
ROWS, PAIRS = 1024, 2048
#: Parts into which the nodes of one label are cut where labels are shortened.
SALTS = 16
_BASES = np.full(256, 4, np.uint8)
for _i, _c in enumerate(b"ACGT"):
    _BASES[_c] = _i


def raw_codes(seqs: list[str], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(row, code): the positional bytes of records from left to right, as position * 256 + byte, repeated ones included.

    Substrings with other symbols than bases get a 62-bit fingerprint behind the space of the bases.
    """
    if not 4 < width <= 30:
        raise ValueError("width must be 5 to 30")
    text = "\n".join(seqs) + "\n"
    raw = np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = len(raw) - width + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    base = _BASES[raw if raw.dtype == np.uint8 else np.minimum(raw, 255)]
    code, done, power, k = None, 0, (base & 3).astype(np.int32 if width < 16 else np.int64), 1
    while done < width:  # stretches of 1, 2, 4, ... symbols, put together as the bits of the width say
        if width & k:
            code = power[done:] if code is None else (code[: len(power) - done] << (2 * k)) | power[done:]
            done += k
        if done < width:
            power = (power[:-k] << (2 * k)) | power[k:]
            k *= 2
    code = code[:n]
    breaks = np.concatenate((np.zeros(1, np.int32), np.cumsum(raw == 10, dtype=np.int32)))
    odd = np.concatenate((np.zeros(1, np.int32), np.cumsum(base > 3, dtype=np.int32)))
    at = np.flatnonzero(breaks[width:] == breaks[:n])
    row = breaks[at].astype(np.int64)
    out = code[at].astype(np.int64)
    strange = np.flatnonzero(odd[at + width] > odd[at])
    if len(strange):
        h = np.zeros(len(strange), np.uint64)
        for j in range(width):
            h = (h ^ raw[at[strange] + j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out[strange] = (h >> np.uint64(2)).astype(np.int64) | (1 << 61)
    return row, out


def _distinct(row: np.ndarray, code: np.ndarray, load: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes of each row, by row, load (below 256) and code."""
    if not len(row):
        return row, code
    load = np.zeros(len(row), np.uint8) if load is None else load
    odd = np.zeros(int(row[-1]) + 1, bool)
    odd[row[code >= SLOTS]] = True
    if not odd.any():
        return _plain(row, code, load)
    at = odd[row]
    a, b = _plain(row[~at], code[~at], load[~at]), _any(row[at], code[at], load[at])
    row, code = np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1]))
    order = np.argsort(row.astype(np.uint16) if row.max() < 1 << 16 else row, kind="stable")
    return row[order], code[order]


def _plain(row: np.ndarray, code: np.ndarray, load: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For codes within the table: load and code are one number of 32 bits, and rows of like length are sorted side by side."""
    if not len(row):
        return row, code
    key = (load.astype(np.int64) << 24 | code).astype(np.uint32)
    size = np.bincount(row)
    longest = int(size.max())
    if longest * len(size) < 4 * len(row):
        place = np.arange(len(row)) - (np.cumsum(size) - size)[row]
        table = np.full((len(size), longest), 0xFFFFFFFF, np.uint32)
        table[row, place] = key
        table.sort(axis=1)
        key = table[row, place]
    else:
        both = np.sort(row << 32 | key)
        row, key = both >> 32, (both & 0xFFFFFFFF).astype(np.uint32)
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])))
    return row[new], (key[new] & np.uint32(SLOTS - 1)).astype(np.int64)


def _any(row: np.ndarray, code: np.ndarray, load: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((code, load, row))
    row, code = row[order], code[order]
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (code[1:] != code[:-1])))
    return row[new], code[new]


def codes_of(seqs: list[str], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(row, code): the distinct positional bytes of records, by row and code."""
    return _distinct(*raw_codes(seqs, width))


def slots_of(code: np.ndarray) -> np.ndarray:
    """The slot of each code: the code itself where it is within the table, else a hash of it."""
    if not len(code) or code.max() < SLOTS:
        return code
    h = code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return np.where(code < SLOTS, code, (h >> np.uint64(40)).astype(np.int64))


def slot_loads(reps: DataFrame, width: int) -> np.ndarray:
    """How many bytes fall on each slot, over all records, up to 255: 16 MB at any size of the data."""

    def count(batches):
        load, n = np.zeros(SLOTS, np.uint32), 0
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                slot = slots_of(raw_codes(b.column(0).slice(lo, ROWS).to_pylist(), width)[1])
                np.add.at(load, slot, np.uint32(1))
                n += len(slot)
                if n > 1 << 30:  # long before a cell is full
                    np.minimum(load, 255, out=load)
                    n = 0
        parts = np.minimum(load, 255).astype(np.uint8).reshape(-1, _BLOCK)
        at = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([parts[i].tobytes() for i in at], pa.binary())], ["block", "loads"])

    def total(table):
        load = np.zeros(_BLOCK, np.uint16)
        for x in table.column("loads").to_pylist():
            load = np.minimum(load + np.frombuffer(x, np.uint8), 255)
        return pa.table({"block": table.column("block").slice(0, 1), "loads": pa.array([load.astype(np.uint8).tobytes()], pa.binary())})

    rows = reps.select("seq").mapInArrow(count, "block int, loads binary").groupBy("block").applyInArrow(total, "block int, loads binary").toArrow()
    load = np.zeros((SLOTS // _BLOCK, _BLOCK), np.uint8)
    for at, x in zip(rows.column("block").to_pylist(), rows.column("loads").to_pylist()):
        load[at] = np.frombuffer(x, np.uint8)
    return load.ravel()


def shared_counts(a: pa.Array, b: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shared, in either) for pairs of sequences: how many distinct substrings."""
    both = pa.concat_arrays([a, b]).dictionary_encode()
    row, code = codes_of(both.dictionary.to_pylist(), width)
    code = np.unique(code, return_inverse=True)[1].astype(np.int64)
    size = np.bincount(row, minlength=len(both.dictionary))
    begin = np.cumsum(size) - size
    at = both.indices.to_numpy()
    n = size[at]
    k = np.repeat(begin[at], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    pair = np.repeat(np.arange(len(at)) % len(a), n)
    key = np.sort(pair << 32 | code[k])
    shared = np.bincount(key[1:][key[1:] == key[:-1]] >> 32, minlength=len(a))
    return shared, n[: len(a)] + n[len(a) :] - shared


def similar_representatives(reps: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, level: int = LEVEL) -> DataFrame:
    """(a, b, shared, total) of distinct sequences (rep, seq), a < b, whose similarity reaches the threshold."""
    loads = reps.sparkSession.sparkContext.broadcast(slot_loads(reps, width))
    rep_type = reps.schema["rep"].dataType.simpleString()

    def index(batches):
        load = loads.value
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                row, code = raw_codes(part.column(1).to_pylist(), width)
                row, code = _distinct(row, code, load[slots_of(code)])
                size = np.bincount(row, minlength=part.num_rows)
                place = np.arange(len(row)) - (np.cumsum(size) - size)[row]
                keep = (place < (size - np.ceil(threshold * size).astype(np.int64) + level)[row]) & (load[slots_of(code)] > 1)
                row, code, place = row[keep], code[keep], place[keep]
                yield pa.RecordBatch.from_arrays([pa.array(code), part.column(0).take(pa.array(row)), pa.array(size[row].astype(np.int32)), pa.array(place.astype(np.int32))], ["code", "rep", "n", "r"])

    postings = materialize(reps.select("rep", "seq").mapInArrow(index, f"code bigint, rep {rep_type}, n int, r int"), "p2-index")
    ratio = threshold / (1 + threshold)
    # the smaller set of a pair shares more of itself, so that less of it needs to be looked at
    x, y = postings.alias("x"), postings.filter(F.col("r") < F.col("n") - F.ceil(2 * ratio * F.col("n") - 1e-9) + level).alias("y")
    sized = (F.col("y.n") >= F.col("x.n") * threshold) & ((F.col("y.n") < F.col("x.n")) | ((F.col("y.n") == F.col("x.n")) & (F.col("y.rep") < F.col("x.rep"))))
    # with both sizes known the bytes that must be shared lie further ahead than the index of either alone reaches
    least = F.ceil((F.col("x.n") + F.col("y.n")) * ratio - 1e-9)
    sized = sized & (F.col("x.r") < F.col("x.n") - least + level) & (F.col("y.r") < F.col("y.n") - least + level)
    pairs = x.join(y, (F.col("x.code") == F.col("y.code")) & sized)
    pairs = pairs.groupBy(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).agg(F.count("*").alias("tally"), F.max(F.col("x.n") + F.col("y.n")).alias("total"))
    pairs = pairs.filter(F.col("tally") >= F.least(F.lit(level), F.ceil(F.col("total") * ratio - 1e-9))).select("a", "b")
    both = pairs.join(reps.select(F.col("rep").alias("a"), F.col("seq").alias("seq_a")), "a").join(reps.select(F.col("rep").alias("b"), F.col("seq").alias("seq_b")), "b")

    def verify(batches):
        for b in batches:
            for lo in range(0, b.num_rows, PAIRS):
                part = b.slice(lo, PAIRS)
                shared, total = shared_counts(part.column("seq_a"), part.column("seq_b"), width)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(shared.astype(np.int32)), pa.array(total.astype(np.int32))], ["a", "b", "shared", "total"])

    found = both.select("a", "b", "seq_a", "seq_b").mapInArrow(verify, f"a {rep_type}, b {rep_type}, shared int, total int")
    return found.filter((F.col("total") > 0) & (F.col("shared") >= F.col("total") * threshold))


def fold(df: DataFrame, id_col: str, seq_col: str, width: int) -> tuple[DataFrame, DataFrame]:
    """(representatives (rep, seq), members (id, rep)): one representative for each distinct sequence that has a substring."""
    rows = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), clean_seq(seq_col).alias("seq")).filter(F.length("seq") >= width)
    reps = materialize(rows.groupBy("seq").agg(F.min("id").alias("rep")), "p2-reps")
    return reps, rows.join(reps, "seq").select("id", "rep")


def near_duplicates(df: DataFrame, id_col: str = "read_id", seq_col: str = "seq", width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """(id_a, id_b), smaller first: all pairs of rows whose sets of substrings reach the similarity."""
    reps, members = fold(df, id_col, seq_col, width)
    members = materialize(members, "p2-members")
    links = similar_representatives(reps, width, threshold).select("a", "b")
    a, b = members.select(F.col("id").alias("p"), F.col("rep").alias("a")), members.select(F.col("id").alias("q"), F.col("rep").alias("b"))
    copies = members.groupBy("rep").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    pairs = links.unionByName(copies).join(a, "a").join(b, "b").filter((F.col("a") != F.col("b")) | (F.col("p") < F.col("q")))
    return pairs.select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b"))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, group): connected components; the group is named by its smallest node.

    Labels spread along links and are shortened by pointer jumping; each round is written to the shared folder and only
    the number of changed labels comes back to the driver.
    """
    edges = materialize(links.select(F.col("a").alias("s"), F.col("b").alias("t")).union(links.select(F.col("b"), F.col("a"))), "edges")
    labels = materialize(edges.groupBy(F.col("s").alias("node")).agg(F.least(F.min("t"), F.first("s")).alias("label")), "labels")
    while True:
        near = edges.join(labels, edges.t == labels.node).groupBy(F.col("s").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # one row for each label, on every salt: a component that holds a third of all nodes is one label
        up = low.select(F.col("node").alias("label"), F.col("label").alias("upper")).join(low.select("label").distinct(), "label")
        up = up.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = low.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        nxt = materialize(salted.join(up, ["label", "salt"], "left").select("node", "old", F.least("label", "upper").alias("label")), "labels")
        labels = nxt.select("node", "label")
        if not nxt.filter("old <> label").limit(1).count():
            break
    return nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("group"))


def near_duplicate_groups(df: DataFrame, id_col: str = "read_id", seq_col: str = "seq", width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """(id, rep, group_id, n_links): one row for each row that has a substring.

    ``rep`` is the class of exact copies, ``n_links`` the number of other distinct sequences it is linked to.
    """
    reps, members = fold(df, id_col, seq_col, width)
    links = materialize(similar_representatives(reps, width, threshold).select("a", "b"), "p2-links")
    groups = components(reps.select(F.col("rep").alias("node")), links)
    degree = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count("*").alias("n_links"))
    per_rep = groups.join(degree, "node", "left").select(F.col("node").alias("rep"), F.col("group").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    return members.join(per_rep, "rep").select("id", "rep", "group_id", "n_links")
