"""Problem 1: splitting oversized records at natural boundaries by recursive bisection.

A record above ``limit`` symbols is bisected: the cut goes into the strongest boundary (the longest run of unknown
bases) within reach of the midpoint, or onto the midpoint where none is in reach; halves that still exceed
``limit - overlap`` are bisected again; at the end every piece but the first is extended to the left by ``overlap``. A piece knows the boundaries that begin in its own
part, before any overlap, so that together the pieces of a record name each of its boundaries once.

Defined results: a null sequence counts as empty and comes out as one empty piece; a record of at most ``limit``
symbols is one piece; a null id stays null; rows with equal ids are split separately; an empty table gives no rows.
Only the named columns are read, so extra columns of any name do no harm.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.sequences import clean_seq

LIMIT, OVERLAP, MIN_RUN, REACH = 5000, 100, 10, 0.25


def gap_runs(seq: str, min_run: int = MIN_RUN) -> list[tuple[int, int]]:
    """Maximal runs of at least ``min_run`` N, as half-open spans."""
    return [m.span() for m in re.finditer("N{%d,}" % min_run, seq)]


def bisect(length: int, runs: list[tuple[int, int]], limit: int, overlap: int, reach: float = REACH) -> list[tuple[int, int, str]]:
    """Pieces (start, end, kind of the cut at the start); consecutive ones share exactly ``overlap`` symbols."""
    if not 0 <= overlap < limit / 2:
        raise ValueError("overlap must be at least 0 and below half the limit")
    if length <= limit:
        return [(0, length, "whole")]
    core = limit - overlap
    cuts: list[tuple[int, str]] = []
    todo = [(0, length)]
    while todo:
        a, b = todo.pop()
        if b - a <= core:
            continue
        mid = (a + b) // 2
        near = max(1, int((b - a) * reach))
        best = None
        for s, e in _between(runs, mid - near, mid + near):
            at = min(max((s + e) // 2, a + 1), b - 1)
            if abs(at - mid) <= near:
                rank = (-(e - s), abs(at - mid), at)
                best = min(best, (rank, at)) if best else (rank, at)
        at, kind = (best[1], "gap") if best else (mid, "midpoint")
        cuts.append((at, kind))
        todo += [(a, at), (at, b)]
    edges = [(0, "start"), *sorted(cuts), (length, "end")]
    return [(max(0, s - overlap) if i else 0, e, kind) for i, ((s, kind), (e, _)) in enumerate(zip(edges, edges[1:]))]


def _between(runs: list[tuple[int, int]], lo: int, hi: int) -> list[tuple[int, int]]:
    i, j = bisect_left(runs, lo, key=lambda r: r[1]), bisect_right(runs, hi, key=lambda r: r[0])
    return runs[i:j]


_PIECE = pa.struct([("piece_no", pa.int32()), ("start_pos", pa.int64()), ("end_pos", pa.int64()), ("cut", pa.string()), ("gaps", pa.list_(pa.int64()))])


def bisect_records(df: DataFrame, id_col: str = "rec_id", seq_col: str = "seq", limit: int = LIMIT, overlap: int = OVERLAP, min_run: int = MIN_RUN, reach: float = REACH) -> DataFrame:
    """(rec_id, seq, pieces): one row per oversized record, its cleaned symbols, and its pieces with the boundaries in each."""
    src = df.select(F.col(id_col).alias("rec_id"), clean_seq(seq_col).alias("seq")).filter(F.length("seq") > limit)
    schema = df.select(F.col(id_col).alias("rec_id")).schema
    out = f"rec_id {schema[0].dataType.simpleString()}, seq string, pieces array<struct<piece_no:int,start_pos:bigint,end_pos:bigint,cut:string,gaps:array<bigint>>>"

    def split(s: str) -> list[dict]:
        runs = gap_runs(s, min_run)
        parts = bisect(len(s), runs, limit, overlap, reach)
        own = [0] + [a + overlap for a, _, _ in parts[1:]] + [len(s)]
        starts = [a for a, _ in runs]
        at = [bisect_left(starts, p) for p in own]
        return [{"piece_no": i, "start_pos": a, "end_pos": b, "cut": k, "gaps": starts[at[i] : at[i + 1]]} for i, (a, b, k) in enumerate(parts)]

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([split(s) for s in b.column(1).to_pylist()], pa.list_(_PIECE))], ["rec_id", "seq", "pieces"])

    return src.mapInArrow(run, out)


def split_oversized(df: DataFrame, id_col: str = "rec_id", seq_col: str = "seq", limit: int = LIMIT, overlap: int = OVERLAP, **options) -> DataFrame:
    """(rec_id, piece_no, start_pos, end_pos, cut, piece): every record, in pieces of at most ``limit`` symbols.

    Records within the limit never leave the JVM.
    """
    big = bisect_records(df, id_col, seq_col, limit, overlap, **options).select("rec_id", "seq", F.explode("pieces").alias("p"))
    big = big.select("rec_id", "p.piece_no", "p.start_pos", "p.end_pos", "p.cut", F.expr("substring(seq, int(p.start_pos) + 1, int(p.end_pos - p.start_pos))").alias("piece"))
    small = df.select(F.col(id_col).alias("rec_id"), F.coalesce(clean_seq(seq_col), F.lit("")).alias("piece")).filter(F.length("piece") <= limit)
    small = small.select("rec_id", F.lit(0).alias("piece_no"), F.lit(0).cast("bigint").alias("start_pos"), F.length("piece").cast("bigint").alias("end_pos"), F.lit("whole").alias("cut"), "piece")
    return big.unionByName(small)


def boundary_runs(df: DataFrame, id_col: str = "rec_id", seq_col: str = "seq", limit: int = LIMIT, overlap: int = OVERLAP, min_run: int = MIN_RUN) -> DataFrame:
    """(rec_id, gap_start): the boundaries in the pieces of each oversized record; -1 for a record without any in its pieces."""
    found = bisect_records(df, id_col, seq_col, limit, overlap, min_run)
    gaps = F.flatten(F.transform("pieces", lambda p: p["gaps"]))
    return found.select("rec_id", F.explode(F.when(F.size(gaps) == 0, F.array(F.lit(-1).cast("bigint"))).otherwise(gaps)).alias("gap_start"))


def claimed_lengths(fai: DataFrame) -> DataFrame:
    """(name, claimed_len, n_claims): the length an index claims; the largest where rows differ. Null names are left out."""
    return fai.filter(F.col("name").isNotNull()).groupBy("name").agg(F.max("len").alias("claimed_len"), F.count("*").alias("n_claims"))
