"""Prefix aggregates: scans, Fenwick-style prefixes, rank and select on bits, symbol ranks.

Per key they are windows; over a whole table they go by ranges with carried totals (``distributed_running``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.prob import distributed_running


def scan(values: Column | str, op, zero: Column | None = None) -> Column:
    """Inclusive scan of an array with any operation of two columns; with ``zero`` the exclusive one, which begins with it."""
    v = F.col(values) if isinstance(values, str) else values
    if zero is None:
        step = lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x)))
        return F.when(F.size(v) > 0, F.aggregate(F.slice(v, 2, 1_000_000_000), F.slice(v, 1, 1), step)).otherwise(F.slice(v, 1, 0))
    whole = F.aggregate(v, F.array(zero), lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x))))
    return F.slice(whole, F.lit(1), F.size(v))


def prefix_sum(df: DataFrame, keys: list[str], order: list[str], value: str, exclusive: bool = False, out: str = "prefix") -> DataFrame:
    end = -1 if exclusive else Window.currentRow
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    return df.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))


def prefix_max(df: DataFrame, keys: list[str], order: list[str], value: str, out: str = "prefix") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.max(value).over(w))


def bit_ranks(df: DataFrame, idx: str, bit: str) -> DataFrame:
    """(idx, bit, rank1, rank0): ones and zeros up to the index, it included; one vector over the whole table."""
    run = distributed_running(df.select(idx, bit), [idx], F.col(bit).cast("int"))
    return run.select(idx, bit, F.col("__run").cast("bigint").alias("rank1"), (F.col("__pos") - F.col("__run")).cast("bigint").alias("rank0"))


def extend_ranks(ranks: DataFrame, more: DataFrame, idx: str, bit: str) -> DataFrame:
    """Ranks of a vector to which further bits, all of larger indexes, are appended; what there is is not counted again."""
    last = ranks.agg(F.max("rank1").alias("r1"), F.max("rank0").alias("r0")).first()
    added = bit_ranks(more, idx, bit).withColumn("rank1", F.col("rank1") + (last.r1 or 0)).withColumn("rank0", F.col("rank0") + (last.r0 or 0))
    return ranks.unionByName(added)


def rank_samples(ranks: DataFrame, idx: str, k: int) -> DataFrame:
    """The ranks at the last index of every ``k`` bits: samples from which any other follows by counting at most ``k`` bits."""
    return ranks.filter((F.col("rank1") + F.col("rank0")) % k == 0)


def bit_select(ranks: DataFrame, idx: str, bit: str, one: bool = True) -> DataFrame:
    """(j, idx): the smallest index whose rank is j, for every j from 1."""
    hit = ranks.filter(F.col(bit) if one else ~F.col(bit))
    return hit.select(F.col("rank1" if one else "rank0").alias("j"), idx)


def symbol_ranks(df: DataFrame, keys: list[str], order: str, symbol: str, out: str = "rank") -> DataFrame:
    """How often the row's own symbol occurs up to it, it included."""
    w = Window.partitionBy(*keys, symbol).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.count("*").over(w))


def less_table(df: DataFrame, keys: list[str], symbol: str) -> DataFrame:
    """(keys, symbol, n, less): how many symbols are smaller, from the histogram."""
    h = df.groupBy(*keys, symbol).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(symbol).rowsBetween(Window.unboundedPreceding, -1)
    return h.withColumn("less", F.coalesce(F.sum("n").over(w), F.lit(0)).cast("bigint"))
