"""Vectors of whole numbers of which most are small: small ones in an array of 16-bit cells, the others in a map by place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The cell that stands for a number that does not fit; smaller ones, from 0, are held as they are.
LIMIT = 32767


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _fits(x: Column) -> Column:
    return (x >= 0) & (x < LIMIT)


def compress(values: Column | str) -> Column:
    """struct(low, high) of an array of whole numbers."""
    v = _c(values)
    low = F.transform(v, lambda x: F.when(_fits(x), x).otherwise(LIMIT).cast("smallint"))
    high = F.filter(F.transform(v, lambda x, i: F.struct(i.alias("i"), x.cast("bigint").alias("x"))), lambda e: ~_fits(e["x"]))
    return F.struct(low.alias("low"), F.map_from_entries(high).alias("high"))


def length(vector: Column | str) -> Column:
    return F.size(_c(vector)["low"])


def get(vector: Column | str, i: Column) -> Column:
    """The number at a place from 0; null beyond the end."""
    cell = F.try_element_at(_c(vector)["low"], i + 1)
    return F.when(cell < LIMIT, cell.cast("bigint")).otherwise(F.try_element_at(_c(vector)["high"], i))


def decompress(vector: Column | str) -> Column:
    v = _c(vector)
    return F.transform(v["low"], lambda x, i: F.when(x < LIMIT, x.cast("bigint")).otherwise(F.element_at(v["high"], i)))


def put(vector: Column | str, i: Column, value: Column) -> Column:
    """With another number at a place that the vector has."""
    v = _c(vector)
    low = F.transform(v["low"], lambda x, k: F.when(k == i, F.when(_fits(value), value).otherwise(LIMIT).cast("smallint")).otherwise(x))
    rest = F.map_filter(v["high"], lambda k, _: k != i)
    own = F.filter(F.array(F.struct(i.cast("int").alias("i"), value.cast("bigint").alias("x"))), lambda e: ~_fits(e["x"]))
    return F.struct(low.alias("low"), F.map_concat(rest, F.map_from_entries(own)).alias("high"))


def push(vector: Column | str, value: Column) -> Column:
    """With one more number at the end."""
    v = _c(vector)
    own = F.filter(F.array(F.struct(length(v).alias("i"), value.cast("bigint").alias("x"))), lambda e: ~_fits(e["x"]))
    return F.struct(F.concat(v["low"], F.array(F.when(_fits(value), value).otherwise(LIMIT).cast("smallint"))).alias("low"), F.map_concat(v["high"], F.map_from_entries(own)).alias("high"))
