"""Exact search and distances as column expressions.

All exact matchers of the field give the same answer, every occurrence, overlapping ones included; here they are one
expression on the JVM's own string search.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.alphabets import bind

#: Hits whose places are summed up in one array, and symbols of the chunks in which texts with more hits are searched.
MANY = 512


def find_all(text: Column | str, pattern: Column | str) -> Column:
    """Array of the starts (from 0) of all occurrences. ``pattern``: a text or a column; an empty one is an error."""
    t = F.col(text) if isinstance(text, str) else text
    if isinstance(pattern, str):
        if not pattern:
            raise ValueError("the pattern must not be empty")
        p = F.lit(pattern)
    else:
        p = F.when(F.length(pattern) == 0, F.raise_error(F.lit("the pattern must not be empty")).cast("string")).otherwise(pattern)

    # a pattern that cannot overlap itself is cut out, by a plain search; another one is cut before, by a look ahead
    plain = isinstance(pattern, str) and not any(pattern.startswith(pattern[-k:]) for k in range(1, len(pattern)))

    def cut(t: Column, p: Column) -> Column:
        if plain:
            return F.split(t, F.lit(re.sub(r"([^\w\s])", r"\\\1", pattern)), -1)
        quoted = F.replace(p, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
        return F.split(t, F.concat(F.lit("(?=\\Q"), quoted, F.lit("\\E)")), -1)

    def sums(t: Column, p: Column, c: Column) -> Column:
        """The text is cut at every occurrence: the pieces' lengths add up to the starts, overlapping ones included."""
        if plain:
            return F.aggregate(F.slice(c, F.lit(1), F.size(c) - 1), F.array().cast("array<int>"), lambda acc, k: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)) + len(pattern), F.lit(0)) + F.length(k))))
        first = F.when(F.startswith(t, p), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(F.slice(c, F.lit(1), F.size(c) - 1), first, lambda acc, k: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + F.length(k))))

    def search(both: Column) -> Column:
        t, p = both["t"], both["p"]
        # adding to an array copies it: a text of many hits is taken in chunks of MANY symbols and a pattern's length less one
        chunks = F.regexp_extract_all(t, F.concat(F.lit("(?s)(?=(.{1,"), (F.length(p) + MANY - 1).cast("string"), F.lit(f"}})).{{1,{MANY}}}")), F.lit(1))
        by_chunk = F.flatten(F.transform(chunks, lambda k, i: F.when(F.contains(k, p), F.transform(sums(k, p, cut(k, p)), lambda x: x + i * MANY)).otherwise(F.array().cast("array<int>"))))
        starts = bind(cut(t, p), lambda c: F.when(F.size(c) <= MANY, sums(t, p, c)).otherwise(by_chunk))
        return F.when(~F.contains(t, p), F.array().cast("array<int>")).otherwise(starts)

    return F.when(t.isNotNull() & p.isNotNull(), bind(F.struct(t.alias("t"), p.alias("p")), search))


def count_all(text: Column | str, pattern: str) -> Column:
    """How many occurrences, overlapping ones included, by one look-ahead pattern."""
    return F.regexp_count(text, F.lit(f"(?={re.escape(pattern)})"))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Positions that differ; texts of unequal length are an error."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    d = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return F.when(F.length(a) == F.length(b), d).when(F.length(a) != F.length(b), F.raise_error(F.lit("hamming distance of texts of unequal length")).cast("bigint"))


def levenshtein(a: Column | str, b: Column | str) -> Column:
    return F.levenshtein(a, b)


def bounded_levenshtein(a: Column | str, b: Column | str, k: int) -> Column:
    """The distance, or null above k."""
    return F.nullif(F.levenshtein(a, b, k), F.lit(-1))
