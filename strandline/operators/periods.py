"""Problem 3: overlapping and gapped intervals, merged into continuous periods by session windows.

An interval is a session that begins at its start and lasts as long as the row says, so ``session_window`` with a
duration per row merges overlapping intervals natively. To keep a key that holds most rows out of a single task the
line is cut into ``bins`` stretches of about as many starts each, and sessions are formed per key and stretch;
intervals with one start are folded first, on the map side. Touching sessions of a stretch are joined where they lie.
What is left to do over a whole key runs on one summary row per stretch (at most ``bins``): how far earlier stretches
reach, and where the last period before begins. With these, sessions that reach over stretches are put together, and a
gap lies before every period's start, from the furthest end before it.

Defined results: rows with a null bound or an end not above the start do not count; null keys are keys of their own;
repeated rows change nothing; a table without a valid row gives no rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import materialize

BINS = 1024
_STEP = 32


def _bin_of(c: str, bounds: list[int]) -> Column:
    """How many bounds are at most ``c``: among every 32nd of them first, then among the 32 between."""
    if not bounds:
        return F.lit(0)
    parts = [bounds[i : i + _STEP] for i in range(0, len(bounds), _STEP)]
    heads = F.array(*[F.lit(p[0]) for p in parts])
    tails = F.array(*[F.array(*[F.lit(b) for b in p]) for p in parts])
    up_to = lambda a: F.size(F.filter(a, lambda b: b <= F.col(c)))
    part = up_to(heads)
    return F.when(part == 0, 0).otherwise((part - 1) * _STEP + up_to(F.element_at(tails, F.greatest(part, F.lit(1)))))


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, bins: int = BINS) -> DataFrame:
    """(key..., span_start, span_end, prev_end): maximal periods, and the end of the one before; touching intervals are one. The keys come back as k0, k1, ..."""
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(start).cast("bigint").alias("s"), F.col(end).cast("bigint").alias("e")).filter("e > s")
    cuts = rows.agg(F.percentile_approx("s", [i / bins for i in range(1, bins)], 10 * bins)).first()[0] or []
    kb = [*names, "bin"]
    starts = rows.groupBy(*names, "s").agg(F.max("e").alias("e")).withColumn("bin", _bin_of("s", sorted(set(cuts))))
    session = F.session_window(F.timestamp_micros("s"), F.concat((F.col("e") - F.col("s")).cast("string"), F.lit(" microseconds")))
    pieces = starts.groupBy(*kb, session).agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("session_window")

    # sessions that touch, within a stretch
    inside = Window.partitionBy(*kb).orderBy("s")
    reach = F.max("e").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.withColumn("new", (reach.isNull() | (F.col("s") > reach)).cast("int"))
    pieces = pieces.withColumn("island", F.sum("new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    local = materialize(pieces.groupBy(*kb, "island").agg(F.min("s").alias("s"), F.max("e").alias("e")), "periods")

    # a local period is the beginning of a period if nothing before its stretch reaches it
    before = Window.partitionBy(*names).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    tops = local.groupBy(*kb).agg(F.max("e").alias("top"), F.max("s").alias("last")).withColumn("carry", F.max("top").over(before))
    own_last = F.when(F.col("carry").isNull() | (F.col("last") > F.col("carry")), F.col("last"))
    tops = tops.withColumn("earlier", F.max(own_last).over(before)).select(*kb, "carry", "earlier")
    on = reduce(lambda x, y: x & y, [local[k].eqNullSafe(tops[k]) for k in kb])
    marked = local.join(tops, on).drop(*[tops[k] for k in kb])
    begins = F.col("carry").isNull() | (F.col("s") > F.col("carry"))
    behind = F.greatest("carry", F.lag("e").over(inside))
    marked = marked.withColumn("behind", F.when(begins, behind)).withColumn("span_start", F.when(begins, F.col("s")).otherwise(F.col("earlier")))
    return marked.groupBy(*names, "span_start").agg(F.max("e").alias("span_end"), F.max("behind").alias("prev_end"))


def periods_and_gaps(df: DataFrame, keys: list[str], start: str, end: str, bins: int = BINS) -> DataFrame:
    """(key..., kind, span_start, span_end): kind is ``period``, or ``gap`` for the span between two consecutive periods."""
    m = merge_intervals(df, keys, start, end, bins)
    both = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("span_start"), F.col("span_end")),
        F.struct(F.lit("gap").alias("kind"), F.col("prev_end").alias("span_start"), F.col("span_start").alias("span_end")),
    )
    names = [F.col(f"k{i}").alias(k) for i, k in enumerate(keys)]
    return m.select(*names, F.explode(both).alias("x")).filter("x.span_start is not null").select(*keys, "x.kind", "x.span_start", "x.span_end")
