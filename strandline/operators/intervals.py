"""Interval overlap joins as binned equi-joins.

Both sides are put into bins and joined on key and bin; a pair is kept only in the first bin that both touch, so it
comes out once and no distinct follows. Intervals far longer than a bin would explode into many rows; they live at a
coarser level: level ``l`` has bins ``FACTOR ** l`` times as wide, and an interval lives at the first level where it
touches at most ``SPREAD`` bins. A pair meets at the coarser of its two levels, to which the other interval is lifted.
Only levels at which the other side has intervals are lifted to.

What only needs to be counted is counted without any pair: overlaps of an interval are the starts before its end less
the ends up to its start, by running totals over ranges of places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.prob import distributed_running

BIN, FACTOR, LEVELS, SPREAD = 4096, 16, 10, 4


def _home(start: str, end: str, width: int, levels: int) -> Column:
    level = F.lit(levels - 1)
    for l in range(levels - 2, -1, -1):
        level = F.when(F.floor((F.col(end) - 1) / F.lit(width * FACTOR**l)) - F.floor(F.col(start) / F.lit(width * FACTOR**l)) < SPREAD, F.lit(l)).otherwise(level)
    return level


def _placed(df: DataFrame, start: str, end: str, width: int, levels: list[int], side: str) -> DataFrame:
    """One row for each level of ``levels`` from the home level on and each bin there; ``home`` is added to ``levels``."""
    home = F.col(f"__{side}home")
    at = F.explode(F.array_union(F.array(home), F.filter(F.array(*map(F.lit, levels or [0])), lambda l: l > home)))
    df = df.withColumn(f"__{side}level", at)
    w = F.pow(F.lit(FACTOR), F.col(f"__{side}level")) * width
    lo, hi = F.floor(F.col(start) / w), F.floor((F.greatest(end, F.col(start) + 1) - 1) / w)  # an empty one stands in one bin
    return df.withColumn(f"__{side}lo", lo).withColumn(f"__{side}bin", F.explode(F.sequence(lo, hi)))


def interval_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], keys: list[tuple[str, str]] = (), bin_width: int = BIN, levels: int = LEVELS, how: str = "inner", empty_inside: bool = False) -> DataFrame:
    """Pairs whose intervals overlap (``a.end > b.start and a.start < b.end``); empty intervals match nothing, or with
    ``empty_inside`` (inner joins only) those that they lie strictly inside of, as the condition alone says.

    ``keys`` are further pairs of equal columns; ``how`` is inner, left_semi or left_anti. The columns of both sides
    must have different names.
    """
    (ls, le), (rs, re_) = left_span, right_span
    if empty_inside and how != "inner":
        raise ValueError("empty intervals have a rule of their own in inner joins only")
    if how in ("left_semi", "left_anti"):
        from strandline.session import materialize

        tagged = materialize(left.withColumn("__row", F.monotonically_increasing_id()), "interval-left")
        hit = count_overlaps(tagged, right, left_span, right_span, keys, "__row", "__n").filter("__n > 0").select("__row")
        return tagged.join(hit, "__row", how).drop("__row")
    least = 0 if empty_inside else 1
    lv = left.filter(F.col(le) - F.col(ls) >= least).withColumn("__lhome", _home(ls, le, bin_width, levels))
    rv = right.filter(F.col(re_) - F.col(rs) >= least).withColumn("__rhome", _home(rs, re_, bin_width, levels))
    there = [sorted(r[0] for r in d.select(h).distinct().collect()) for d, h in ((lv, "__lhome"), (rv, "__rhome"))]  # at most ``levels`` numbers each
    a, b = _placed(lv, ls, le, bin_width, there[1], "l"), _placed(rv, rs, re_, bin_width, there[0], "r")
    on = (F.col("__llevel") == F.col("__rlevel")) & (F.col("__lbin") == F.col("__rbin"))
    for x, y in keys:
        on = on & (F.col(x) == F.col(y))
    on = on & (F.col(le) > F.col(rs)) & (F.col(ls) < F.col(re_)) & (F.col("__lbin") == F.greatest("__llo", "__rlo"))
    at_home = a.join(b.filter("__rlevel = __rhome"), on)
    if any(l > r for l in there[0] for r in there[1]):  # right intervals lifted to the level of longer left ones
        at_home = at_home.unionByName(a.filter("__llevel = __lhome").join(b.filter("__rlevel > __rhome"), on))
    return at_home.drop(*[f"__{s}{c}" for s in "lr" for c in ("home", "level", "lo", "bin")])


def count_overlaps(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], keys: list[tuple[str, str]], left_id: str, out: str) -> DataFrame:
    """(left_id, out): how many right intervals each left one overlaps; left ones that are empty or have a null key have none.

    Each right interval adds one start and one end, so running totals need no reset where a key begins.
    """
    (ls, le), (rs, re_) = left_span, right_span
    names = [f"__k{i}" for i in range(len(keys))]
    whole = lambda d, cols, s, e: d.filter((F.col(e) > F.col(s)) & F.array_size(F.array_compact(F.array(*[F.col(c).cast("string") for c in cols]))).eqNullSafe(len(cols)))
    l, r = whole(left, [x for x, _ in keys], ls, le), whole(right, [y for _, y in keys], rs, re_)
    lk, rk = [F.col(x).alias(n) for (x, _), n in zip(keys, names)], [F.col(y).alias(n) for (_, y), n in zip(keys, names)]
    none = F.lit(None).cast(left.schema[left_id].dataType)

    def total(mark: str, probe: str, before: bool) -> DataFrame:
        """Marks (of all smaller keys and) before the probe, or up to it."""
        points = r.select(*rk, F.col(mark).cast("bigint").alias("__at"), F.lit(1).alias("__order"), F.lit(1).alias("__one"), none.alias("__id"))
        probes = l.select(*lk, F.col(probe).cast("bigint").alias("__at"), F.lit(0 if before else 2).alias("__order"), F.lit(0).alias("__one"), F.col(left_id).alias("__id"))
        run = distributed_running(points.unionByName(probes), [*names, "__at", "__order"], F.col("__one"))
        return run.filter("__order <> 1").select("__id", (F.col("__run") if before else -F.col("__run")).alias("__run"))

    both = total(rs, le, True).unionByName(total(re_, ls, False))
    return both.groupBy(F.col("__id").alias(left_id)).agg(F.sum("__run").alias(out))


def annotate_hits(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], keys: list[tuple[str, str]], left_id: str, out: str = "n_hits") -> DataFrame:
    """``left`` with the number of right intervals it overlaps, 0 where there is none (payloads changed by a query); ids are unique."""
    hits = count_overlaps(left, right, left_span, right_span, keys, left_id, "__hits")
    return left.join(hits, left_id, "left").withColumn(out, F.coalesce("__hits", F.lit(0))).drop("__hits")
