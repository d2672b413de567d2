"""Probabilities in log space: conversions, sums, cumulative sums, false discovery rates, distributions, integrals.

Columns named ``ln_*`` are natural logs, minus infinity standing for probability 0. Spark's ``ln(0)`` is null, so logs
of zero are written out.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

NEG_INF = float("-inf")
_PHRED = -10 / math.log(10)
#: By how much the log of a cumulative probability may exceed 0 (fixed value).
OVERSHOOT = 1e-5


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ln(p: Column | str) -> Column:
    """Natural log, minus infinity for 0."""
    p = _c(p)
    return F.when(p == 0, F.lit(NEG_INF)).otherwise(F.log(p))


def prob_to_phred(p: Column | str) -> Column:
    return ln(p) * _PHRED


def phred_to_prob(q: Column | str) -> Column:
    return F.exp(_c(q) / _PHRED)


def ln_to_phred(x: Column | str) -> Column:
    return _c(x) * _PHRED


def phred_to_ln(q: Column | str) -> Column:
    return _c(q) / _PHRED


def ln_one_minus_exp(x: Column | str) -> Column:
    """ln(1 - exp(x)), by the stabler of two forms."""
    x = _c(x)
    return F.when(x == 0, F.lit(NEG_INF)).when(x < -0.693, F.log1p(-F.exp(x))).otherwise(F.log(-F.expm1(x)))


def ln_add_exp(a: Column | str, b: Column | str) -> Column:
    a, b = _c(a), _c(b)
    hi, lo = F.greatest(a, b), F.least(a, b)
    return F.when((lo == NEG_INF) | (hi == -NEG_INF), hi).otherwise(hi + F.log1p(F.exp(lo - hi)))


def ln_sub_exp(a: Column | str, b: Column | str) -> Column:
    """ln(exp(a) - exp(b)); b above a is an error, nearly equal ones give minus infinity."""
    a, b = _c(a), _c(b)
    return (
        F.when(F.abs(a - b) < 1e-12, F.lit(NEG_INF))
        .when(b == NEG_INF, a)
        .when(a < b, F.raise_error(F.lit("the subtrahend exceeds the minuend")).cast("double"))
        .otherwise(a + ln_one_minus_exp(b - a))
    )


def cap_overshoot(x: Column | str, epsilon: float) -> Column:
    """0 for a log probability that exceeds it by at most epsilon; an error beyond."""
    x = _c(x)
    return F.when(x <= 0, x).when(x <= epsilon, F.lit(0.0)).otherwise(F.raise_error(F.lit("probability exceeds 1 beyond the tolerance")).cast("double"))


#: Width of the ranges of logs that are summed on one scale.
_SCALE = 256


def ln_sum_exp(df: DataFrame, keys: list[str], x: str, out: str = "ln_sum", others: dict[str, tuple[Column, Callable[[str], Column]]] | None = None) -> DataFrame:
    """(keys, out): ln of the sum of the exponentials of each group, for logs of any size; minus infinity over nothing.

    Logs are summed by ranges of 256, each on its own scale, with partial sums on the map side; a group's few ranges are
    put together on the scale of the highest. ``others`` adds aggregates: of the rows, and of a range's results.
    """
    others = others or {}
    level = F.when((F.col(x) > NEG_INF) & (F.col(x) < -NEG_INF), F.floor(F.col(x) / _SCALE).cast("double"))
    rows = df.withColumn("__level", F.when(F.col(x).isNotNull(), F.coalesce(level, F.col(x))))
    part = F.when(level.isNotNull(), F.exp(F.col(x) - F.col("__level") * _SCALE)).otherwise(1.0)
    parts = rows.groupBy(*keys, "__level").agg(F.sum(F.when(F.col(x).isNotNull(), part)).alias("__s"), *[a.alias(n) for n, (a, _) in others.items()])
    kept = F.when(F.col("__level").isNotNull(), F.struct(F.col("__level").alias("l"), F.col("__s").alias("s")))
    sums = parts.groupBy(*keys).agg(F.max("__level").alias("__top"), F.collect_list(kept).alias("__parts"), *[f(n).alias(n) for n, (_, f) in others.items()])
    total = F.aggregate("__parts", F.lit(0.0), lambda a, p: a + p["s"] * F.exp((p["l"] - F.col("__top")) * _SCALE))
    top = F.col("__top")
    value = F.when(top.isNull() | (top == NEG_INF), F.lit(NEG_INF)).when(top == -NEG_INF, top).otherwise(top * _SCALE + F.log(total))
    return sums.withColumn(out, value).drop("__top", "__parts")


def ln_product(x: Column | str) -> Column:
    """Aggregate: the log of the product of probabilities."""
    return F.sum(_c(x))


def scan_rows(df: DataFrame, keys: list[str], order: list[str], value: str, op, out: str = "scan") -> DataFrame:
    """``df`` with the running result of any associative operation of two numbers, by key and in the given order.

    ``op`` is a NumPy ufunc (``np.add``, ``np.maximum``, ``np.logaddexp``) or any function of two numbers. Rows are
    sorted and streamed; a key of any size is carried over from batch to batch in one number. Without keys all rows pass
    through one task: sums and maxima over whole tables are ``distributed_running``'s. Nulls are passed over and give null.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    names = df.columns

    def run(batches):
        last, carry = None, None
        step = op if isinstance(op, np.ufunc) else np.frompyfunc(op, 2, 1)
        for b in batches:
            ids = list(zip(*(b.column(names.index(k)).to_pylist() for k in keys))) if keys else [()] * b.num_rows
            x = b.column(names.index(value))
            live = pc.is_valid(x).to_numpy(zero_copy_only=False)
            v = pc.fill_null(x.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
            got = np.full(len(v), np.nan)
            heads = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
            for a, z in zip(heads, [*heads[1:], len(ids)]):
                if last is None or ids[a] != last:
                    last, carry = ids[a], None
                at = a + np.flatnonzero(live[a:z])
                if len(at):
                    part = v[at] if carry is None else np.concatenate(([carry], v[at]))
                    run_ = np.asarray(step.accumulate(part if step is op else part.astype(object)), float)
                    got[at] = run_ if carry is None else run_[1:]
                    carry = float(run_[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, mask=~live)], [*names, out])

    rows = df.repartition(*keys) if keys else df.repartition(1)
    schema = StructType([*df.schema.fields, StructField(out, DoubleType())])
    return rows.sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def ln_cumsum_exp(df: DataFrame, keys: list[str], order: list[str], x: str, out: str = "ln_cum") -> DataFrame:
    """``df`` with the running ln of the sum of exponentials, for logs of any size."""
    import numpy as np

    return scan_rows(df, keys, order, x, np.logaddexp, out)


def distributed_running(df: DataFrame, order: list[str], value: Column, kind: str = "sum", partitions: int | None = None) -> DataFrame:
    """``df`` with ``__pos`` (rank from 1 in the order) and ``__run`` (running sum or max of ``value``), without a global window.

    Rows are range-partitioned by the order, scanned within partitions, and shifted by the totals of earlier ones: one
    row per partition is all that one task sees.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    from strandline.session import materialize

    ranged = materialize(df.withColumn("__v", value).repartitionByRange(n, *order).withColumn("__p", F.spark_partition_id()), "running")
    agg = F.sum if kind == "sum" else F.max
    totals = ranged.groupBy("__p").agg(agg("__v").alias("__t"), F.count("*").alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select("__p", agg("__t").over(before).alias("__c"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__k"))
    w = Window.partitionBy("__p").orderBy(*order)
    local = ranged.withColumn("__l", agg("__v").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("__i", F.row_number().over(w))
    joined = local.join(F.broadcast(carry), "__p")
    run = F.col("__l") + F.coalesce("__c", F.lit(0)) if kind == "sum" else F.greatest("__l", "__c")
    return joined.withColumn("__run", run).withColumn("__pos", F.col("__i") + F.col("__k")).drop("__p", "__v", "__l", "__i", "__c", "__k")


def expected_fdr(df: DataFrame, order: list[str], pep: str, out: str = "fdr") -> DataFrame:
    """Expected false discovery rate of each posterior error probability: the mean of those up to its rank, at most 1.

    ``order`` breaks ties and must make the order total. No global window: totals of ranges are carried over.
    """
    run = distributed_running(df, [pep, *order], F.col(pep))
    return run.withColumn(out, F.least(F.lit(1.0), F.col("__run") / F.col("__pos"))).drop("__run", "__pos")


def cdf(df: DataFrame, keys: list[str], value: str, p: str) -> DataFrame:
    """(keys, value, pmf, cdf): duplicates merged; a total that exceeds 1 by rounding is 1, one beyond the tolerance an error."""
    pmf = df.groupBy(*keys, value).agg(F.sum(p).alias("pmf"))
    w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("pmf").over(w)
    pmf = pmf.withColumn("cdf", total)
    beyond = F.raise_error(F.concat(F.lit("cumulative probability above 1: "), F.col("cdf").cast("string"))).cast("double")
    return pmf.withColumn("cdf", F.when(F.col("cdf") <= 1, F.col("cdf")).when(F.col("cdf") <= math.exp(OVERSHOOT), 1.0).otherwise(beyond))


def cdf_reduce(c: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Without steps of no mass."""
    w = Window.partitionBy(*keys).orderBy(value)
    return c.withColumn("__b", F.lag("cdf").over(w)).filter(F.col("__b").isNull() | (F.col("cdf") != F.col("__b"))).drop("__b")


def cdf_sample(c: DataFrame, keys: list[str], value: str, n: int) -> DataFrame:
    """Every (len // (n - 1))-th step and the last one; whole where it has at most n steps."""
    if n < 2:
        raise ValueError("a sample needs at least 2 steps")
    w = Window.partitionBy(*keys)
    c = c.withColumn("__i", F.row_number().over(w.orderBy(value)) - 1).withColumn("__n", F.count("*").over(w))
    step = F.greatest(F.floor(F.col("__n") / (n - 1)), F.lit(1))
    return c.filter((F.col("__n") <= n) | (F.pmod(F.col("__i"), step) == 0) | (F.col("__i") == F.col("__n") - 1)).drop("__i", "__n")


def cdf_get(c: DataFrame, probes: DataFrame, value: str, at: str) -> DataFrame:
    """``probes`` with ``p``: the probability of at most ``at``, 0 below the first step; one distribution.

    An as-of lookup by union and a running maximum, not a range join.
    """
    both = c.select(F.col(value).cast("double").alias("x"), F.lit(0).alias("kind"), F.col("cdf").alias("p0"), F.lit(None).cast(probes.schema[at].dataType).alias(at))
    both = both.unionByName(probes.select(F.col(at).cast("double").alias("x"), F.lit(1).alias("kind"), F.lit(None).cast("double").alias("p0"), F.col(at)))
    run = distributed_running(both, ["x", "kind"], F.coalesce("p0", F.lit(0.0)), "max")
    return run.filter("kind = 1").select(at, F.col("__run").alias("p"))


def cdf_get_pmf(c: DataFrame, probes: DataFrame, value: str, at: str) -> DataFrame:
    """``probes`` with ``p``: the mass at ``at`` where the distribution has it, else the cumulative one below it; one distribution."""
    mass = c.select(F.col(value).cast("double").alias("__x"), F.col("pmf").alias("__m"))
    got = cdf_get(c, probes, value, at)
    return got.join(mass, F.col(at).cast("double") == F.col("__x"), "left").select(at, F.coalesce("__m", "p").alias("p"))


def cdf_moments(c: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, mean, variance, std_dev, total, map): moments over the mass; the most probable value, the last of ties."""
    v, p = F.col(value), F.col("pmf")
    one = c.groupBy(*keys).agg(F.sum(v * p).alias("mean"), F.max("cdf").alias("total"), F.max(F.struct(p, v)).getField(value).alias("map_value"))
    two = c.join(one.select(*keys, "mean"), keys).groupBy(*keys).agg(F.sum((v - F.col("mean")) * (v - F.col("mean")) * p).alias("variance"))
    return one.join(two, keys).withColumn("std_dev", F.sqrt("variance"))


def credible_interval(c: DataFrame, keys: list[str], value: str, width: float) -> DataFrame:
    """(keys, lower, upper): the last value whose cumulative probability does not exceed the lower tail (else the first), and the first that reaches the upper one."""
    if not 0 <= width <= 1:
        raise ValueError("width must be within 0..1")
    tail = (1 - width) / 2
    v, p = F.col(value), F.col("cdf")
    return c.groupBy(*keys).agg(F.coalesce(F.max(F.when(p <= tail + 1e-12, v)), F.min(v)).alias("lower"), F.coalesce(F.min(F.when(p >= 1 - tail - 1e-12, v)), F.max(v)).alias("upper"))


def combinations(n: Column | str, k: Column | str, scale: float = 1.0) -> Column:
    """n over k, each of the k factors scaled; a double."""
    n, k = _c(n), _c(k)
    factor = lambda i: (n - k + i) / i
    out = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1)).cast("int")), F.lit(scale), lambda a, i: a * factor(i.cast("double")))
    return F.when(k > n, 0.0).when(k == 0, scale).otherwise(out)


def combinations_with_repetition(n: Column | str, k: Column | str) -> Column:
    n, k = _c(n), _c(k)
    return combinations(n + k - 1, k)


def bayes_factor(ln_m1: Column | str, ln_m2: Column | str) -> Column:
    return F.exp(_c(ln_m1) - _c(ln_m2))


def kass_raftery(k: Column | str) -> Column:
    """Label of the evidence by the scale of Kass and Raftery."""
    k = _c(k)
    return F.when(k <= 1, "None").when(k <= 3, "Barely").when(k <= 20, "Positive").when(k <= 150, "Strong").when(k > 150, "VeryStrong")


def integrate(spark, density, a: float, b: float, n: int, rule: str = "trapezoid") -> DataFrame:
    """One row ``ln_integral``: a log density, as a function of a grid column, summed over n points by trapezoid or Simpson."""
    if n < 2 or (rule == "simpson" and n % 2 == 0):
        raise ValueError("n must be at least 2, and odd for the rule of Simpson")
    step = (b - a) / (n - 1)
    grid = spark.range(n).withColumn("x", F.lit(a) + F.col("id") * step)
    end = (F.col("id") == 0) | (F.col("id") == n - 1)
    weight = F.when(end, 0.5).otherwise(1.0) if rule == "trapezoid" else F.when(end, 1.0).when(F.pmod(F.col("id"), F.lit(2)) == 1, 4.0).otherwise(2.0) / 3
    terms = grid.select((density(F.col("x")) + F.log(weight)).alias("t"))
    return ln_sum_exp(terms, [], "t", "s").select((F.col("s") + math.log(step)).alias("ln_integral"))


def integrate_grid(df: DataFrame, keys: list[str], x: str, ln_density: str) -> DataFrame:
    """(keys, integral) over given grid points by trapezoid, in log space."""
    w = Window.partitionBy(*keys).orderBy(x)
    both = df.withColumn("__x", F.lag(x).over(w)).withColumn("__d", F.lag(ln_density).over(w)).filter("__x is not null")
    area = ln_add_exp(ln_density, "__d") + F.log((F.col(x) - F.col("__x")) / 2)
    return ln_sum_exp(both.withColumn("__a", area), keys, "__a", "ln_integral")


def interpolate(x: Column | str, x0: Column | str, y0: Column | str, x1: Column | str, y1: Column | str) -> Column:
    """Linear interpolation between two points."""
    x, x0, y0, x1, y1 = map(_c, (x, x0, y0, x1, y1))
    return y0 + (y1 - y0) * (x - x0) / (x1 - x0)


def tabulated(f, lo: float, hi: float, step: float, fallback=None):
    """A function of a column that looks f (a Python function) up in a table over lo..hi and interpolates; outside of it ``fallback``, a function of a column, is used."""
    n = round((hi - lo) / step) + 1
    table = F.array(*[F.lit(float(f(lo + i * step))) for i in range(n)])

    def look(x: Column) -> Column:
        i = F.least(F.floor((x - lo) / step).cast("int"), F.lit(n - 2))
        y0, y1 = F.element_at(table, i + 1), F.element_at(table, i + 2)
        inside = y0 + (y1 - y0) * ((x - lo) / step - i)
        return F.when((x >= lo) & (x <= hi), inside).otherwise(fallback(x) if fallback else F.lit(None).cast("double"))

    return look
