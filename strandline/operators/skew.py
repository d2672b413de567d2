"""Problem 5: a few keys holding most records, by fragment-replicate on estimated load.

Loads are counted per key with map-side partial sums. Keys above the load of one task are cut into shards in
proportion; keys of at least a sixteenth of it are packed into tasks, largest first, each into the task with the least
load; smaller ones are hashed into buckets, and these packed into what room is left. Only the first two kinds are ever held by the driver: at most 17 x tasks keys,
however many names the data has. Rows are then sent to the task they were given, by its number and not by a hash, so
that every task has about the same load. Per-key results are formed per shard and put together from the shards'
results; in a join the matching side is replicated to the tasks of cut keys and to no other.

Defined results: a null key takes no part in joins and per-key results but counts as a row of its table; keys that tie
are ordered by name; repeated rows count each; an empty table has no loads and gives no rows; the added columns start
with ``__`` and clash with no column of the inputs, which are otherwise passed through.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.periods import merge_intervals

HOT_SHARE = 0.04
#: Buckets of small keys for each task.
BUCKETS = 16


def key_loads(df: DataFrame, key: str) -> DataFrame:
    """(key, load): rows per key, those of a null key included; one partial sum per key and map task is shuffled."""
    return df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("load"))


def pack_keys(loads: list[tuple[object, int]], total: int, tasks: int) -> tuple[list[tuple[object, int, int]], list[int]]:
    """(key, first task, shards) for the given large keys, and the task of each bucket of small ones.

    Shards of a key follow one another, modulo ``tasks``. Buckets share what the large keys leave of the total.
    """
    target = max(1.0, total / tasks)
    out, at, base = [], 0, [0.0] * tasks
    ordered = sorted(loads, key=lambda x: (-x[1], str(x[0])))
    for key, load in ordered:
        shards = min(tasks, math.ceil(load / target))
        if shards > 1:
            out.append((key, at % tasks, shards))
            for i in range(shards):
                base[(at + i) % tasks] += load / shards
            at += shards
    heap = [(b, t) for t, b in enumerate(base)]
    heapq.heapify(heap)

    def least(load: float) -> int:
        b, t = heapq.heappop(heap)
        heapq.heappush(heap, (b + load, t))
        return t

    out += [(key, least(load), 1) for key, load in ordered if load <= target]
    rest = max(1.0, (total - sum(load for _, load in loads)) / (BUCKETS * tasks))
    return out, [least(rest) for _ in range(BUCKETS * tasks)]


def task_count(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)


@dataclass
class Plan:
    """Where keys go: ``keys`` is a table (__key, __first, __shards) of those that are cut or packed, ``buckets`` has the task of each bucket of the others."""

    keys: DataFrame
    buckets: list[int]
    tasks: int

    def task(self, key: Column, shard: Column) -> Column:
        table = F.split(F.lit(",".join(map(str, self.buckets))), ",").cast("array<int>")  # folded into one constant
        bucket = F.element_at(table, F.pmod(F.xxhash64(key), F.lit(len(self.buckets))).cast("int") + 1)
        return F.when(F.col("__key").isNotNull(), F.pmod(F.col("__first") + shard, F.lit(self.tasks))).otherwise(bucket).cast("int")


def shard_plan(df: DataFrame, key: str, tasks: int) -> Plan:
    total = df.count()
    large = key_loads(df, key).filter((F.col("load") * (16 * tasks) >= total) & F.col("key").isNotNull()).collect()  # at most 16 x tasks
    keys, buckets = pack_keys([(r.key, r.load) for r in large], total, tasks)
    return Plan(df.sparkSession.createDataFrame(keys, f"__key {df.schema[key].dataType.simpleString()}, __first int, __shards int"), buckets, tasks)


def with_tasks(df: DataFrame, key: str, plan: Plan, spread: Column) -> DataFrame:
    """``df`` with ``__shard`` and ``__task``; ``spread`` is any column by which rows of a cut key may be told apart."""
    out = df.join(F.broadcast(plan.keys), F.col(key) == F.col("__key"), "left")
    shard = F.when(F.col("__shards") > 1, F.pmod(F.xxhash64(spread), F.col("__shards"))).otherwise(0).cast("int")
    out = out.withColumn("__shard", shard)
    return out.withColumn("__task", plan.task(F.col(key), F.col("__shard"))).drop("__key", "__first", "__shards")


def fragment(df: DataFrame, key: str, spread: Column, tasks: int | None = None) -> DataFrame:
    """The rows that have a key, each in the task of its key's shard, with ``__task`` and ``__shard``.

    What is grouped by ``__task`` and more columns afterwards stays where it is.
    """
    tasks = tasks or task_count(df)
    df = df.filter(F.col(key).isNotNull())
    rows = with_tasks(df, key, shard_plan(df, key, tasks), spread)
    return rows.repartitionById(tasks, F.col("__task"))


def per_key(df: DataFrame, key: str, spread: Column, aggs: dict[str, tuple[Column, Callable[[str], Column]]], tasks: int | None = None) -> DataFrame:
    """(key, one column for each aggregate): first per shard, in its task, then over the shards of each key.

    ``aggs`` names for each output the aggregate of a shard's rows and the function that puts shards' results together.
    """
    shards = fragment(df, key, spread, tasks).groupBy("__task", key, "__shard").agg(*[a.alias(n) for n, (a, _) in aggs.items()])
    return shards.groupBy(key).agg(*[f(n).alias(n) for n, (_, f) in aggs.items()])


def hot_keys(df: DataFrame, key: str, spread: Column, share: float = HOT_SHARE, tasks: int | None = None) -> DataFrame:
    """(key, load, share) of the keys that hold at least ``share`` of the rows, those of a null key included: at most 1 / share of them."""
    total = df.count()  # from the files' footers where nothing is filtered
    counts = per_key(df.select(F.col(key).alias("key"), spread.alias("__spread")), "key", F.col("__spread"), {"load": (F.count("*"), F.sum)}, tasks)
    return counts.filter(F.col("load") >= total * share - 1e-9).select("key", "load", (F.col("load") / F.lit(total)).alias("share"))


def covered_length(df: DataFrame, key: str, start: str, end: str, spread: Column, tasks: int | None = None) -> DataFrame:
    """(key, covered): symbols that the union of the key's intervals covers; keys without a valid interval have no row.

    Shards merge their own intervals; what is left of each, far fewer rows, is merged over the shards.
    """
    rows = fragment(df.filter(F.col(end) > F.col(start)).select(F.col(key).alias("key"), F.col(start).alias("s"), F.col(end).alias("e"), spread.alias("__spread")), "key", F.col("__spread"), tasks)
    w = Window.partitionBy("__task", "key", "__shard").orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__new", (reach.isNull() | (F.col("s") > reach)).cast("int"))
    rows = rows.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = rows.groupBy("__task", "key", "__shard", "__island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return merge_intervals(merged, ["key"], "s", "e").groupBy(F.col("k0").alias("key")).agg(F.sum(F.col("span_end") - F.col("span_start")).alias("covered"))


def fragment_replicate_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, spread: Column, also: list[tuple[str, str]] = (), tasks: int | None = None) -> DataFrame:
    """Inner join on the key and on further pairs of columns; rows of ``left`` are sharded, matching ones of ``right`` replicated."""
    tasks = tasks or task_count(left)
    left = left.filter(F.col(left_key).isNotNull())
    plan = shard_plan(left, left_key, tasks)
    frag = with_tasks(left, left_key, plan, spread).repartitionById(tasks, F.col("__task"))
    rep = right.filter(F.col(right_key).isNotNull()).join(F.broadcast(plan.keys), F.col(right_key) == F.col("__key"), "left")
    rep = rep.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__shards"), F.lit(1)) - 1)))
    rep = rep.withColumn("__at", plan.task(F.col(right_key), F.col("__copy"))).drop("__key", "__first", "__shards", "__copy").repartitionById(tasks, F.col("__at"))
    on = (frag["__task"] == rep["__at"]) & (frag[left_key] == rep[right_key])  # the shards of a key are in different tasks
    for a, b in also:
        on = on & (frag[a] == rep[b])
    return frag.join(rep.hint("merge"), on).drop("__shard", "__task", "__at")


def top_per_key(df: DataFrame, key: str, order: list[Column], k: int, spread: Column, tasks: int | None = None) -> DataFrame:
    """The first ``k`` rows of each key, with ``__rank`` from 1: first within shards, then among the shards' winners."""
    rows = fragment(df, key, spread, tasks)
    inner = Window.partitionBy("__task", key, "__shard").orderBy(*order)
    rows = rows.withColumn("__rank", F.row_number().over(inner)).filter(F.col("__rank") <= k)
    outer = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__rank", F.row_number().over(outer)).filter(F.col("__rank") <= k).drop("__shard", "__task")
