"""Problem 8: filling fixed-capacity containers, by exact-complement hashing.

Sizes are counted in tokens by the workers. What the driver plans on is the histogram of sizes: at most ``capacity``
counters, however many documents there are; ranks within a size are formed by salts whose number follows that of the
documents, and added up where they are. The plan takes sizes from the largest down; for the gap a size leaves it
looks up a single size, then a pair, then a triple whose sum is exactly the gap, and consumes the combination as many
times as the counts allow. What remains is placed best fit. Each step empties a counter or a kind of container, so the
plan has a few thousand lines. A document finds its container by its rank among the documents of its size.

Documents above the capacity, and only these, are split: into full containers of their own and a rest that is packed
like a document.

Defined results: a null or empty text has 0 tokens and no container (-1); a null id is kept; rows with equal ids are
packed separately; ties within a size are ordered by id and then by a hash of the text, so that the same documents fill
the same containers however they are stored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import materialize

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that parts text before the merges of this vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents to a salt, about: as many as may be ranked in one task.
PER_SALT = 100_000
_ENCODINGS: dict[str, object] = {}


class TokenCounter(dict):
    """Token counts of whole texts from counts of their space-separated chunks.

    A token of this vocabulary never runs over a single space into the next chunk, so counts add up; texts with other
    runs of blanks are cut only where a single space stands between visible symbols. Chunks are remembered, up to
    ``keep`` of them.
    """

    def __init__(self, path: str, keep: int = 400_000):
        import tiktoken

        if path not in _ENCODINGS:
            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            _ENCODINGS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode, self.keep = _ENCODINGS[path].encode_ordinary, keep

    def __missing__(self, chunk: str) -> int:
        n = len(self.encode(" " + chunk))
        if len(self) < self.keep:
            self[chunk] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        chunks = text.split(" ")
        if "" in chunks or any(c[0].isspace() or c[-1].isspace() for c in chunks):
            return len(self.encode(text))
        return len(self.encode(chunks[0])) + sum(map(self.__getitem__, chunks[1:]))


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, print, n_tokens), one row per row; ``print`` is a hash of the text."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        counter = TokenCounter(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([counter.count(t) for t in b.column(2).to_pylist()], pa.int64())], ["doc_id", "print", "n_tokens"])

    src = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("print"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"doc_id {id_type}, print bigint, n_tokens bigint")


def pack_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(size, rank from, rank to, first container, items per container) for counts of sizes 1..capacity."""
    c = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        if not 0 < size <= capacity:
            raise ValueError(f"size {size} is not within 1..{capacity}")
        c[size] = n
    used, plan, state = Counter(), [], [0]

    def take(size: int, per: int, base: int, times: int) -> None:
        n = per * times
        plan.append((size, used[size], used[size] + n, base, per))
        used[size] += n
        c[size] -= n

    def exact(parts: list[int]) -> None:
        need = Counter(parts)
        times = min(int(c[s]) // k for s, k in need.items())
        for s, k in need.items():
            take(s, k, state[0], times)
        state[0] += times

    def enough(parts: tuple[int, ...]) -> bool:
        return all(c[s] >= k for s, k in Counter(parts).items())

    def pair(gap: int, top: int) -> tuple[int, int] | None:
        """The pair with the larger part first, at most ``top``."""
        hi = min(gap - 1, top)
        lo = (gap + 1) // 2
        if hi < lo:
            return None
        a = np.arange(hi, lo - 1, -1)
        hit = np.flatnonzero((c[a] > 0) & (c[gap - a] > 0) & ((2 * a != gap) | (c[a] > 1)))
        return (int(a[hit[0]]), gap - int(a[hit[0]])) if len(hit) else None

    if c[capacity]:
        exact([capacity])
    for size in range(capacity - 1, 0, -1):
        gap = capacity - size
        while c[size]:
            parts = None
            if gap <= size and enough((size, gap)):
                parts = (size, gap)
            if not parts and (p := pair(gap, size)) and enough((size, *p)):
                parts = (size, *p)
            if not parts:
                for a in np.flatnonzero(c[: min(size, gap - 2) + 1])[::-1]:
                    a = int(a)
                    if 3 * a < gap:
                        break
                    if (p := pair(gap - a, a)) and enough((size, a, *p)):
                        parts = (size, a, *p)
                        break
            if not parts:
                break
            exact(list(parts))
    # best fit for the rest; kinds[room] holds ranges (first container, how many)
    kinds: dict[int, list[tuple[int, int]]] = {}
    rooms = np.zeros(capacity + 1, bool)

    def put(room: int, base: int, n: int) -> None:
        if n and room:
            kinds.setdefault(room, []).append((base, n))
            rooms[room] = True

    for size in range(capacity, 0, -1):
        while c[size]:
            fit = np.flatnonzero(rooms[size:])
            if len(fit):
                room = size + int(fit[0])
                base, n = kinds[room].pop()
                per = min(room // size, int(c[size]))
                times = min(n, int(c[size]) // per)
                take(size, per, base, times)
                put(room, base + times, n - times)
                if not kinds[room]:
                    rooms[room] = False
                put(room - per * size, base, times)
            else:
                per = min(capacity // size, int(c[size]))
                times = int(c[size]) // per
                take(size, per, state[0], times)
                put(capacity - per * size, state[0], times)
                state[0] += times
    return plan


def fill_containers(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER, per_salt: int = PER_SALT) -> DataFrame:
    """(doc_id, piece_no, tok_start, n_tokens, container_id): where each document, or each piece of an oversized one, goes."""
    spark = df.sparkSession
    sizes = materialize(token_counts(df, id_col, text_col, tokenizer), "p8-sizes")
    salts = 16 + sizes.count() // per_salt  # from the files' footers
    whole = F.floor(F.col("n_tokens") / capacity).cast("bigint")
    rest = F.when(F.col("n_tokens") == capacity, capacity).otherwise(F.col("n_tokens") - whole * capacity)
    items = sizes.withColumn("size", rest.cast("int")).withColumn("salt", F.pmod(F.xxhash64("doc_id", "print"), F.lit(salts)).cast("int"))
    parts = items.filter("size > 0").groupBy("size", "salt").agg(F.count("*").alias("n"))
    counts = parts.groupBy("size").agg(F.sum("n").alias("n")).toArrow()  # at most ``capacity`` rows
    plan = pack_plan(dict(zip(counts.column("size").to_pylist(), counts.column("n").to_pylist())), capacity)
    lines = spark.createDataFrame(plan, "plan_size int, rank_from bigint, rank_to bigint, base bigint, per bigint")
    n_packed = max([b + -(-(t - f) // per) for _, f, t, b, per in plan], default=0)

    earlier = Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("size", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("skip"))
    small = items.filter("size > 0").join(offsets.hint("merge"), ["size", "salt"])
    w = Window.partitionBy("size", "salt").orderBy("doc_id", "print")
    small = small.withColumn("rank", F.col("skip") + F.row_number().over(w) - 1)
    small = small.join(F.broadcast(lines), (F.col("size") == F.col("plan_size")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    big = F.when(F.col("n_tokens") > capacity, F.floor(F.col("n_tokens") / capacity)).otherwise(0)
    small = small.select("doc_id", big.cast("int").alias("piece_no"), (big * capacity).cast("bigint").alias("tok_start"), F.col("size").cast("bigint").alias("n_tokens"), (F.col("base") + F.floor((F.col("rank") - F.col("rank_from")) / F.col("per"))).cast("bigint").alias("container_id"))
    # full containers: numbered behind the packed ones, salt by salt
    full = items.withColumn("k", F.when(F.col("n_tokens") > capacity, whole).otherwise(0)).filter("k > 0")
    before = Window.partitionBy(F.lit(0)).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)  # one row for each salt
    skips = full.groupBy("salt").agg(F.sum("k").alias("n")).select("salt", (F.coalesce(F.sum("n").over(before), F.lit(0)) + n_packed).alias("skip"))
    v = Window.partitionBy("salt").orderBy("doc_id", "print").rowsBetween(Window.unboundedPreceding, -1)
    full = full.join(skips.hint("merge"), "salt").withColumn("base", F.col("skip") + F.coalesce(F.sum("k").over(v), F.lit(0)))
    full = full.select("doc_id", "base", F.explode(F.expr("sequence(0L, k - 1)")).alias("i"))
    full = full.select("doc_id", F.col("i").cast("int").alias("piece_no"), (F.col("i") * capacity).alias("tok_start"), F.lit(capacity).cast("bigint").alias("n_tokens"), (F.col("base") + F.col("i")).alias("container_id"))
    empty = sizes.filter("n_tokens = 0").select("doc_id", F.lit(0).alias("piece_no"), F.lit(0).cast("bigint").alias("tok_start"), F.col("n_tokens"), F.lit(-1).cast("bigint").alias("container_id"))
    return small.unionByName(full).unionByName(empty)


def container_fill(assigned: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(n_items, n_containers, unused): containers by the number of items in them."""
    per = assigned.filter("container_id >= 0").groupBy("container_id").agg(F.count("*").alias("n_items"), F.sum("n_tokens").alias("n"))
    return per.groupBy("n_items").agg(F.count("*").alias("n_containers"), F.sum(F.lit(capacity) - F.col("n")).alias("unused"))
