"""q-gram indexes and seeds as relations: k-mer joins, diagonals, maximal exact matches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.alphabets import chunks, kmers
from strandline.kernels import grams

#: Symbols of a chunk.
CHUNK = 8192
#: Symbols whose q-grams one task joins, about.
BUCKET = 2_000_000


def positions(df: DataFrame, id_col: str, seq_col: str, q: int, max_count: int | None = None) -> DataFrame:
    """(id, pos, gram): one row for each q-gram occurrence; grams that occur more than ``max_count`` times are masked.

    Sequences are cut into overlapping chunks first, so that no row holds the grams of a whole chromosome.
    """
    cut = df.select(F.col(id_col).alias("id"), F.posexplode(chunks(seq_col, CHUNK, q - 1)).alias("chunk", "text"))
    found = cut.select("id", "chunk", F.posexplode(kmers("text", q)).alias("place", "gram"))
    found = found.select("id", (F.col("chunk") * CHUNK + F.col("place")).alias("pos"), "gram")
    if max_count is not None:
        frequent = found.groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") <= max_count).select("gram")
        found = found.join(frequent, "gram", "left_semi").select("id", "pos", "gram")
    return found


def gram_counts(df: DataFrame, id_col: str, seq_col: str, q: int) -> DataFrame:
    """(gram, n, n_records)."""
    per = positions(df, id_col, seq_col, q).groupBy("gram", "id").agg(F.count("*").alias("n"))
    return per.groupBy("gram").agg(F.sum("n").alias("n"), F.count("*").alias("n_records"))


def kmer_matches(x: DataFrame, y: DataFrame, q: int, max_count: int | None = None) -> DataFrame:
    """(x_id, y_id, x, y): all pairs of places with one q-gram. Both inputs are (id, seq).

    q-grams travel as runs of neighbours to the task of their bucket, which puts out the pairs in bounded batches. No side
    is ever broadcast: a plan takes the size of the q-grams for that of the compressed table.
    """
    if max_count is not None:
        a = positions(x, "id", "seq", q, max_count).select(F.col("id").alias("x_id"), F.col("pos").alias("x"), "gram")
        b = positions(y, "id", "seq", q, max_count).select(F.col("id").alias("y_id"), F.col("pos").alias("y"), "gram")
        return a.hint("shuffle_merge").join(b, "gram").drop("gram")
    if q < 1:
        raise ValueError("q must be positive")
    sides = [s.select("id", "seq").filter("seq is not null") for s in (x, y)]
    total = sum(s.agg(F.sum(F.length("seq"))).first()[0] or 0 for s in sides)
    spark = x.sparkSession
    cores = spark.sparkContext.defaultParallelism
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), cores, -(-total // BUCKET))

    def cut(is_x: bool):
        def run(batches):
            for b in batches:
                for bucket, runs, width, symbols in grams.runs(b.column(0), b.column(1), q, buckets):
                    yield pa.RecordBatch.from_pydict({"bucket": [bucket], "is_x": [is_x], "runs": [runs], "width": [width], "symbols": [symbols]}, schema)

        return run

    def join(batches):
        parts: dict[bool, list] = {True: [], False: []}
        for b in batches:
            for _, is_x, runs, width, symbols in zip(*(c.to_pylist() for c in b.columns)):
                parts[is_x].append((runs, width, symbols))
        yield from grams.pairs(parts[True], parts[False], q)

    schema = pa.schema([("bucket", pa.int32()), ("is_x", pa.bool_()), ("runs", pa.binary()), ("width", pa.int32()), ("symbols", pa.binary())])
    few = [s if s.rdd.getNumPartitions() >= cores else s.repartition(buckets) for s in sides]
    a, b = (s.mapInArrow(cut(k == 0), "bucket int, is_x boolean, runs binary, width int, symbols binary") for k, s in enumerate(few))
    kinds = [s.schema["id"].dataType.simpleString() for s in sides]
    return a.union(b).repartitionById(buckets, F.col("bucket")).mapInArrow(join, f"x_id {kinds[0]}, y_id {kinds[1]}, x int, y int")


def diagonal_matches(hits: DataFrame, q: int, min_count: int) -> DataFrame:
    """(x_id, y_id, diag, x_start, x_stop, y_start, y_stop, n): hits of one diagonal y - x, first to last, where there are enough."""
    d = hits.withColumn("diag", F.col("y") - F.col("x")).groupBy("x_id", "y_id", "diag")
    out = d.agg(F.min("x").alias("x_start"), (F.max("x") + q).alias("x_stop"), F.min("y").alias("y_start"), (F.max("y") + q).alias("y_stop"), F.count("*").alias("n"))
    return out.filter(F.col("n") >= min_count)


def exact_matches(hits: DataFrame, q: int) -> DataFrame:
    """(x_id, y_id, x_start, x_stop, y_start, y_stop): maximal exact matches of at least q symbols, islands of hits that follow one another."""
    w = Window.partitionBy("x_id", "y_id", "diag").orderBy("x")
    h = hits.withColumn("diag", F.col("y") - F.col("x")).withColumn("island", F.col("x") - F.row_number().over(w))
    return h.groupBy("x_id", "y_id", "diag", "island").agg(F.min("x").alias("x_start"), (F.max("x") + q).alias("x_stop"), F.min("y").alias("y_start"), (F.max("y") + q).alias("y_stop")).drop("diag", "island")
