"""GC content and open reading frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.alphabets import kmers


def gc_content(c: Column | str) -> Column:
    """Share of G and C among all symbols, N and others included; NaN for an empty text."""
    c = F.col(c) if isinstance(c, str) else c
    n = F.length(c)
    return F.when(n == 0, F.lit(float("nan"))).otherwise(F.length(F.regexp_replace(c, "[^GCgc]", "")) / n)


def gc3_content(c: Column | str) -> Column:
    """The same over symbols 0, 3, 6, ..."""
    c = F.col(c) if isinstance(c, str) else c
    return gc_content(F.regexp_replace(c, r"(?s)(.).{0,2}", "$1"))


def find_orfs(df: DataFrame, id_col: str, seq_col: str, starts: list[str] = ("ATG",), stops: list[str] = ("TGA", "TAG", "TAA"), min_len: int = 0) -> DataFrame:
    """(id, start, end, offset): every start codon with the next stop in its frame, where more than ``min_len`` symbols
    lie between the last base of the start and the end.

    Only start and stop codons are exploded; the next stop comes from one window per record and frame.
    """
    codons = F.filter(F.transform(kmers("seq", 3), lambda c, i: F.struct(i.alias("pos"), c.alias("codon"))), lambda x: x["codon"].isin(*starts, *stops))
    hits = df.select(F.col(id_col).alias("id"), F.col(seq_col).alias("seq")).filter(F.length("seq") >= 3).select("id", F.explode(codons).alias("c")).select("id", "c.pos", "c.codon")
    hits = hits.withColumn("offset", F.pmod(F.col("pos"), F.lit(3)))
    ahead = Window.partitionBy("id", "offset").orderBy("pos").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    hits = hits.withColumn("stop", F.min(F.when(F.col("codon").isin(*stops), F.col("pos"))).over(ahead))
    out = hits.filter(F.col("codon").isin(*starts) & F.col("stop").isNotNull()).select("id", F.col("pos").alias("start"), (F.col("stop") + 3).alias("end"), "offset")
    return out.filter(F.col("end") - F.col("start") - 2 > min_len)
