"""Validity of records, probabilities and intervals: the first rule that fails, or null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NOT_ASCII, _NOT_SEQ = r"[^\x00-\x7F]", r"[^A-Za-z\-.*]"


def fasta_check(id_: Column | str, seq: Column | str) -> Column:
    i, s = (F.col(c) if isinstance(c, str) else c for c in (id_, seq))
    return (
        F.when(F.coalesce(i, F.lit("")) == "", "EmptyId")
        .when(F.coalesce(s, F.lit("")).rlike(_NOT_ASCII), "NonAsciiSequence")
        .when(F.coalesce(s, F.lit("")).rlike(_NOT_SEQ), "InvalidCharacters")
    )


def fastq_check(id_: Column | str, seq: Column | str, qual: Column | str) -> Column:
    s, q = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in (seq, qual))
    return F.coalesce(fasta_check(id_, seq), F.when(q.rlike(_NOT_ASCII), "NonAsciiQuality").when(F.length(s) != F.length(q), "UnequalLengths"))


def is_empty_record(id_: Column | str, seq: Column | str) -> Column:
    """No id, no description and no sequence came in: an id and a sequence that are both empty."""
    i, s = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in (id_, seq))
    return (i == "") & (s == "")


def checked_prob(p: Column | str) -> Column:
    """p where it lies within 0..1; anything else is an error."""
    p = F.col(p) if isinstance(p, str) else p
    return F.when(p.isNull() | ((p >= 0) & (p <= 1) & ~F.isnan(p)), p).otherwise(F.raise_error(F.concat(F.lit("invalid probability: "), p.cast("string"))).cast("double"))


def valid_ln_prob(ln_p: Column | str) -> Column:
    p = F.col(ln_p) if isinstance(ln_p, str) else ln_p
    return (p <= 0) & ~F.isnan(p)


def valid_interval(start: Column | str, end: Column | str) -> Column:
    s, e = (F.col(c) if isinstance(c, str) else c for c in (start, end))
    return e >= s


def checked_interval(start: Column | str, end: Column | str) -> Column:
    """struct(start, end); an end below the start is an error."""
    s, e = (F.col(c) if isinstance(c, str) else c for c in (start, end))
    return F.when(e >= s, F.struct(s.alias("start"), e.alias("end"))).otherwise(F.raise_error(F.lit("invalid interval: end below start")).cast("struct<start:bigint,end:bigint>"))
