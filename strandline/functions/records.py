"""Record fields, conversions and text forms of the sequence and annotation formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_newline(c: Column | str) -> Column:
    """Without one trailing newline."""
    c = _c(c)
    return F.when(F.endswith(c, F.lit("\n")), F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c)


def fasta_text(id_: Column | str, descr: Column | str, seq: Column | str, wrap: int | None = None) -> Column:
    """``>id[ descr]`` and the sequence, in lines of ``wrap`` symbols where given; no line for an empty wrapped one."""
    head = F.concat(F.lit(">"), _c(id_), F.coalesce(F.concat(F.lit(" "), _c(descr)), F.lit("")), F.lit("\n"))
    s = _c(seq)
    body = F.concat(s, F.lit("\n")) if wrap is None else F.regexp_replace(s, f"(.{{1,{wrap}}})", "$1\n")
    return F.concat(head, body)


def fastq_text(id_: Column | str, descr: Column | str, seq: Column | str, qual: Column | str) -> Column:
    head = F.concat(F.lit("@"), _c(id_), F.coalesce(F.concat(F.lit(" "), _c(descr)), F.lit("")))
    return F.concat(head, F.lit("\n"), _c(seq), F.lit("\n+\n"), _c(qual), F.lit("\n"))


def bed_text(*fixed: Column | str, aux: Column | str) -> Column:
    """Tab separated; aux columns follow the fixed ones. A null fixed column makes the line null, a null aux none, a null aux cell an empty one."""
    parts = [F.lit("\t") if i % 2 else _c(fixed[i // 2]).cast("string") for i in range(2 * len(fixed) - 1)]
    rest = F.array_join(F.transform(_c(aux), lambda x: F.concat(F.lit("\t"), F.coalesce(x, F.lit("")))), "")
    return F.concat(*parts, F.coalesce(rest, F.lit("")))


def aux_field(aux: Column | str, column: int, fixed: int) -> Column:
    """The column of the line (from 0) among the auxiliary ones; null where absent."""
    return F.try_element_at(_c(aux), F.lit(column - fixed + 1))


def bed_name(aux: Column | str) -> Column:
    return aux_field(aux, 3, 3)


def bed_score(aux: Column | str) -> Column:
    return aux_field(aux, 4, 3)


def bed_strand(aux: Column | str) -> Column:
    s = aux_field(aux, 5, 3)
    return F.when(s.isin("+", "-"), s)


def bedpe_name(aux: Column | str) -> Column:
    return aux_field(aux, 6, 6)


def bedpe_score(aux: Column | str) -> Column:
    return aux_field(aux, 7, 6)


def bedpe_strand1(aux: Column | str) -> Column:
    s = aux_field(aux, 8, 6)
    return F.when(s.isin("+", "-"), s)


def bedpe_strand2(aux: Column | str) -> Column:
    s = aux_field(aux, 9, 6)
    return F.when(s.isin("+", "-"), s)


def set_aux(aux: Column | str, column: int, fixed: int, value: Column) -> Column:
    """aux with the column of the line set; slots before it that are missing become empty texts."""
    a = F.coalesce(_c(aux), F.array().cast("array<string>"))
    i = column - fixed
    padded = F.concat(a, F.array_repeat(F.lit(""), F.greatest(F.lit(i + 1) - F.size(a), F.lit(0))))
    return F.transform(padded, lambda x, k: F.when(k == i, value).otherwise(x))


def push_aux(aux: Column | str, value: Column) -> Column:
    return F.concat(F.coalesce(_c(aux), F.array().cast("array<string>")), F.array(value))


def point_to_bed(chrom: Column | str, pos: Column | str, strand: Column | str, name: Column) -> Column:
    """struct of a BED row for one position."""
    return F.struct(_c(chrom).alias("chrom"), _c(pos).alias("start"), (_c(pos) + 1).alias("end"), F.array(name, F.lit("0"), _c(strand)).alias("aux"))


def contig_to_bed(chrom: Column | str, start: Column | str, length: Column | str, strand: Column | str, name: Column) -> Column:
    return F.struct(_c(chrom).alias("chrom"), _c(start).alias("start"), (_c(start) + _c(length)).alias("end"), F.array(name, F.lit("0"), _c(strand)).alias("aux"))


def points_to_bedpe(chrom1: Column | str, pos1: Column | str, strand1: Column | str, chrom2: Column | str, pos2: Column | str, strand2: Column | str, name: Column) -> Column:
    """struct of a BEDPE row for two positions."""
    a, b = _c(pos1), _c(pos2)
    return F.struct(_c(chrom1).alias("chrom1"), a.alias("start1"), (a + 1).alias("end1"), _c(chrom2).alias("chrom2"), b.alias("start2"), (b + 1).alias("end2"), F.array(name, F.lit("0"), _c(strand1), _c(strand2)).alias("aux"))


def spliced_to_bed12(chrom: Column | str, exons: Column | str, strand: Column | str, name: Column) -> Column:
    """The 12-column form of an array of (start, end) exons in ascending order, with thick ends at the whole span."""
    e = _c(exons)
    start, end = e[0]["start"], F.element_at(e, -1)["end"]
    sizes = F.concat(F.array_join(F.transform(e, lambda x: (x["end"] - x["start"]).cast("string")), ","), F.lit(","))
    starts = F.concat(F.array_join(F.transform(e, lambda x: (x["start"] - start).cast("string")), ","), F.lit(","))
    aux = F.array(name, F.lit("0"), _c(strand), start.cast("string"), end.cast("string"), F.lit("0"), F.size(e).cast("string"), sizes, starts)
    return F.struct(_c(chrom).alias("chrom"), start.alias("start"), end.alias("end"), aux.alias("aux"))


def gff_score(score: Column | str) -> Column:
    """A whole number that is not negative, or null (``.``, fractions and texts)."""
    s = _c(score)
    return F.when(s.rlike(r"^\+?[0-9]+$"), s.try_cast("bigint"))


def gff_strand(strand: Column | str) -> Column:
    s = _c(strand)
    return F.when(s.isin("+", "-"), s)


def parse_phase(phase: Column | str) -> Column:
    """``.`` is null, 0 to 2 a byte, anything else an error."""
    p = _c(phase)
    return F.when(p.isNull() | (p == "."), F.lit(None).cast("tinyint")).when(p.isin("0", "1", "2"), p.try_cast("tinyint")).otherwise(F.raise_error(F.concat(F.lit("invalid phase: "), p)).cast("tinyint"))


def phase_text(phase: Column | str) -> Column:
    return F.coalesce(_c(phase).cast("string"), F.lit("."))


def gff3_encode(c: Column | str) -> Column:
    """Percent-encode ``% ; = & ,`` and control characters; blanks stay."""
    out = _c(c)
    for ch in "%;=&,":
        out = F.replace(out, F.lit(ch), F.lit(f"%{ord(ch):02X}"))
    for i in [*range(32), 127]:
        out = F.replace(out, F.lit(chr(i)), F.lit(f"%{i:02X}"))
    return out


def trim_quotes(c: Column | str) -> Column:
    """Without any surrounding quotes of either kind."""
    return F.regexp_replace(_c(c), "^[\"']+|[\"']+$", "")


def fai_offset(byte_offset: Column | str, line_bases: Column | str, line_bytes: Column | str, start: Column | str) -> Column:
    """The byte at which a base stands in an indexed file."""
    s, lb = _c(start), _c(line_bases)
    return _c(byte_offset) + F.floor(s / lb).cast("bigint") * _c(line_bytes) + F.pmod(s, lb)


def fetch(seq: Column | str, start: Column | str, stop: Column | str) -> Column:
    """Symbols start..stop (half-open) of a sequence; a stop beyond the end or below the start is an error."""
    s, a, b = _c(seq), _c(start), _c(stop)
    return (
        F.when(b > F.length(s), F.raise_error(F.lit("FASTA read interval was out of bounds")).cast("string"))
        .when(a > b, F.raise_error(F.lit("Invalid query interval")).cast("string"))
        .otherwise(F.substring(s, (a + 1).cast("int"), (b - a).cast("int")))
    )


def symbol_at(seq: Column | str, i: Column) -> Column:
    """The symbol at a place from 0; null beyond the end."""
    return F.nullif(F.substring(_c(seq), (i + 1).cast("int"), F.lit(1)), F.lit(""))


def quality_at(qual: Column | str, i: Column, offset: int = 33) -> Column:
    """The quality at a place from 0, as a number; null beyond the end."""
    return F.ascii(symbol_at(qual, i)) - offset


def fill_qual(seq: Column | str, q: str) -> Column:
    """A constant quality string for a sequence."""
    return F.repeat(F.lit(q), F.length(_c(seq)))


def fastx_kind(first: Column | str) -> Column:
    """``fasta`` or ``fastq`` by the first symbol of a text; empty and other texts are errors."""
    c = _c(first)
    return F.when(F.startswith(c, F.lit(">")), "fasta").when(F.startswith(c, F.lit("@")), "fastq").when(F.length(c) == 0, F.raise_error(F.lit("unexpected end of file")).cast("string")).otherwise(F.raise_error(F.lit("invalid data: neither FASTA nor FASTQ")).cast("string"))
