"""Line formats read and written inside the JVM: FASTA in splits, .fai, BED, BEDPE, GFF and GTF, Newick trees.

The text reader cuts files into splits at record borders, so a file of any size is read by many tasks.
"""

from __future__ import annotations

import io
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from strandline.functions import records
from strandline.operators.packed import percent_decode

#: Separators by GFF type: between key and value, between attributes, between values (fixed values).
GFF_TYPES = {"gff3": ("=", ";", ","), "gff2": (" ", ";", None), "gtf2": (" ", ";", None)}


def read_fasta(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """(id, descr, seq). Records are split at ``\\n>``; the header parts at its first white space.

    A file that does not begin with ``>`` is an error.
    """
    reader = spark.readStream if streaming else spark.read
    raw = reader.option("lineSep", "\n>").text(path)
    body = F.regexp_replace("value", "^>", "")
    head = F.regexp_replace(F.regexp_extract(body, r"^([^\n]*)", 1), r"\s+$", "")
    seq = F.regexp_replace(F.regexp_replace(body, r"^[^\n]*\n?", ""), r"[ \t\r]*(\n|$)", "")
    descr = F.regexp_extract(head, r"^\S*\s(.*)$", 1)
    return raw.filter(F.trim("value") != "").select(F.regexp_extract(head, r"^(\S*)", 1).alias("id"), F.when(head.rlike(r"^\S*\s"), descr).alias("descr"), seq.alias("seq"))


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="name string, len bigint, byte_offset bigint, line_bases bigint, line_bytes bigint")


def index_fasta(seqs: DataFrame, fai: DataFrame, regions: DataFrame) -> DataFrame:
    """(name, start, stop, at_byte, seq) of regions by name; a stop beyond the end and a start beyond the stop are errors."""
    at = records.fai_offset("byte_offset", "line_bases", "line_bytes", "start")
    found = regions.join(fai, "name").join(seqs.select(F.col("id").alias("name"), F.col("seq").alias("__s")), "name")
    return found.select("name", "start", "stop", at.alias("at_byte"), records.fetch("__s", "start", "stop").alias("seq"))


def build_fai(spark: SparkSession, path: str) -> DataFrame:
    """(path, rid, name, len, byte_offset, line_bases, line_bytes): the index of every file of a path, records numbered from 0 in each.

    A file is one task that holds a line at a time. Lines of one record must be of one length, but for the last.
    """
    import pyarrow as pa

    from strandline.sources import formats

    files = formats.list_files(path)
    columns = ["path", "rid", "name", "len", "byte_offset", "line_bases", "line_bytes"]

    def index(file: str):
        system, p = formats._fs(file)
        with system.open_input_stream(p) as raw:
            rid, at, record, short = -1, 0, None, False
            for line in io.BufferedReader(raw, 1 << 20):
                at += len(line)
                if line.startswith(b">"):
                    if record:
                        yield record
                    rid, short = rid + 1, False
                    record = [file, rid, line[1:].split(None, 1)[0].decode() if line[1:].split() else "", 0, at, 0, 0]
                elif record is None:
                    raise formats.FormatError("a record must begin with >")
                elif bases := len(line.rstrip(b"\r\n")):
                    if short or (record[5] and bases > record[5]):
                        raise formats.FormatError(f"lines of {record[2]} are of different length")
                    if not record[5]:
                        record[5:] = [bases, len(line)]
                    short = bases < record[5]
                    record[3] += bases
            if record:
                yield record

    def run(batches):
        for b in batches:
            for file in b.column(0).to_pylist():
                rows = list(index(file))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string() if k in (0, 2) else pa.int64()) for k in range(7)], columns)

    src = spark.createDataFrame([(f,) for f in files], "path string").repartition(max(1, len(files)))
    return src.mapInArrow(run, "path string, rid bigint, name string, len bigint, byte_offset bigint, line_bases bigint, line_bytes bigint")


def fetch_regions(index: DataFrame, regions: DataFrame, by: str = "name") -> DataFrame:
    """``regions`` with ``seq``: symbols start..stop of the record with that ``name`` (or ``rid``), read from its place in the file.

    A null start is 0, a null stop the record's end. Only the bytes of a region are read. A record that is not in the index, a
    stop beyond the end and a start beyond the stop are errors.
    """
    import pyarrow as pa

    from strandline.sources import formats

    place = index.select(F.col(by).alias("__by"), F.col("path").alias("__path"), F.col("len").alias("__len"), "byte_offset", "line_bases", "line_bytes")
    found = regions.join(place, F.col(by) == F.col("__by"), "left").drop("__by")
    start, stop = F.coalesce("start", F.lit(0)), F.coalesce("stop", "__len")
    bad = F.when(F.col("__path").isNull(), F.lit("no such record in the index")).when(stop > F.col("__len"), F.lit("the interval reaches beyond the record")).when(start > stop, F.lit("the interval ends before it starts"))
    stop = F.when(bad.isNull(), stop).otherwise(F.raise_error(bad).cast("bigint"))
    lines = F.greatest("line_bases", F.lit(1))
    found = found.withColumn("__from", records.fai_offset("byte_offset", lines, "line_bytes", start)).withColumn("__n", stop - start)
    found = found.withColumn("__to", records.fai_offset("byte_offset", lines, "line_bytes", stop))
    names = regions.columns

    def run(batches):
        opened: dict = {}
        for b in batches:
            out = []
            for path, a, z, n in zip(*(b.column(k).to_pylist() for k in ("__path", "__from", "__to", "__n"))):
                if path not in opened:
                    for f in opened.values():
                        f.close()
                    system, p = formats._fs(path)
                    opened = {path: system.open_input_file(p)}
                file = opened[path]
                raw = file.read_at(min(z, file.size()) - a, a) if n else b""
                out.append(raw.translate(None, b"\r\n").decode()[:n])
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in names), pa.array(out, pa.string())], [*names, "seq"])

    order = found.select(*names, "__path", "__from", "__to", "__n").repartition("__path", F.floor(F.col("__from") / (64 << 20))).sortWithinPartitions("__path", "__from")
    return order.mapInArrow(run, StructType([*regions.schema.fields, StructField("seq", StringType())]))


def _fields(spark: SparkSession, path: str, streaming: bool) -> DataFrame:
    raw = (spark.readStream if streaming else spark.read).text(path)
    line = F.regexp_replace("value", r"\r$", "")
    return raw.filter(~F.startswith("value", F.lit("#")) & (line != "")).select(F.split(line, "\t").alias("f"))


def _long(i: int) -> Column:
    """A field that must be a whole number."""
    return F.col("f")[i].cast("bigint")


def _rest(n: int) -> Column:
    return F.slice("f", n + 1, F.greatest(F.size("f") - n, F.lit(0)))


def read_bed(spark: SparkSession, path: str, streaming: bool = False, extra: list[tuple[str, str]] = ()) -> DataFrame:
    """(chrom, start_pos, end_pos, aux). ``extra`` names and types further columns of the BED family, taken from aux in order."""
    b = _fields(spark, path, streaming).select(F.col("f")[0].alias("chrom"), _long(1).alias("start_pos"), _long(2).alias("end_pos"), _rest(3).alias("aux"))
    for i, (name, kind) in enumerate(extra):
        b = b.withColumn(name, F.try_element_at("aux", F.lit(i + 1)).try_cast(kind))
    return b


def read_bedpe(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Fields that the format marks as not known, ``.`` for a name and -1 for a place, are null."""
    b = _fields(spark, path, streaming).select(F.col("f")[0].alias("chrom1"), _long(1).alias("start1"), _long(2).alias("end1"), F.col("f")[3].alias("chrom2"), _long(4).alias("start2"), _long(5).alias("end2"), _rest(6).alias("aux"))
    return b.select(*[F.nullif(F.col(c), F.lit("." if c.startswith("chrom") else -1)).alias(c) for c in ("chrom1", "start1", "end1", "chrom2", "start2", "end2")], "aux")


def gff_separators(kind: str | tuple[str, str, str | None]) -> tuple[str, str, str | None]:
    """Those of a named type, or three of one's own: between key and value, between attributes, between values (or None)."""
    if isinstance(kind, tuple):
        return kind
    if kind not in GFF_TYPES:
        raise ValueError(f"{kind!r} is no known version of the GFF format: {', '.join(GFF_TYPES)}")
    return GFF_TYPES[kind]


def parse_attributes(c: Column | str, kind: str | tuple[str, str, str | None]) -> Column:
    """map of key to values. GFF3 splits values at commas and decodes them; values of the others lose all quotes around them."""
    c = F.col(c) if isinstance(c, str) else c
    delim, end, values = gff_separators(kind)
    one = (lambda v: percent_decode(v)) if kind == "gff3" else (lambda v: records.trim_quotes(v))
    parts = F.filter(F.transform(F.split(c, re.escape(end)), lambda x: F.trim(x)), lambda x: x != "")

    def pair(x: Column) -> Column:
        at = F.position(F.lit(delim), x)
        key = F.when(at > 0, F.left(x, at - 1)).otherwise(x)
        val = F.when(at > 0, F.trim(F.substring(x, at + 1, F.length(x)))).otherwise(F.lit(""))
        vals = F.transform(F.split(val, re.escape(values)) if values else F.array(val), one)
        return F.struct(key.alias("k"), vals.alias("v"))

    pairs = F.transform(parts, pair)
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.when(c.isNull(), F.lit(None).cast("map<string,array<string>>")).otherwise(F.map_from_arrays(keys, F.transform(keys, lambda k: F.flatten(F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"])))))


def read_gff(spark: SparkSession, path: str, kind: str | tuple[str, str, str | None] = "gff3", streaming: bool = False) -> DataFrame:
    """The nine columns, score and strand as texts, phase as a number, attributes as a map. ``kind``: a version or separators of one's own."""
    gff_separators(kind)
    f = _fields(spark, path, streaming)
    cols = [F.col("f")[0].alias("seqname"), F.col("f")[1].alias("source"), F.col("f")[2].alias("feature_type"), _long(3).alias("start_pos"), _long(4).alias("end_pos"), F.col("f")[5].alias("score"), F.col("f")[6].alias("strand")]
    return f.select(*cols, records.parse_phase(F.col("f")[7]).alias("phase"), parse_attributes(F.col("f")[8], kind).alias("attributes"))


def gff_text(df: DataFrame, kind: str | tuple[str, str, str | None] = "gff3") -> Column:
    """The line of each row; all values of a key are written, in one list where the type separates values. A null column is ``.``."""
    delim, end, values = gff_separators(kind)
    code = (lambda v: F.regexp_replace(records.gff3_encode(v), "^ | $", "%20")) if kind == "gff3" else (lambda v: F.concat(F.lit('"'), v, F.lit('"')))

    def entry(e: Column) -> Column:
        if values:
            return F.concat(e["key"], F.lit(delim), F.array_join(F.transform(e["value"], code), values))
        return F.array_join(F.transform(e["value"], lambda v: F.concat(e["key"], F.lit(delim), code(v))), end)

    attrs = F.nullif(F.array_join(F.transform(F.map_entries("attributes"), entry), end), F.lit(""))
    columns = [F.col("seqname"), F.col("source"), F.col("feature_type"), F.col("start_pos").cast("string"), F.col("end_pos").cast("string"), F.col("score"), F.col("strand"), records.phase_text("phase"), attrs]
    return F.concat_ws("\t", *[F.coalesce(c, F.lit(".")) for c in columns])


def write_lines(df: DataFrame, line: Column, path: str, mode: str = "errorifexists") -> None:
    """A row without a line is an error: nothing is left out silently."""
    df.select(F.coalesce(line, F.raise_error(F.lit("a record lacks a field that its format needs")).cast("string")).alias("value")).write.mode(mode).text(path)


def write_bed(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A null name is written as ``.``, a null place as -1; the format knows no nulls, so they are read as they stand."""
    write_lines(df, records.bed_text(F.coalesce("chrom", F.lit(".")), F.coalesce("start_pos", F.lit(-1)), F.coalesce("end_pos", F.lit(-1)), aux="aux"), path, mode)


def write_bedpe(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """What is not known is written as the format says: ``.`` for a name, -1 for a place."""
    fixed = [F.coalesce(F.col(c), F.lit("." if c.startswith("chrom") else -1)) for c in ("chrom1", "start1", "end1", "chrom2", "start2", "end2")]
    write_lines(df, records.bed_text(*fixed, aux="aux"), path, mode)


def write_gff(df: DataFrame, path: str, kind: str | tuple[str, str, str | None] = "gff3", mode: str = "errorifexists") -> None:
    write_lines(df, gff_text(df, kind), path, mode)


def write_fasta(df: DataFrame, path: str, wrap: int | None = None, mode: str = "errorifexists") -> None:
    text = records.fasta_text("id", "descr", "seq", wrap)
    write_lines(df, records.trim_newline(text), path, mode)


def write_fastq(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    write_lines(df, records.trim_newline(records.fastq_text("id", "descr", "seq", "qual")), path, mode)


def parse_newick(text: str) -> list[tuple[int, str, int | None, float | None]]:
    """(node, name, parent, weight), the root first. A node without a name is ``N/A``, an edge without a length NaN."""
    nodes: list[list] = [["", None, None]]
    at, i, n = 0, 0, len(text)
    closed = False
    while i < n:
        c = text[i]
        if c == "(":
            nodes.append(["", at, None])
            at = len(nodes) - 1
        elif c == ",":
            if nodes[at][1] is None:
                raise ValueError("a comma outside of parentheses")
            nodes.append(["", nodes[at][1], None])
            at = len(nodes) - 1
        elif c == ")":
            if nodes[at][1] is None:
                raise ValueError("a parenthesis that was never opened")
            at = nodes[at][1]
        elif c == ":":
            j = i + 1
            while j < n and text[j] not in "(),:;":
                j += 1
            nodes[at][2] = float(text[i + 1 : j])
            i = j - 1
        elif c == ";":
            closed = True
            break
        elif not c.isspace():
            j = i
            while j < n and text[j] not in "(),:;":
                j += 1
            nodes[at][0] = text[i:j].strip().strip("'")
            i = j - 1
        i += 1
    if not closed or nodes[at][1] is not None:
        raise ValueError("a tree must end with a semicolon and close its parentheses")
    return [(k, name or "N/A", parent, float("nan") if parent is not None and w is None else w) for k, (name, parent, w) in enumerate(nodes)]


def read_newick(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, node_id, name, parent, weight): nodes and the edges that lead to them."""
    from strandline.operators.pairs import map_rows

    return map_rows(df, [id_col, text_col], "node_id int, name string, parent int, weight float", parse_newick)
