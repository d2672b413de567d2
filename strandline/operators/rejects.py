"""Problem 6: rows that fail to parse, set apart with the reason while the valid ones load.

Delivered lines go through pyarrow's CSV reader, a batch of one format and width at a time, with every field read as a
string: rows with another number of columns come back through the reader's invalid-row callback as structural rejects,
the rest arrives as columns, whose cells are cast and labelled by vector. What the reader would forgive (text after a
closing quote, a quote never closed) is screened before, by one pattern over the lines.

The reasons, in this order: ``quoting``, ``layout``, ``coords``, ``phase`` for bed, bedpe, gff3 and gtf; ``layout``,
``seq``, ``qual`` for fastq. The expected width of a bed or bedpe file is that of its first record.

Defined results: a null raw, an empty one and one that begins with ``#`` are no record (in fastq an empty raw is a
``layout`` reject, a null one no record); a format that is not known is a ``layout`` reject; line feeds and carriage
returns inside a line are kept as part of their column; null ids and repeated rows are kept; an empty table gives none.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pcsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns that hold starts and ends, by format.
SPANS = {"bed": [(1, 2)], "bedpe": [(1, 2), (4, 5)], "gff3": [(3, 4)], "gtf": [(3, 4)]}
_FIELD = '(?:"[^"]*(?:""[^"]*)*"|[^"\\t][^\\t]*|)'
_LINE = f"(?s)^{_FIELD}(?:\\t{_FIELD})*$"
_SEQ = "^[ACGTRYSWKMBDHVNacgtryswkmbdhvn]+$"
_QUAL = "^[!-~]*$"
_MAX = str(2**63 - 1)
_LF, _CR = "\x1e", "\x1f"
FIELDS = "chrom string, start_pos bigint, end_pos bigint, chrom2 string, start2 bigint, end2 bigint, source string, feature_type string, score string, strand string, phase tinyint, attributes string, id string, descr string, seq string, qual string, aux array<string>"
_SCHEMA = pa.schema(
    [("chrom", pa.string()), ("start_pos", pa.int64()), ("end_pos", pa.int64()), ("chrom2", pa.string()), ("start2", pa.int64()), ("end2", pa.int64()), ("source", pa.string()), ("feature_type", pa.string()), ("score", pa.string()), ("strand", pa.string()), ("phase", pa.int8()), ("attributes", pa.string()), ("id", pa.string()), ("descr", pa.string()), ("seq", pa.string()), ("qual", pa.string()), ("aux", pa.list_(pa.string()))]
)


def _digits(a: pa.Array) -> pa.Array:
    """True where a cell is made of digits 0-9 only and fits 64 bits signed."""
    ok = pc.fill_null(pc.match_substring_regex(a, "^[0-9]+$"), False)
    bare = pc.ascii_ltrim(a, "0")
    n = pc.utf8_length(bare)
    return pc.fill_null(pc.and_(ok, pc.or_(pc.less(n, 19), pc.and_(pc.equal(n, 19), pc.less_equal(bare, _MAX)))), False)


def _numbers(a: pa.Array, ok: pa.Array) -> pa.Array:
    return pc.cast(pc.if_else(ok, a, None), pa.int64())


def _read(lines: pa.Array, width: int) -> tuple[list[pa.Array], list[int]]:
    """(columns of the rows with ``width`` columns, numbers of the others)."""
    bad: list[int] = []

    def skip(row: pcsv.InvalidRow) -> str:
        bad.append(row.number - 2)  # the reader counts from 1; the first row is a guard
        return "skip"

    guard = "\t".join(["x"] * width)
    joined = pc.binary_join(pa.array([pa.concat_arrays([pa.array([guard]), lines.cast(pa.string())]).to_pylist()], pa.list_(pa.string())), "\n")
    data = joined[0].as_py().encode()
    names = [f"c{i}" for i in range(width)]
    table = pcsv.read_csv(
        pa.BufferReader(data),
        pcsv.ReadOptions(use_threads=False, column_names=names, block_size=len(data) + 64),
        pcsv.ParseOptions(delimiter="\t", quote_char='"', double_quote=True, newlines_in_values=False, ignore_empty_lines=False, invalid_row_handler=skip),
        pcsv.ConvertOptions(column_types={k: pa.string() for k in names}, strings_can_be_null=False, quoted_strings_can_be_null=False),
    )
    return [c.combine_chunks().slice(1) if c.num_chunks == 1 else pa.concat_arrays(c.chunks).slice(1) for c in table.columns], bad


def _restore(a: pa.Array) -> pa.Array:
    return pc.replace_substring(pc.replace_substring(a, _LF, "\n"), _CR, "\r")


def check_lines(fmt: str, lines: pa.Array, width: int) -> tuple[list[str | None], dict[str, pa.Array], list[int]]:
    """(reason by line, columns of the rows that the reader took, their line numbers) for lines of one format and width."""
    reason: list[str | None] = [None] * len(lines)
    plain = pc.replace_substring_regex(lines, "\\r$", "")
    quoted = pc.match_substring_regex(plain, _LINE)
    if fmt == "gtf":
        ninth = pc.fill_null(pc.struct_field(pc.extract_regex(plain, f"(?s)^(?:{_FIELD}\\t){{8}}(?P<n>{_FIELD})(?:\\t|$)"), "n"), "")
        odd = pc.equal(pc.bit_wise_and(pc.count_substring(ninth, '"'), 1), 1)
        quoted = pc.and_(quoted, pc.invert(odd))
    ok = pc.indices_nonzero(quoted).to_pylist()
    for i, q in enumerate(quoted.to_pylist()):
        if not q:
            reason[i] = "quoting"
    if not ok:
        return reason, {}, []
    safe = pc.replace_substring(pc.replace_substring(plain.take(pa.array(ok)), "\n", _LF), "\r", _CR)
    cols, bad = _read(safe, width)
    out = set(bad)
    for b in bad:
        reason[ok[b]] = "layout"
    rows = [r for k, r in enumerate(ok) if k not in out]
    if not rows:
        return reason, {}, []
    cols = [_restore(c) for c in cols]
    good = pa.array([True] * len(rows))
    bounds = {}
    for s, e in SPANS[fmt]:
        if e >= width:
            good = pa.array([False] * len(rows))
            continue
        for i in (s, e):
            d = _digits(cols[i])
            good, bounds[i] = pc.and_(good, d), _numbers(cols[i], d)
        good = pc.and_(good, pc.fill_null(pc.less_equal(bounds[s], bounds[e]), False))
    for r, g in zip(rows, good.to_pylist()):
        if not g:
            reason[r] = "coords"
    if fmt in ("gff3", "gtf"):
        for r, v in zip(rows, pc.is_in(cols[7], pa.array([".", "0", "1", "2"])).to_pylist()):
            if not v and reason[r] is None:
                reason[r] = "phase"
    return reason, _columns(fmt, cols, bounds), rows


def _columns(fmt: str, cols: list[pa.Array], bounds: dict[int, pa.Array]) -> dict[str, pa.Array]:
    if not bounds:
        return {}
    fixed = {"bed": 3, "bedpe": 6}.get(fmt, 9)
    if fmt == "bed":
        out = {"chrom": cols[0], "start_pos": bounds[1], "end_pos": bounds[2]}
    elif fmt == "bedpe":
        if len(cols) < 6:
            return {}
        out = {"chrom": cols[0], "start_pos": bounds[1], "end_pos": bounds[2], "chrom2": cols[3], "start2": bounds[4], "end2": bounds[5]}
    else:
        phase = pc.cast(pc.if_else(pc.is_in(cols[7], pa.array(["0", "1", "2"])), cols[7], None), pa.int8())
        out = {"chrom": cols[0], "source": cols[1], "feature_type": cols[2], "start_pos": bounds[3], "end_pos": bounds[4], "score": cols[5], "strand": cols[6], "phase": phase, "attributes": cols[8]}
    if fmt in ("bed", "bedpe") and len(cols) > fixed:
        rest = cols[fixed:]
        n, k = len(rest[0]), len(rest)
        order = pa.array([j * n + i for i in range(n) for j in range(k)])
        out["aux"] = pa.ListArray.from_arrays(pa.array(range(0, n * k + 1, k), pa.int32()), pa.concat_arrays(rest).take(order))
    return out


def check_fastq(raws: pa.Array) -> tuple[list[str | None], dict[str, pa.Array]]:
    """(reason by record, columns; cells of rejected records are not to be used)."""
    lines = pc.split_pattern(raws, "\n")
    n = pc.list_value_length(lines)
    four = pc.equal(n, 4)
    part = [pc.replace_substring_regex(pc.list_element(pc.if_else(four, lines, pa.scalar(["", "", "", ""], pa.list_(pa.string()))), i), "\\r$", "") for i in range(4)]
    layout = pc.and_(four, pc.and_(pc.starts_with(part[0], "@"), pc.starts_with(part[2], "+")))
    seq = pc.match_substring_regex(part[1], _SEQ)
    qual = pc.and_(pc.match_substring_regex(part[3], _QUAL), pc.equal(pc.utf8_length(part[1]), pc.utf8_length(part[3])))
    reason = [None if a and b and c else "qual" if a and b else "seq" if a else "layout" for a, b, c in zip(layout.to_pylist(), seq.to_pylist(), qual.to_pylist())]
    head = pc.split_pattern(pc.utf8_slice_codeunits(part[0], 1), " ", max_splits=1)
    ident = pc.list_element(head, 0)
    long = pc.greater(pc.list_value_length(head), 1)
    descr = pc.if_else(long, pc.utf8_slice_codeunits(part[0], 0), None)
    descr = pa.array([None if d is None else d.split(" ", 1)[1] for d in descr.to_pylist()], pa.string())
    return reason, {"id": ident, "descr": descr, "seq": part[1], "qual": part[3]}


def parse_records(df: DataFrame, id_col: str = "raw_id", file_col: str = "file_name", line_col: str = "line_no", fmt_col: str = "fmt", raw_col: str = "raw") -> DataFrame:
    """(raw_id, fmt, reason, fields of the loaded record): one row per record; ``reason`` is null where it loads."""
    kind = df.schema[id_col].dataType.simpleString()
    src = df.select(F.col(id_col).alias("raw_id"), F.col(file_col).alias("file"), F.col(line_col).alias("line"), F.lower(F.col(fmt_col)).alias("fmt"), F.col(raw_col).alias("raw"))
    fastq = F.coalesce(F.col("fmt") == "fastq", F.lit(False))
    # an empty line is one that is empty without its final carriage return
    src = src.filter(F.col("raw").isNotNull() & (fastq | ~(F.regexp_replace("raw", r"\r\z", "").eqNullSafe("") | F.startswith("raw", F.lit("#")))))
    masked = F.regexp_replace(F.regexp_replace("raw", r"\r\z", ""), r'(?<![^\t])"[^"]*+(?:""[^"]*+)*+"(?![^\t])', "q")
    width = F.length(masked) - F.length(F.replace(masked, F.lit("\t"), F.lit(""))) + 1
    lined = src.filter(F.col("fmt").isin("bed", "bedpe"))
    first = lined.groupBy(F.col("fmt").alias("of"), F.col("file").alias("name")).agg(F.min_by(width, "line").cast("int").alias("width"))
    rows = src.join(first, (src["fmt"] == first["of"]) & src["file"].eqNullSafe(first["name"]), "left").select("raw_id", "fmt", "raw", "width")

    def run(batches):
        for b in batches:
            fmts, widths = b.column(1).to_pylist(), b.column(3).to_pylist()
            groups: dict[tuple, list[int]] = {}
            for i, (f, w) in enumerate(zip(fmts, widths)):
                groups.setdefault((f, w if f in ("bed", "bedpe") else 9), []).append(i)
            for (f, w), at in groups.items():
                take = pa.array(at)
                raws = b.column(2).take(take)
                if f == "fastq":
                    reason, cols = check_fastq(raws)
                    rows = list(range(len(at)))
                elif f in SPANS:
                    reason, cols, rows = check_lines(f, raws, w or 1)
                else:
                    reason, cols, rows = ["layout"] * len(at), {}, []
                yield _batch(b, at, f, reason, cols, rows)

    def _batch(b, at, f, reason, cols, rows):
        place = {r: k for k, r in enumerate(rows)}
        pick = pa.array([place.get(i) if r is None else None for i, r in enumerate(reason)], pa.int64())
        arrays = [b.column(0).take(pa.array(at)), pa.array([f] * len(at), pa.string()), pa.array(reason, pa.string())]
        for field in _SCHEMA:
            c = cols.get(field.name)
            arrays.append(pa.nulls(len(at), field.type) if c is None else c.take(pick).cast(field.type))
        return pa.RecordBatch.from_arrays(arrays, ["raw_id", "fmt", "reason", *_SCHEMA.names])

    return rows.mapInArrow(run, f"raw_id {kind}, fmt string, reason string, {FIELDS}")


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.filter("reason is not null").select("raw_id", "reason")


def loaded(parsed: DataFrame, fmt: str) -> DataFrame:
    """The valid records of a format in the columns of its table."""
    ok = parsed.filter((F.col("reason").isNull()) & (F.col("fmt") == fmt))
    if fmt == "bed":
        return ok.select("raw_id", "chrom", "start_pos", "end_pos", "aux")
    if fmt == "bedpe":
        return ok.select("raw_id", F.col("chrom").alias("chrom1"), F.col("start_pos").alias("start1"), F.col("end_pos").alias("end1"), "chrom2", "start2", "end2", "aux")
    if fmt == "fastq":
        return ok.select("raw_id", "id", "descr", "seq", "qual")
    return ok.select("raw_id", F.col("chrom").alias("seqname"), "source", "feature_type", "start_pos", "end_pos", "score", "strand", "phase", "attributes")
