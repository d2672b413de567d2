"""Pair and per-text kernels as DataFrame operators: alignment, seeds, approximate search, text indexes, models.

Kernels run on Arrow batches inside ``mapInArrow``; pairs are grouped by length so that a batch pads little.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.kernels import approx, hmm, integrate, pairhmm, pairwise, poa, sparse, textindex
from strandline.session import checkpoint_root, materialize

CELLS = 4_000_000
#: Groups that are worked on at once, at most.
TOGETHER = 256


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Small inputs over all cores, as few bytes may mean many seconds; with ``keys``, rows of a key in one task.

    Inputs of enough splits to keep every core busy stay where they are.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    if keys:
        return df.repartition(*keys)
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df if size >= 2 * n * split else df.repartition(n)


def _groups(xs: list[str], ys: list[str]):
    """Row numbers in groups of like lengths whose padded matrices hold at most CELLS cells."""
    order = sorted(range(len(xs)), key=lambda i: (len(xs[i]), len(ys[i])))
    group, m, n = [], 0, 0
    for i in order:
        a, b = max(m, len(xs[i])), max(n, len(ys[i]))
        if group and (len(group) + 1) * (a + b + 1) * (a + 1) > CELLS:
            yield group
            group, a, b = [], len(xs[i]), len(ys[i])
        group.append(i)
        m, n = a, b
    if group:
        yield group


_OP = pa.list_(pa.struct([("op", pa.string()), ("n", pa.int32())]))


def align_pairs(df: DataFrame, id_col: str, x: str, y: str, scoring: pairwise.Scoring, mode: str = "global", band: tuple[int, int] | None = None) -> DataFrame:
    """(id, score, xstart, xend, ystart, yend, ops, mode). ``band`` is (k, w) for a banded alignment. Null texts give null results."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            xs, ys = b.column(1).to_pylist(), b.column(2).to_pylist()
            live = [i for i in range(len(xs)) if xs[i] is not None and ys[i] is not None]
            out: list[pairwise.Alignment | None] = [None] * len(xs)
            for g in _groups([xs[i] for i in live], [ys[i] for i in live]):
                rows = [live[i] for i in g]
                px, py = [xs[i] for i in rows], [ys[i] for i in rows]
                got = pairwise.align_batch(px, py, scoring, mode) if band is None else pairwise.align_banded(px, py, scoring, *band, mode=mode)
                for i, a in zip(rows, got):
                    out[i] = a
            num = lambda f: pa.array([None if a is None else getattr(a, f) for a in out], pa.int64())
            ops = pa.array([None if a is None else [{"op": o, "n": n} for o, n in (a.clipped() if mode == "custom" else _runs(a.ops))] for a in out], _OP)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(num, ("score", "xstart", "xend", "ystart", "yend")), ops, pa.array([mode] * len(out))], ["id", "score", "xstart", "xend", "ystart", "yend", "ops", "mode"])

    return spread(df.select(F.col(id_col).alias("id"), F.col(x).alias("x"), F.col(y).alias("y"))).mapInArrow(run, f"id {kind}, score bigint, xstart bigint, xend bigint, ystart bigint, yend bigint, ops array<struct<op:string,n:int>>, mode string")


def _runs(ops: str) -> list[tuple[str, int]]:
    out: list[tuple[str, int]] = []
    for c in ops:
        if out and out[-1][0] == c:
            out[-1] = (c, out[-1][1] + 1)
        else:
            out.append((c, 1))
    return out


def map_rows(df: DataFrame, cols: list[str], schema: str, f: Callable[..., list[tuple]]) -> DataFrame:
    """(first column, ...): ``f`` of the other columns gives any number of rows. Rows with a null among these give none."""
    kind = df.schema[cols[0]].dataType.simpleString()
    full = f"id {kind}, {schema}"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    arrow = to_arrow_schema(StructType(_parse_datatype_string(schema).fields))

    def run(batches):
        for b in batches:
            at, rows = [], []
            for i, args in enumerate(zip(*(b.column(k).to_pylist() for k in range(1, len(cols))))):
                if any(a is None for a in args):
                    continue
                for r in f(*args):
                    at.append(i)
                    rows.append(r)
            cells = [pa.array([r[k] for r in rows], fld.type) for k, fld in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *cells], ["id", *arrow.names])

    return spread(df.select(*[F.col(c).alias(n) for c, n in zip(cols, ["id", *(f"a{i}" for i in range(1, len(cols)))])])).mapInArrow(run, full)


def _ends(df: DataFrame, id_col: str, seq_col: str, pattern: approx.Pattern, k: int, best: bool) -> DataFrame:
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            known = [i for i, s in enumerate(b.column(1).to_pylist()) if s is not None]
            row, end, dist = approx.ends_batch(pattern, b.column(1).take(pa.array(known, pa.int64())).to_pylist(), k)
            if best:
                order = np.lexsort((end, dist, row))
                first = order[np.concatenate(([True], np.diff(row[order]) != 0))] if len(order) else order
                row, end, dist = row[first], end[first], dist[first]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.array(known, np.int64)[row])), pa.array(end.astype(np.int64)), pa.array(dist.astype(np.int64))], ["id", "end_pos", "dist"])

    return spread(df.select(F.col(id_col).alias("id"), F.col(seq_col).alias("s"))).mapInArrow(run, f"id {kind}, end_pos bigint, dist bigint")


def approximate_ends(df: DataFrame, id_col: str, seq_col: str, pattern: approx.Pattern, k: int) -> DataFrame:
    """(id, end_pos, dist): ends are the place of the last symbol."""
    return _ends(df, id_col, seq_col, pattern, k, False)


def approximate_matches(df: DataFrame, id_col: str, seq_col: str, pattern: approx.Pattern, k: int) -> DataFrame:
    """(id, start_pos, end_pos, dist, path): the end is exclusive."""
    return map_rows(df, [id_col, seq_col], "start_pos bigint, end_pos bigint, dist bigint, path string", lambda s: approx.find_all(pattern, s, k))


def best_approximate(df: DataFrame, id_col: str, seq_col: str, pattern: approx.Pattern) -> DataFrame:
    """(id, end_pos, dist): the least distance, at its first end."""
    return _ends(df, id_col, seq_col, pattern, len(pattern.text), True)


def ukkonen_ends(df: DataFrame, id_col: str, seq_col: str, pattern: str, k: int, cost: Callable[[str, str], int] | None = None) -> DataFrame:
    args = (cost,) if cost else ()
    return map_rows(df, [id_col, seq_col], "end_pos bigint, dist bigint", lambda s: approx.ukkonen(pattern, s, k, *args))


def suffix_arrays(df: DataFrame, id_col: str, seq_col: str) -> DataFrame:
    """(id, rnk, pos, bwt, lcp, sus): one row per suffix of each text, a sentinel being appended."""

    def rows(s: str):
        t = s + "$"
        sa = textindex.suffix_array(t)
        lcp = textindex.lcp_array(t, sa)
        sus = textindex.shortest_unique(sa, lcp)
        b = textindex.bwt(t, sa)
        return [(r, int(p), b[r], int(lcp[r]), sus[int(p)]) for r, p in enumerate(sa)]

    return map_rows(df, [id_col, seq_col], "rnk bigint, pos bigint, bwt string, lcp bigint, sus bigint", rows)


def fm_search(texts: DataFrame, id_col: str, seq_col: str, patterns: list[str]) -> DataFrame:
    """(id, pattern, kind, length, pos): places of each pattern, or of its longest suffix that occurs, in every text.

    The patterns are the query set; each text is indexed where it lies and searched for all of them.
    """

    def rows(s: str):
        f = textindex.FMIndex(s + "$")
        out = []
        for p in patterns:
            kind, lo, hi, n = f.backward_search(p)
            out += [(p, kind, n, pos) for pos in f.positions(lo, hi)] or [(p, kind, n, None)]
        return out

    return map_rows(texts, [id_col, seq_col], "pattern string, kind string, length bigint, pos bigint", rows)


#: Symbols of a text block that one task indexes, about; longer texts are cut into overlapping pieces of a quarter of it.
MAX_REFERENCE = 2_000_000


#: Reads, and symbols of them, that are searched at once, at most.
READS, READ_SYMBOLS = 200_000, 64_000_000


def fm_map_reads(reads: DataFrame, id_col: str, seq_col: str, texts: DataFrame, text_id: str, text_col: str) -> DataFrame:
    """(id, kind, length, text, pos): all places of each read, or of its longest suffix that occurs, in all texts. Ids of reads are unique.

    Empty reads are Absent. Texts are dealt to tasks once and indexed in blocks; reads do not travel to the blocks, but lie
    in files of the shared folder, with the numbers of their last symbols, from which each task reads them. A first
    pass finds the longest suffix of each read in any block, one number a read and task, a second one its places.
    """
    import uuid

    from pyspark.sql.pandas.types import to_arrow_type

    spark = reads.sparkSession
    kind, id_kind = texts.schema[text_id].dataType, reads.schema[id_col].dataType
    reads = reads.select(F.col(id_col).alias("id"), F.col(seq_col).alias("s")).filter("s is not null")
    texts = texts.select(F.col(text_id).alias("text"), F.col(text_col).alias("s")).filter("s is not null and s <> ''")
    longest = max(reads.agg(F.max(F.length("s"))).first()[0] or 0, 1)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    block, step = MAX_REFERENCE, max(MAX_REFERENCE // 4, 1)

    def symbols(batches):
        for b in batches:
            seen = np.zeros(0, np.uint32)
            for k in range(0, b.num_rows, 10_000):
                raw = np.frombuffer("".join(b.column(0).slice(k, 10_000).to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
                seen = np.union1d(seen, np.flatnonzero(np.bincount(raw)) if len(raw) else raw)
            yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64))], ["c"])

    ends = textindex.Ends(np.array([r.c for r in reads.select("s").mapInArrow(symbols, "c bigint").distinct().collect()], np.uint32))

    def keyed(batches):
        for b in batches:
            whole = b.column(1).to_pylist()
            numbers, begin = ends.patterns([s[-ends.count :] for s in whole])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(s) for s in whole], pa.int32()), pa.array(numbers[begin])], ["id", "s", "size", "key"])

    folder = f"{checkpoint_root(spark)}/patterns-{uuid.uuid4().hex}"
    out = spread(reads).mapInArrow(keyed, f"id {id_kind.simpleString()}, s string, size int, key bigint").sortWithinPartitions("key")
    out.write.option("maxRecordsPerFile", max(1, min(READS, READ_SYMBOLS // longest))).parquet(folder)
    files = _files(folder)

    cut = texts.select("text", "s", F.explode(F.sequence(F.lit(0), F.length("s") - 1, F.lit(step))).alias("at"))
    cut = cut.select("text", "at", F.least(F.length("s") - F.col("at"), F.lit(step)).alias("own"), F.substring("s", F.col("at") + 1, F.lit(step + longest - 1)).alias("s"))
    cut = cut.repartition(tasks, "text", "at")

    def blocks(batches):
        """(index, pieces) of each block of a task."""
        held, size = [], 0
        for b in batches:
            for piece in zip(*(c.to_pylist() for c in b.columns)):
                held.append(piece)
                size += len(piece[3])
                if size >= block:
                    yield textindex.Backwards([p[3] for p in held], ends), held
                    held, size = [], 0
        if held:
            yield textindex.Backwards([p[3] for p in held], ends), held

    def whole(k):
        texts = []

        def take(rows):
            if not texts:
                texts.append(_column(files[k], "s"))
            return ends.patterns(texts[0].take(pa.array(rows)).to_pylist())

        return take

    def measure(batches):
        best = {}
        for index, _ in blocks(batches):
            for k, file in enumerate(files):
                n = index.longest(_column(file, "key").to_numpy(), whole(k)).astype("<i4")
                best[k] = np.maximum(best[k], n) if k in best else n
        for k, n in best.items():
            yield pa.RecordBatch.from_pydict({"file": pa.array([k], pa.int32()), "lengths": [zlib.compress(n.tobytes(), 1)]})

    def most(batches):
        rows = ((k, n) for b in batches for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for k, same in itertools.groupby(rows, lambda r: r[0]):
            n = functools.reduce(np.maximum, (np.frombuffer(zlib.decompress(x), "<i4") for _, x in same))
            yield pa.RecordBatch.from_pydict({"file": pa.array([k], pa.int32()), "lengths": [zlib.compress(n.tobytes(), 1)]})

    per = "file int, lengths binary"
    measured = _files(materialize(cut.mapInArrow(measure, per).repartition(tasks, "file").sortWithinPartitions("file").mapInArrow(most, per), "lengths").inputFiles())

    def lengths():
        return {k: np.frombuffer(zlib.decompress(n), "<i4").astype(np.int64) for f in measured for k, n in zip(*(_column(f, c).to_pylist() for c in ("file", "lengths")))}

    names = ["id", "kind", "length", "text", "pos"]

    def hits(batches):
        best = None
        for index, pieces in blocks(batches):
            best = best or lengths()
            text, at, own = pa.array([p[0] for p in pieces], to_arrow_type(kind)), *(np.array([p[k] for p in pieces], np.int64) for k in (1, 2))
            for k, file in enumerate(files):
                n, ids, full = best[k], None, None
                for row, place in index.found(_column(file, "key").to_numpy(), n, whole(k)):
                    piece = np.searchsorted(index.begins, place, "right") - 1
                    place = place - index.begins[piece]
                    row, piece, place = (x[place < own[piece]] for x in (row, piece, place))
                    if not len(row):
                        continue
                    if ids is None:
                        ids, full = _column(file, "id"), _column(file, "size").to_numpy() == n
                    what = pa.array(["Partial", "Complete"]).take(pa.array(full[row].astype(np.int64)))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), what, pa.array(n[row]), text.take(pa.array(piece)), pa.array(place + at[piece])], names)

    def absent(batches):
        best = lengths()
        for b in batches:
            for k in b.column(0).to_pylist():
                ids = _column(files[k], "id")
                gone = ids.take(pa.array(np.flatnonzero(best[k] == 0))) if k in best else ids
                none = lambda t: pa.nulls(len(gone), t)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([gone, pa.array(["Absent"] * len(gone), pa.string()), pa.array(np.zeros(len(gone), np.int64)), none(to_arrow_type(kind)), none(pa.int64())], names)

    schema = f"id {id_kind.simpleString()}, kind string, length bigint, text {kind.simpleString()}, pos bigint"
    lost = spark.range(0, len(files), 1, max(1, min(tasks, len(files)))).mapInArrow(absent, schema)
    return cut.mapInArrow(hits, schema).unionByName(lost)


def _files(folder: str | list[str]) -> list[str]:
    """Addresses of the Parquet files of a folder of the shared file system, or of a list, in order."""
    if isinstance(folder, list):
        return sorted(folder)
    system, path = fs.FileSystem.from_uri(folder)
    scheme = folder[: len(folder) - len(path)] if folder.endswith(path) else ""
    return sorted(scheme + f.path for f in system.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet"))


def _column(file: str, name: str) -> pa.Array:
    system, path = fs.FileSystem.from_uri(file)
    return pq.read_table(system.open_input_file(path), columns=[name], use_threads=False)[name].combine_chunks()


#: Symbols of reads in a part, and places of texts that a task sorts at once, about.
PART, RANGE = 1_000_000, 20_000_000


def smems(reads: DataFrame, id_col: str, seq_col: str, texts: DataFrame, text_id: str, text_col: str, min_len: int) -> DataFrame:
    """(id, start_pos, length, n_hits): super-maximal exact matches of reads with either strand of all texts, from min_len symbols on.

    Symbols beyond ACGTN match nothing. Reads and texts lie packed in files of the shared folder; long texts in pieces that
    overlap by a read. A task takes a range of prefixes, reads all files, sorts the places of texts whose prefixes lie in
    it and finds the longest match at each such place of the reads. Only these lengths and their counts travel, two bytes
    a place, to the reads.
    """
    import uuid

    from pyspark.sql.pandas.types import to_arrow_type

    if min_len < 1:
        raise ValueError("matches have at least one symbol")
    spark = reads.sparkSession
    id_kind = reads.schema[id_col].dataType
    arrow = to_arrow_type(id_kind)
    reads = reads.select(F.col(id_col).alias("id"), F.col(seq_col).alias("s")).filter("s is not null")
    texts = texts.select(F.col(text_id).alias("text"), F.col(text_col).alias("s")).filter("s is not null and s <> ''")
    over = max(reads.agg(F.max(F.length("s"))).first()[0] or 0, 1) - 1
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    block, step, part = MAX_REFERENCE, max(MAX_REFERENCE // 4, 1), PART

    def parts(batches, size, pack):
        """Rows together until they have so many symbols, which are in their last column."""
        held, n = [], 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                held.append(row)
                n += len(row[-1])
                if n >= size:
                    yield pack(held)
                    held, n = [], 0
        if held:
            yield pack(held)

    def text_part(held):
        codes, skip = textindex.packed_texts([(s, own, back) for own, back, s in held])
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (codes, skip)], ["codes", "skip"])

    def read_part(held):
        ids, codes = pa.array([[i for i, _ in held]], pa.list_(arrow)), textindex.packed_reads([s for _, s in held])
        return pa.RecordBatch.from_arrays([ids, pa.array([codes.tobytes()], pa.binary())], ["ids", "codes"])

    cut = texts.select("text", "s", F.explode(F.sequence(F.lit(0), F.length("s") - 1, F.lit(step))).alias("at"))
    cut = cut.select("text", "at", F.least(F.length("s") - F.col("at"), F.lit(step)).alias("own"), F.substring("s", F.col("at") + 1, F.lit(step + over)).alias("s"))
    own_back = F.when(F.col("at") == 0, F.length("s")).otherwise(F.greatest(F.length("s") - over, F.lit(0)))
    cut = cut.repartition(tasks, "text", "at").select("own", own_back.alias("own_back"), "s")
    folder = f"{checkpoint_root(spark)}/strands-{uuid.uuid4().hex}"
    cut.mapInArrow(lambda b: parts(b, block, text_part), "codes binary, skip binary").write.option("compression", "zstd").parquet(f"{folder}/texts")
    spread(reads).mapInArrow(lambda b: parts(b, part, read_part), f"ids array<{id_kind.simpleString()}>, codes binary").write.option("compression", "zstd").parquet(f"{folder}/reads")
    text_files, read_files = _files(f"{folder}/texts"), _files(f"{folder}/reads")

    def text_parts(names):
        """((file, row), Places) of texts."""
        for f in range(len(text_files)) if names is None else sorted({f for f, _ in names}):
            for row, (codes, skip) in enumerate(zip(_column(text_files[f], "codes"), _column(text_files[f], "skip"))):
                if names is None or (f, row) in names:
                    yield (f, row), textindex.Places(_numbers(codes, np.uint8), _numbers(skip, np.int32).reshape(-1, 2))

    def read_parts(names):
        for f in range(len(read_files)) if names is None else sorted({f for f, _ in names}):
            for row, codes in enumerate(_column(read_files[f], "codes")):
                if names is None or (f, row) in names:
                    yield (f, row), textindex.Places(_numbers(codes, np.uint8))

    def loads(batches):
        n = np.zeros(8**textindex.PREFIX, np.int64)
        for b in batches:
            for f in b.column(0).to_pylist():
                for codes, skip in zip(_column(text_files[f], "codes"), _column(text_files[f], "skip")):
                    n += textindex.Places(_numbers(codes, np.uint8), _numbers(skip, np.int32).reshape(-1, 2)).loads()
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["prefix", "n"])

    n = np.zeros(textindex.LAST, np.int64)
    for r in spark.range(0, len(text_files), 1, max(1, min(tasks, len(text_files)))).mapInArrow(loads, "prefix bigint, n bigint").groupBy("prefix").agg(F.sum("n").alias("n")).collect():
        n[r.prefix] = r.n
    width = 8 ** (textindex.PREFIX - min(textindex.PREFIX, min_len))  # prefixes that share what all matches have stay together
    starts = np.arange(textindex.FIRST, textindex.LAST, width)
    sizes = np.add.reduceat(n, starts)
    before = np.cumsum(sizes) - sizes
    count = max(tasks, -(-int(n.sum()) // RANGE))
    first = np.flatnonzero(np.diff(before * count // max(int(n.sum()), 1), prepend=-1))
    bounds, sizes = [*starts[first].tolist(), textindex.LAST], np.add.reduceat(sizes, first).tolist()

    def match(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                for (f, row), longest, hits in textindex.Longest(read_parts, text_parts, bounds[k], bounds[k + 1], sizes[k], min_len).found():
                    cells = [pa.array([x], pa.int32()) for x in (f, row, k)]
                    yield pa.RecordBatch.from_arrays([*cells, pa.array([_small(longest)]), pa.array([_small(hits)])], ["file", "row", "range", "longest", "hits"])

    ranges = len(sizes)
    matched = spark.range(0, ranges, 1, ranges).mapInArrow(match, "file int, row int, range int, longest binary, hits binary")
    matched = matched.repartitionById(tasks, F.col("file") % tasks).sortWithinPartitions("file", "row", "range")
    of = np.zeros(8**textindex.PREFIX, np.int32)
    of[bounds[0] :] = 1 + np.searchsorted(bounds, np.arange(bounds[0], len(of)), "right")
    of[bounds[-1] :] = 0

    def merge(batches):
        rows = ((b, i) for b in batches for i in range(b.num_rows))
        for f, same in itertools.groupby(rows, lambda r: r[0].column(0)[r[1]].as_py()):
            ids, codes = _column(read_files[f], "ids"), _column(read_files[f], "codes")
            for row, ranged in itertools.groupby(same, lambda r: r[0].column(1)[r[1]].as_py()):
                c = _numbers(codes[row], np.uint8)
                task = of[textindex.Places(c).prefixes()]
                at = np.argsort(task, kind="stable")[np.count_nonzero(task == 0) :]
                lengths, counts = zip(*((_whole(b.column(3)[i].as_py()), _whole(b.column(4)[i].as_py())) for b, i in ranged))
                longest, hits = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
                longest[at], hits[at] = np.concatenate(lengths), np.concatenate(counts)
                at, read, start = textindex.super_maximal(c, longest, min_len)
                yield pa.RecordBatch.from_arrays([ids[row].values.take(pa.array(read)), pa.array(start), pa.array(longest[at]), pa.array(hits[at])], ["id", "start_pos", "length", "n_hits"])

    return matched.mapInArrow(merge, f"id {id_kind.simpleString()}, start_pos bigint, length bigint, n_hits bigint")


def _numbers(cell: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), kind)


def _small(numbers: np.ndarray) -> bytes:
    """Mostly small numbers: a byte each, larger ones behind them."""
    return zlib.compress(len(numbers).to_bytes(8, "little") + np.minimum(numbers, 255).astype(np.uint8).tobytes() + numbers[numbers >= 255].astype("<i8").tobytes(), 1)


def _whole(packed: bytes) -> np.ndarray:
    raw = zlib.decompress(packed)
    n = int.from_bytes(raw[:8], "little")
    out = np.frombuffer(raw, np.uint8, n, 8).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<i8", offset=8 + n)
    return out


def chains(df: DataFrame, id_col: str, x: str, y: str, k: int, match: int = 1, gap_open: int = -1, gap_extend: int = -1, mismatches: int = 0) -> DataFrame:
    """(id, n_matches, lcsk, sdp, n_union): seeds of each pair, expanded on their diagonals, and the scores of their best chains."""

    def rows(a: str, b: str):
        hits = sparse.find_kmer_matches(a, b, k)
        if mismatches:
            hits = sparse.expand_matches(a, b, k, hits, mismatches)
        if not hits:
            return [(0, 0, 0, 0)]
        return [(len(hits), sparse.lcskpp(hits, k).score, sparse.sdpkpp(hits, k, match, gap_open, gap_extend).score, len(sparse.union_path(hits, k, match, gap_open, gap_extend)))]

    return map_rows(df, [id_col, x, y], "n_matches bigint, lcsk bigint, sdp bigint, n_union bigint", rows)


def poa_consensus(df: DataFrame, group_col: str, order_col: str, seq_col: str, match: int = 1, mismatch: int = -1, gap: int = -1, mode: str = "global") -> DataFrame:
    """(group, consensus, n_nodes, n_edges): the sequences of each group, in order, threaded through one graph.

    A group is one alignment and goes to one task; groups must be bounded by the caller, as families of reads are.
    """

    def build(seqs):
        seqs = [s for s in seqs if s]
        if not seqs:
            return None
        g = poa.Graph(seqs[0])
        for s in seqs[1:]:
            g.add(s, g.align(s, match, mismatch, gap, mode)[1])
        return g.consensus(), len(g.base), len(g.edges())

    return _by_group(df, group_col, order_col, seq_col, "group", "consensus string, n_nodes bigint, n_edges bigint", build)


def _by_group(df: DataFrame, group_col: str, order_col: str, value_col: str, name: str, schema: str, f: Callable[[list], tuple | None] | None, many: Callable[[list[list]], list[tuple]] | None = None) -> DataFrame:
    """(name, ...): ``f`` of the values of each group, in order, gives one row or none. Groups are streamed, one at a time being held.

    ``many`` gives the rows of several groups at once, at most TOGETHER of them and, but for one group, CELLS items of their values.
    """
    from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
    from pyspark.sql.types import StructType, _parse_datatype_string

    kind = df.schema[group_col].dataType
    arrow, id_type = to_arrow_schema(StructType(_parse_datatype_string(schema).fields)), to_arrow_type(kind)

    def batch(ids, rows):
        return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *(pa.array([r[k] for r in rows], fld.type) for k, fld in enumerate(arrow))], [name, *arrow.names])

    def run(batches):
        cells = ((i, v) for b in batches for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        ids, rows = [], []
        groups = ((i, [v for _, v in same]) for i, same in itertools.groupby(cells, lambda c: c[0]))
        for i, row in ((i, f(values)) for i, values in groups) if many is None else _several(groups, many):
            if row is not None:
                ids.append(i)
                rows.append(row)
            if len(ids) == 1000:
                yield batch(ids, rows)
                ids, rows = [], []
        yield batch(ids, rows)

    src = df.select(F.col(group_col).alias("g"), F.col(order_col).alias("o"), F.col(value_col).alias("v"))
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    return src.repartition(n, "g").sortWithinPartitions("g", "o").select("g", "v").mapInArrow(run, f"{name} {kind.simpleString()}, {schema}")


def _several(groups, many: Callable[[list[list]], list[tuple]]):
    """(id, row) of groups, the rows being made for several at once."""
    ids, held, size = [], [], 0
    for i, values in groups:
        n = sum(len(v) for v in values if v)
        if ids and (len(ids) == TOGETHER or size + n > CELLS):
            yield from zip(ids, many(held))
            ids, held, size = [], [], 0
        ids.append(i)
        held.append(values)
        size += n
    if ids:
        yield from zip(ids, many(held))


def hmm_decode(df: DataFrame, id_col: str, obs_col: str, model: hmm.Discrete) -> DataFrame:
    """(id, path, ln_viterbi, ln_forward, ln_backward) of arrays of observations; empty ones give no row."""

    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                obs = part.column(1).to_pylist()
                at = [i for i, o in enumerate(obs) if o]
                got = hmm.decode_batch(model, [obs[i] for i in at])
                cells = [pa.array([g[0] for g in got], pa.list_(pa.int32())), *(pa.array([g[k] for g in got], pa.float64()) for k in (1, 2, 3))]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), *cells], ["id", "path", "ln_viterbi", "ln_forward", "ln_backward"])

    src = spread(df.select(F.col(id_col).alias("id"), F.col(obs_col).alias("obs")))
    return src.mapInArrow(run, f"id {kind}, path array<int>, ln_viterbi double, ln_forward double, ln_backward double")


def hmm_train(df: DataFrame, model_col: str, order_col: str, obs_col: str, start: hmm.Discrete, tolerance: float = 1e-6, steps: int = 500) -> DataFrame:
    """(model, transition, emission, initial, n_steps, settled): one model for each group, updated after each of its sequences.

    A model has settled if its last step changed the log probability by less than ``tolerance``.

    Updates follow one another within a group; the groups of a task go through them together.
    """

    def fit(groups):
        trained = hmm.train_batch(start, [[o for o in seqs if o] for seqs in groups], tolerance, steps)
        return [(m.transition.ravel().tolist(), m.emission.ravel().tolist(), m.initial.tolist(), len(h), len(h) > 1 and abs(h[-1] - h[-2]) < tolerance) for m, h in trained]

    return _by_group(df, model_col, order_col, obs_col, "model", "transition array<double>, emission array<double>, initial array<double>, n_steps bigint, settled boolean", None, fit)


def pair_related(df: DataFrame, id_col: str, x: str, y: str, model: pairhmm.PairModel, homopolymer: bool = False, max_edit: int | None = None) -> DataFrame:
    """(id, ln_p): the probability that the pair is related, over all alignments."""
    kind = df.schema[id_col].dataType.simpleString()
    kernel = pairhmm.homopolymer_probability if homopolymer else pairhmm.pair_probability

    def run(batches):
        for b in batches:
            xs, ys = ([s or "" for s in b.column(k).to_pylist()] for k in (1, 2))
            out = np.full(len(xs), -np.inf)
            for g in _groups(xs, ys):
                out[g] = kernel([xs[i] for i in g], [ys[i] for i in g], model, max_edit)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], ["id", "ln_p"])

    return spread(df.select(F.col(id_col).alias("id"), F.col(x).alias("x"), F.col(y).alias("y"))).mapInArrow(run, f"id {kind}, ln_p double")


def integrate_adaptive(df: DataFrame, id_col: str, lo: str, hi: str, params: list[str], density: Callable[..., float], resolution: float) -> DataFrame:
    """(id, ln_integral): for each row the integral of exp(density(x, *params)) over its interval, on an adaptive grid."""
    return map_rows(df, [id_col, lo, hi, *params], "ln_integral double", lambda a, b, *p: [(integrate.adaptive(lambda x: density(x, *p), float(a), float(b), resolution),)])
