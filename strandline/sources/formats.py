"""Python data sources ``fasta``, ``fastq`` and ``fastx``: batch and streaming readers, and writers.

FASTQ of four lines a record is read in splits of ``split`` bytes, as Arrow batches: a split begins at its first line with
``@`` that a line with ``+`` follows after one more, which no quality line can imitate. Files whose first records wrap their lines,
and the other formats, are one partition each, read record by record. Paths may be local or of any file system that
pyarrow knows, single files, directories or patterns. Errors are those of the formats: a record that does not begin with its mark, one that
ends early. ``register(spark)`` makes the formats known to a session.
"""

from __future__ import annotations

import fnmatch
import io
import posixpath
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

FASTA_SCHEMA = "id string, descr string, seq string"
FASTQ_SCHEMA = "id string, descr string, seq string, qual string"
FASTX_SCHEMA = "kind string, id string, descr string, seq string, qual string"


class FormatError(ValueError):
    pass


def _fs(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    import os

    return fs.LocalFileSystem(), os.path.abspath(path)


def list_files(path: str) -> list[str]:
    """The files of a path in order of name; hidden ones (``_`` and ``.``) are left out."""
    from pyarrow import fs

    system, p = _fs(path)
    if any(c in p for c in "*?["):
        base = posixpath.dirname(p)
        infos = system.get_file_info(fs.FileSelector(base, recursive=False))
        names = [i.path for i in infos if i.type == fs.FileType.File and fnmatch.fnmatch(i.path, p)]
    else:
        info = system.get_file_info(p)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        names = [p] if info.type == fs.FileType.File else [i.path for i in system.get_file_info(fs.FileSelector(p, recursive=True)) if i.type == fs.FileType.File]
    prefix = path.split("://")[0] + "://" if "://" in path else ""
    hidden = lambda n: any(part.startswith(("_", ".")) for part in posixpath.relpath(n, p if info_dir else posixpath.dirname(n)).split("/"))
    info_dir = not any(c in p for c in "*?[") and names != [p]
    return sorted(prefix + n.lstrip("/") if prefix and not prefix.startswith("file") else n for n in names if not hidden(n))


def open_lines(path: str) -> Iterator[str]:
    system, p = _fs(path)
    with system.open_input_stream(p) as raw:
        for line in io.TextIOWrapper(raw, encoding="utf-8", errors="replace", newline="\n"):
            yield line


def parse_fasta(lines: Iterable[str]) -> Iterator[tuple]:
    """(id, descr, seq): the header parts at its first white space; a blank line ends nothing."""
    head, seq = None, []
    for line in lines:
        if line.startswith(">"):
            if head is not None:
                yield (*_head(head, None), "".join(seq))
            head, seq = line[1:].rstrip(), []
        elif head is None:
            if line.strip():
                raise FormatError("Expected > at record start.")
        else:
            seq.append(line.rstrip())
    if head is not None:
        yield (*_head(head, None), "".join(seq))


def _head(head: str, sep: str | None) -> tuple[str, str | None]:
    parts = head.split(sep, 1)
    return (parts[0] if parts else ""), (parts[1] if len(parts) > 1 else None)


def parse_fastq(lines: Iterable[str]) -> Iterator[tuple]:
    """(id, descr, seq, qual): the header parts at its first blank; as many quality lines as sequence lines."""
    it = iter(lines)
    for line in it:
        head = line.rstrip("\r\n")
        if not head:
            continue
        if head[0] != "@":
            raise FormatError("Expected @ at record start.")
        seq, n = [], 0
        line = next(it, "")
        while line and line[0] != "+":
            seq.append(line.rstrip())
            n += 1
            line = next(it, "")
        qual = [next(it, "").rstrip() for _ in range(n)]
        if not line or not "".join(qual):
            raise FormatError("Incomplete record.")
        yield (*_head(head[1:], " "), "".join(seq), "".join(qual))


def kind_of(first: str) -> str:
    if not first:
        raise EOFError("unexpected end of file")
    if first[0] in ">@":
        return "fasta" if first[0] == ">" else "fastq"
    raise FormatError("invalid data: neither FASTA nor FASTQ")


def parse_fastx(lines: Iterable[str]) -> Iterator[tuple]:
    """(kind, id, descr, seq, qual): the kind is that of the first symbol."""
    it = iter(lines)
    first = next(it, "")
    kind = kind_of(first)

    def again():
        yield first
        yield from it

    if kind == "fasta":
        for i, d, s in parse_fasta(again()):
            yield kind, i, d, s, None
    else:
        for r in parse_fastq(again()):
            yield kind, *r


class _File(InputPartition):
    """A file, or the records that begin in ``start`` to ``stop`` of it."""

    def __init__(self, path: str, start: int = 0, stop: int | None = None):
        super().__init__(path)
        self.start, self.stop = start, stop


class _Reader(DataSourceReader):
    def __init__(self, path: str, parse):
        self.path, self.parse = path, parse

    def partitions(self):
        return [_File(p) for p in list_files(self.path)]

    def read(self, partition):
        yield from self.parse(open_lines(partition.value))


#: Bytes of a split, and of what is read at a time.
SPLIT, BLOCK = 64 << 20, 8 << 20


def _four_lines(head: bytes) -> bool:
    """Whether the first records of a file take four lines each."""
    lines = head.split(b"\n")[:-1]
    whole = len(lines) // 4 * 4
    return whole > 0 and all(a[:1] == b"@" and c[:1] == b"+" and len(b.rstrip()) == len(d.rstrip()) for a, b, c, d in zip(*(lines[k:whole:4] for k in range(4))))


def record_start(data: bytes, at: int = 0) -> int:
    """Where the first whole record after a line's end begins, or -1. ``data`` begins at the start of a line if ``at`` is 0."""
    while at >= 0:
        one = data.find(b"\n", at)
        two = data.find(b"\n", one + 1) if one >= 0 else -1
        if two < 0:
            return -1
        if data[at : at + 1] == b"@" and data[two + 1 : two + 2] == b"+":
            return at
        at = one + 1
    return -1


class _FastqReader(_Reader):
    """``kind``: whether rows begin with the kind of the record, as in ``fastx``."""

    def __init__(self, path: str, parse, split: int, kind: bool = False):
        super().__init__(path, parse)
        self.split, self.kind = split, kind

    def partitions(self):
        out = []
        for path in list_files(self.path):
            system, p = _fs(path)
            size = system.get_file_info(p).size
            with system.open_input_file(p) as raw:
                plain = size > 0 and _four_lines(raw.read_at(min(size, 1 << 20), 0) + (b"\n" if size <= 1 << 20 else b""))
            out += [_File(path, a, min(size, a + self.split)) for a in range(0, size, self.split)] if plain else [_File(path)]
        return out

    def read(self, partition):
        if partition.stop is None:
            yield from self.parse(open_lines(partition.value))
            return
        import pyarrow as pa
        import pyarrow.compute as pc

        system, p = _fs(partition.value)
        with system.open_input_file(p) as raw:
            size, at = raw.size(), partition.start
            data = b""
            if at:  # the record that a split's border cuts belongs to the split before
                at -= 1
                while True:
                    data += raw.read_at(min(BLOCK, size - at - len(data)), at + len(data))
                    line = data.find(b"\n") + 1
                    first = record_start(data, line) if line else -1
                    if first >= 0:
                        break
                    if at + len(data) >= size:
                        return
                at, data = at + first, data[first:]
            while at < partition.stop:
                if at + len(data) < size:
                    data += raw.read_at(min(BLOCK, size - at - len(data)), at + len(data))
                end = at + len(data) >= size
                lines = (data if not end or data.endswith(b"\n") else data + b"\n").split(b"\n")[:-1]
                if end:
                    while lines and not lines[-1].strip() and len(lines) % 4:
                        lines.pop()
                    if len(lines) % 4:
                        raise FormatError("Incomplete record.")
                whole = len(lines) // 4 * 4
                begins, k = at, 0
                while k < whole and begins < partition.stop:  # records that begin in the split
                    begins += sum(map(len, lines[k : k + 4])) + 4
                    k += 4
                lines = lines[:k]
                if any(h[:1] != b"@" for h in lines[::4]):
                    raise FormatError("Expected @ at record start.")
                if any(not q.strip() and s.strip() or m[:1] != b"+" for s, m, q in zip(lines[1::4], lines[2::4], lines[3::4])):
                    raise FormatError("Incomplete record.")
                seq, qual = (pc.utf8_rtrim_whitespace(pa.array([x.decode("utf-8", "replace") for x in lines[n::4]], pa.string())) for n in (1, 3))
                cells = [h[1:].rstrip(b"\r").decode("utf-8", "replace").split(" ", 1) for h in lines[::4]]
                if cells:
                    columns = {"kind": pa.array(["fastq"] * len(cells))} if self.kind else {}
                    columns |= {"id": pa.array([c[0] for c in cells], pa.string()), "descr": pa.array([c[1] if len(c) > 1 else None for c in cells], pa.string()), "seq": seq, "qual": qual}
                    yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
                data = data[begins - at :]
                at = begins
                if end:
                    return


class _StreamReader(DataSourceStreamReader):
    """An offset names the files seen so far, as names need not rise with time; files are never changed once they are there."""

    def __init__(self, path: str, parse):
        self.path, self.parse = path, parse

    def initialOffset(self):
        return {"files": []}

    def latestOffset(self):
        return {"files": list_files(self.path)}

    def partitions(self, start, end):
        seen = set(start["files"])
        return [_File(p) for p in end["files"] if p not in seen]

    def read(self, partition):
        yield from self.parse(open_lines(partition.value))


class _Writer(DataSourceWriter):
    """One file for each task, written to a hidden folder and moved into place once all tasks have ended; only then goes
    what is overwritten. Files of failed attempts go with the hidden folder."""

    def __init__(self, path: str, suffix: str, text, overwrite: bool):
        self.path, self.suffix, self.text, self.overwrite, self.run = path, suffix, text, overwrite, uuid.uuid4().hex

    def _staging(self, p: str) -> str:
        return posixpath.join(p, f"_staging-{self.run}")

    def write(self, iterator):
        system, p = _fs(self.path)
        system.create_dir(self._staging(p), recursive=True)
        name = f"part-{self.run}-{uuid.uuid4().hex}.{self.suffix}"
        with system.open_output_stream(posixpath.join(self._staging(p), name)) as out:
            for row in iterator:
                out.write(self.text(row).encode())
        message = WriterCommitMessage()
        message.name = name
        return message

    def commit(self, messages):
        from pyarrow import fs

        system, p = _fs(self.path)
        system.create_dir(p, recursive=True)
        old = [i for i in system.get_file_info(fs.FileSelector(p)) if i.path.rstrip("/") != self._staging(p)] if self.overwrite else []
        for m in messages:
            if m is not None:
                system.move(posixpath.join(self._staging(p), m.name), posixpath.join(p, m.name))
        for i in old:
            system.delete_dir(i.path) if i.type == fs.FileType.Directory else system.delete_file(i.path)
        self.abort([])

    def abort(self, messages):
        from pyarrow import fs

        system, p = _fs(self.path)
        if system.get_file_info(self._staging(p)).type == fs.FileType.Directory:
            system.delete_dir(self._staging(p))


def fasta_record(id_: str, descr: str | None, seq: str, wrap: int | None = None) -> str:
    if id_ is None or seq is None:
        raise FormatError("a record needs an id and a sequence")
    head = f">{id_} {descr}\n" if descr is not None else f">{id_}\n"
    if not wrap:
        return head + seq + "\n"
    return head + "".join(seq[i : i + wrap] + "\n" for i in range(0, len(seq), wrap))


def fastq_record(id_: str, descr: str | None, seq: str, qual: str) -> str:
    if id_ is None or seq is None or qual is None:
        raise FormatError("a record needs an id, a sequence and a quality")
    return f"@{id_}{'' if descr is None else ' ' + descr}\n{seq}\n+\n{qual}\n"


class _Base(DataSource):
    columns, parser, suffix = FASTA_SCHEMA, staticmethod(parse_fasta), "fasta"

    def schema(self):
        return self.columns

    def _path(self) -> str:
        path = self.options.get("path")
        if not path:
            raise ValueError("a path is needed")
        return path

    def reader(self, schema):
        return _Reader(self._path(), type(self).parser)

    def streamReader(self, schema):
        return _StreamReader(self._path(), type(self).parser)

    def writer(self, schema, overwrite):
        return _Writer(self._path(), self.suffix, self._text(), overwrite)


class FastaSource(_Base):
    """Option ``wrap``: symbols in a line when writing."""

    @classmethod
    def name(cls):
        return "fasta"

    def _text(self):
        wrap = int(self.options.get("wrap", 0))
        return lambda r: fasta_record(r["id"], r["descr"], r["seq"], wrap)


class FastqSource(_Base):
    """Option ``split``: bytes of a split when reading."""

    columns, parser, suffix = FASTQ_SCHEMA, staticmethod(parse_fastq), "fastq"

    @classmethod
    def name(cls):
        return "fastq"

    def reader(self, schema):
        return _FastqReader(self._path(), type(self).parser, int(self.options.get("split", SPLIT)))

    def _text(self):
        return lambda r: fastq_record(r["id"], r["descr"], r["seq"], r["qual"])


class FastxSource(_Base):
    """Option ``split`` as in ``fastq``, for files of that kind."""

    columns, parser, suffix = FASTX_SCHEMA, staticmethod(parse_fastx), "fastx"

    def reader(self, schema):
        return _FastqReader(self._path(), type(self).parser, int(self.options.get("split", SPLIT)), True)

    @classmethod
    def name(cls):
        return "fastx"

    def _text(self):
        return lambda r: fasta_record(r["id"], r["descr"], r["seq"]) if r["kind"] == "fasta" else fastq_record(r["id"], r["descr"], r["seq"], r["qual"])


def register(spark: SparkSession) -> None:
    for source in (FastaSource, FastqSource, FastxSource):
        spark.dataSource.register(source)
