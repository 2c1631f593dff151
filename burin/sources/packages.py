"""ZIP packages as tables of their members, and rows as files: two Python data sources.

`burin_zip` reads the members of the packages under a path as rows (package, member, ord, size,
crc, bytes). A package is read by byte ranges: the directory at its end, then only the members
that are asked for, so that neither driver nor task holds a package. A large package is several
partitions, each with the members that begin in its range. Filters on member and package are
pushed to the reader, and bytes are read only if they are asked for (option `content`).

`burin_files` writes rows (name, bytes) as files in two phases: tasks write into a folder of their
own, the driver gives these folders their final names when all have succeeded, and removes them
when one has not. A task's folder is one message and one rename, however many files it holds.

Both open files through pyarrow.fs, so any store that it knows will do; packages that only
Spark's readers reach can be read as bytes by artifacts.read_files and taken apart by members().
"""

from __future__ import annotations

import io
import posixpath
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from contextlib import ExitStack
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith, WriterCommitMessage

MEMBERS = "package string, member string, ord int, size long, crc long, bytes binary"
#: Bytes that one partition reads, and what opening a package counts as.
SPLIT_BYTES, OPEN_BYTES = 128 << 20, 1 << 20
_UNREADABLE = (zipfile.BadZipFile, zlib.error, OSError, RuntimeError, NotImplementedError, EOFError, ValueError)


@dataclass
class Ranges(InputPartition):
    """(package, start, end): the members of each package whose entries begin in [start, end)."""

    parts: list[tuple[str, int, int]]


class ZipMembers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "burin_zip"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> DataSourceReader:
        return ZipReader(self.options)


@dataclass
class ZipReader(DataSourceReader):
    """Options: path, split_bytes, content (false: bytes are null). A file that is no package has no rows; a member that cannot be read has null bytes."""

    options: dict
    filters: list[tuple[str, str, tuple]] = field(default_factory=list)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in ("package", "member") and isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith)):
                self.filters.append((column, type(f).__name__, tuple(f.value) if isinstance(f, In) else (f.value,)))
            else:
                yield f

    def passes(self, column: str, text: str) -> bool:
        tests = {"EqualTo": lambda v: text == v[0], "In": lambda v: text in v, "StringStartsWith": lambda v: text.startswith(v[0]), "StringEndsWith": lambda v: text.endswith(v[0])}
        return all(tests[kind](values) for c, kind, values in self.filters if c == column)

    def partitions(self) -> list[Ranges]:
        store, path = _store(self.options["path"])
        split = int(self.options.get("split_bytes", SPLIT_BYTES))
        info = store.get_file_info(path)
        files = [info] if info.type == pafs.FileType.File else store.get_file_info(pafs.FileSelector(path, recursive=True))
        out, room = [], 0
        for f in files:
            if f.type == pafs.FileType.File and self.passes("package", f.path):
                for a in range(0, max(1, f.size), split):
                    # Small packages share a partition; opening one counts as some bytes.
                    cost = min(split, f.size - a) + OPEN_BYTES
                    if room < cost:
                        out.append(Ranges([]))
                        room = max(split, cost)
                    out[-1].parts.append((f.path, a, a + split))
                    room -= cost
        return out

    def read(self, partition: Ranges) -> Iterator[tuple]:
        store, _ = _store(self.options["path"])
        content = self.options.get("content", "true").lower() != "false"
        for path, start, end in partition.parts:
            try:
                package = zipfile.ZipFile(store.open_input_file(path))
            except (zipfile.BadZipFile, pa.ArrowInvalid):
                continue
            with package:
                for n, item in enumerate(package.infolist()):
                    if start <= item.header_offset < end and not item.is_dir() and self.passes("member", item.filename):
                        yield path, item.filename, n, item.file_size, item.CRC, _content(package, item) if content else None


def _content(package: zipfile.ZipFile, item: zipfile.ZipInfo) -> bytes | None:
    try:
        return package.read(item)
    except _UNREADABLE:
        return None


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), posixpath.abspath(path)


def read_packages(spark: SparkSession, path: str, content: bool = True, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Members of the packages under a path; filters on package and member reach the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ZipMembers)
    return spark.read.format("burin_zip").option("split_bytes", split_bytes).option("content", str(content).lower()).load(path)


def members(files: DataFrame) -> DataFrame:
    """The same rows from a table of artifacts (id, bytes), in batch or as a stream; for packages that fit a task."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in MEMBERS.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    package = zipfile.ZipFile(io.BytesIO(data.as_py() or b""))
                except _UNREADABLE:
                    continue
                for n, item in enumerate(package.infolist()):
                    if not item.is_dir():
                        yield pa.record_batch([pa.array([v], k) for v, k in zip((name, item.filename, n, item.file_size, item.CRC, _content(package, item)), kinds, strict=True)], names)

    return files.select("id", "bytes").mapInArrow(apply, MEMBERS)


def first_entry(content: Column) -> Column:
    """struct(name, stored) of the first local entry of a package; null for other bytes."""
    # Two bytes from a place, the low one first.
    number = lambda at: F.conv(F.concat(F.hex(F.substring(content, at + 1, 1)), F.hex(F.substring(content, at, 1))), 16, 10).cast("int")
    method, size = number(9), number(27)
    whole = (F.substring(content, 1, 4) == F.lit(b"PK\x03\x04")) & (F.octet_length(content) >= 30)
    return F.when(whole & (F.octet_length(content) >= 30 + size), F.struct(F.decode(F.substring(content, F.lit(31), size), "ISO-8859-1").alias("name"), (method == 0).alias("stored")))


# --- sink --------------------------------------------------------------------------------------


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return "burin_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        names = [f.name for f in schema.fields]
        if not {"name", "bytes"} <= set(names):
            raise ValueError("rows need the columns name and bytes")
        place = names.index("at") if "at" in names else None
        writer = FilesWriter(self.options["path"], uuid.uuid4().hex, names.index("name"), names.index("bytes"), overwrite, place)
        store, staging = writer.staging()
        store.create_dir(staging, recursive=True)  # a task that comes late, when it is gone again, cannot write
        return writer


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


@dataclass
class FilesWriter(DataSourceWriter):
    """Files of a task become one folder. Names keep their last part; one that a task meets again gets a number; rows without bytes are no files.

    With a column of places, rows in order are pieces of files: one at 0 begins a file, any other has to go on where the piece before it ended.
    """

    path: str
    job: str
    name_at: int
    bytes_at: int
    overwrite: bool
    place_at: int | None = None

    def write(self, rows: Iterator) -> Written:
        store, staging = self.staging()
        folder = f"{staging}/{uuid.uuid4().hex}"
        seen: dict[str, int] = {}
        with ExitStack() as opened:
            self._write(rows, store, folder, seen, opened)
        return Written(folder, len(seen))

    def _write(self, rows: Iterator, store: pafs.FileSystem, folder: str, seen: dict[str, int], opened: ExitStack) -> None:
        out, of, size = None, None, 0
        for row in rows:
            data, place = row[self.bytes_at], 0 if self.place_at is None else row[self.place_at]
            if data is None:
                continue
            if place:
                if out is None or row[self.name_at] != of or place != size:
                    raise ValueError(f"the piece at {place} of {row[self.name_at]} does not follow the one before it")
                out.write(bytes(data))
                size += len(data)
                continue
            if not seen:
                store.create_dir(folder, recursive=False)
            name = posixpath.basename((row[self.name_at] or "").replace("\\", "/")).strip(". ") or "documento"
            n = seen[name] = seen.get(name, 0) + 1
            while n > 1 and (other := _numbered(name, n)) in seen:
                n += 1
            if n > 1:
                seen[name], name = n, other
                seen[name] = 1
            opened.close()
            out, of, size = opened.enter_context(store.open_output_stream(f"{folder}/{name}")), row[self.name_at], len(data)
            out.write(bytes(data))

    def commit(self, messages: list) -> None:
        store, root = _store(self.path)
        if self.overwrite and store.get_file_info(root).type == pafs.FileType.Directory:
            for old in store.get_file_info(pafs.FileSelector(root)):
                if old.type == pafs.FileType.Directory and old.base_name.startswith("part-"):
                    store.delete_dir(old.path)
        for n, m in enumerate(sorted((m for m in messages if m and m.files), key=lambda m: m.folder)):
            store.move(m.folder, f"{root}/part-{self.job[:8]}-{n:05}")
        self.clear()

    def abort(self, messages: list) -> None:
        self.clear()

    def staging(self) -> tuple[pafs.FileSystem, str]:
        store, root = _store(self.path)
        return store, f"{root}/_writing-{self.job}"

    def clear(self) -> None:
        store, staging = self.staging()
        for _ in range(20):  # tasks that are not stopped yet may still be writing
            if store.get_file_info(staging).type != pafs.FileType.Directory:
                return
            try:
                store.delete_dir(staging)
            except OSError:
                time.sleep(0.1)


def _numbered(name: str, n: int) -> str:
    stem, dot, ext = name.rpartition(".")
    return f"{stem} ({n}).{ext}" if dot else f"{name} ({n})"


def save_files(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Write (name, bytes) as files under a path; a failed job leaves none."""
    rows.sparkSession.dataSource.register(Files)
    rows.select("name", "bytes").write.format("burin_files").mode(mode).save(path)


def save_pieces(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Write (name, at, bytes) as files of all pieces of a name by their place; a failed job, or a gap between two pieces, leaves none.

    A file is written by one task, piece after piece; rows are sorted on disk, so that a task holds one piece at a time.
    """
    rows.sparkSession.dataSource.register(Files)
    ordered = rows.select("name", "at", "bytes").where("bytes IS NOT NULL").repartition("name").sortWithinPartitions("name", "at")
    ordered.write.format("burin_files").mode(mode).save(path)
