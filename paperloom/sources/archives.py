"""Files and archives read in ranges by Python data sources, so that no file passes as one cell.

`file_digests` gives one row per file, `archive_entries` one per archive entry. Folders are listed once;
a task gets files up to `split_bytes`, opens each and reads what it needs: digests stream, an archive's
directory comes first and then the wanted entries alone. Paths are those that `pyarrow.fs` opens
(local, HDFS, object stores); `files.read_packages` reads through Spark's own file systems instead.
"""

from __future__ import annotations

import fnmatch
import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schemas import PARTS
from .files import BATCH, MAX_ENTRIES, MAX_ENTRY, MAX_FILE, MAX_TOTAL, judged_files

STEP = 1 << 20
DIGESTS = "path string, length bigint, mtime_ms double, head binary, sha256 string"
ENTRY = pa.schema([
    ("doc_id", pa.string()), ("ord", pa.int32()), ("name", pa.string()), ("contents", pa.binary()), ("is_dir", pa.bool_()), ("method", pa.int32()),
    ("flags", pa.int32()), ("mode", pa.int32()), ("size", pa.int64()), ("compressed_size", pa.int64()), ("error_code", pa.string()),
])
DIGEST = pa.schema([("path", pa.string()), ("length", pa.int64()), ("mtime_ms", pa.float64()), ("head", pa.binary()), ("sha256", pa.string())])


@dataclass
class Files(InputPartition):
    """Files of one task: (path, bytes, time in ms)."""

    files: list[tuple[str, int, float]]


class _Ranges(io.RawIOBase):
    """A file of a `pyarrow` file system; as for local files, a step before its start is an OSError."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.length = file, file.size()

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, offset: int, whence: int = 0) -> int:
        to = offset + (0, self.file.tell(), self.length)[whence]
        if to < 0:
            raise OSError("before the start of the file")
        self.file.seek(min(to, self.length))
        return min(to, self.length)

    def readinto(self, buffer) -> int:
        block = self.file.read(len(buffer))
        buffer[: len(block)] = block
        return len(block)

    def close(self) -> None:
        self.file.close()
        super().close()


def open_range(system: fs.FileSystem, path: str) -> io.BufferedReader:
    """A seekable reader that fetches ranges of about a mebibyte."""
    return io.BufferedReader(_Ranges(system.open_input_file(path)), STEP)


class _FileReader(DataSourceReader):
    """Lists a folder and deals its files to tasks by size."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.pattern = options.get("pattern", "*").lower()
        self.max_file = int(options.get("max_file", MAX_FILE))
        self.split_bytes = int(options.get("split_bytes", 64 << 20))
        self.options = dict(options)

    def partitions(self) -> list[Files]:
        """Neighbours in path order share a task up to `split_bytes`, an opened file counting as 64 KiB at least."""
        system, root = fs.FileSystem.from_uri(self.path)
        listed = [f for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and fnmatch.fnmatchcase(f.base_name.lower(), self.pattern)]
        out: list[Files] = []
        room = 0
        for f in sorted(listed, key=lambda f: f.path):
            if not out or room <= 0:
                out.append(Files([]))
                room = self.split_bytes
            out[-1].files.append((f.path, f.size, f.mtime_ns // 1_000_000 if f.mtime_ns is not None else None))
            room -= max(f.size if self.reads(f.size) else 0, 64 << 10)
        return out or [Files([])]

    def reads(self, size: int) -> bool:
        return size <= self.max_file


class _DigestReader(_FileReader):
    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system = fs.FileSystem.from_uri(self.path)[0]
        rows = []
        for path, size, time in partition.files:
            head = digest = None
            if self.reads(size):
                with open_range(system, path) as f:
                    head = f.read(5)
                    sha = hashlib.sha256(head)
                    while block := f.read(STEP):
                        sha.update(block)
                digest = sha.hexdigest()
            rows.append((path, size, time, head, digest))
        yield _batch(rows, DIGEST)


class _EntryReader(_FileReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.names = re.compile(options.get("names", ""))
        self.max_entry = int(options.get("max_entry", MAX_ENTRY))

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system = fs.FileSystem.from_uri(self.path)[0]
        rows, held = [], 0
        for path, size, _ in partition.files:
            for row in self.rows(system, path, size):
                rows.append(row)
                held += len(row[3] or b"")
                if held > BATCH or len(rows) >= 10_000:
                    yield _batch(rows, ENTRY)
                    rows, held = [], 0
        yield _batch(rows, ENTRY)

    def rows(self, system: fs.FileSystem, path: str, size: int) -> Iterator[tuple]:
        if not self.reads(size):
            yield (path, *(None,) * 9, "FILE_TOO_LARGE")
            return
        with open_range(system, path) as f:
            try:
                yield from self.entries(path, f)
            except Exception:  # noqa: BLE001  whatever is wrong within a file, it is that file's row
                f.seek(0)
                f.read(1)  # a store that fails is no fault of the file: this raises, and the task is tried again
                yield (path, *(None,) * 9, "INVALID_DOCUMENT")

    def entries(self, path: str, f: io.BufferedReader) -> Iterator[tuple]:
        """Rows of one archive, none before all wanted entries have passed their checksums.

        Entries are unpacked once and held up to `BATCH` bytes; of a larger archive, those beyond are
        checked as a stream first and unpacked again one by one.
        """
        with zipfile.ZipFile(f) as z:
            infos = z.infolist()
            if len(infos) > MAX_ENTRIES or sum(e.file_size for e in infos) > MAX_TOTAL:
                raise ValueError("limits")
            wanted = [(i, e) for i, e in enumerate(infos) if self.names.search(e.filename)]
            row = lambda i, e, contents: (path, i, e.filename, contents, e.is_dir(), e.compress_type, e.flag_bits, e.external_attr >> 16, e.file_size, e.compress_size, None)
            readable = lambda e: e.file_size <= self.max_entry and not e.flag_bits & 1
            held, first, at = [], 0, 0
            for at, (i, e) in enumerate(wanted):
                if readable(e) and first + e.file_size > BATCH:
                    break
                contents = z.read(e) if readable(e) else None
                first += len(contents or b"")
                held.append(row(i, e, contents))
            rest = wanted[len(held) :]
            for _, e in rest:
                if readable(e):
                    with z.open(e) as entry:
                        while entry.read(STEP):
                            pass
            yield from held
            for i, e in rest:
                yield row(i, e, z.read(e) if readable(e) else None)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


class FileDigests(DataSource):
    """Options: path, pattern (of the name, in lower case), max_file, split_bytes."""

    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return DIGESTS

    def reader(self, schema) -> DataSourceReader:
        return _DigestReader(self.options)


class ArchiveEntries(DataSource):
    """Options: those of `file_digests`, names (pattern an entry's name must hold) and max_entry."""

    @classmethod
    def name(cls) -> str:
        return "archive_entries"

    def schema(self) -> str:
        return f"{PARTS}, error_code string"

    def reader(self, schema) -> DataSourceReader:
        return _EntryReader(self.options)


def digest_files(spark: SparkSession, path: str, *, pattern: str = "*", max_file: int = MAX_FILE) -> DataFrame:
    """One row per file, as `files.file_snapshots` gives them (SRC1): content streams through the digest.

    A file over `max_file` is not opened. An empty folder gives no rows.
    """
    spark.dataSource.register(FileDigests)
    d = spark.read.format("file_digests").options(path=path, pattern=pattern, max_file=max_file).load()
    return judged_files(d, max_file)


def archive_parts(spark: SparkSession, path: str, *, pattern: str = "*.docx", names: str = "", max_file: int = MAX_FILE, max_entry: int = MAX_ENTRY) -> DataFrame:
    """Parts of the archives under `path` in their order, and one row with an error_code for each that gives none (SRC2).

    `names` is a pattern: other entries are not read, so a fault in them is not found. Entries that are
    encrypted or over `max_entry` come without contents. `doc_id` is the file's path.
    """
    spark.dataSource.register(ArchiveEntries)
    return spark.read.format("archive_entries").options(path=path, pattern=pattern, names=names, max_file=max_file, max_entry=max_entry).load()
