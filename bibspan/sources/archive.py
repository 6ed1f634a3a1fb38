"""`archive_csv`: a Spark data source for CSV members of ZIP and TAR archives.

Spark plans one input partition per member, so members of one archive and members of
different archives are read by different tasks.  A task opens its archive through the
Hadoop-style file system of the path, goes straight to its member and streams it in
Arrow batches; nothing is unpacked and no member is ever held whole.

Options
    path     an archive, or a folder of archives
    member   name pattern of the members to read, default `*.csv`; a pattern without a
             slash is compared with the last part of the member's name
    format   zip, tar or auto (by file name)
    inner    file, first byte and length of ZIP archives that other files hold as they are, as JSON: these are read
             in place, with or without a path
    keep     conditions on columns, as JSON: rows that do not meet them all are dropped in the reader

All fields are read as text: an unquoted empty field is NULL, a quoted one is ''.
Columns are found by name, and only those of the given schema are converted.  The conditions in `keep` are
applied batch by batch.  They are options and not the filters Spark itself would push down
(pushFilters), because Spark 4.1.2 goes on applying those of one query to later ones on the same
DataFrame that have none of their own.

Damaged members are read as Spark reads damaged CSV files: a row with too few fields is filled up with NULL,
one with too many is cut, bytes that are not UTF-8 become replacement characters, and a
row may be of any length.

A compressed TAR has no index, so it is one partition; `sources.tables.archive_to_parquet`
turns such an archive into a splittable table once.

This module needs nothing but PyArrow, so it can be sent to the executors as it is.
"""

import contextlib
import csv
import fnmatch
import io
import json
import posixpath
import struct
import sys
import tarfile
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringEndsWith,
    StringStartsWith,
)

BLOCK_BYTES = 16 * 1024 * 1024
MOST_BLOCK_BYTES = 1024 * 1024 * 1024
HEADER_BYTES = 64 * 1024
READ_BYTES = 1024 * 1024
LISTING_THREADS = 16
COMPRESSED_TAR_SUFFIXES = (".tar.gz", ".tgz", ".tar.bz2", ".tbz2", ".tar.xz", ".txz")


@dataclass
class Member(InputPartition):
    """One CSV member, of a ZIP by its place in the listing, of a TAR by its bytes; a compressed TAR is one partition.

    `inside` is the range of bytes of the archive, if it stands within another.
    """

    path: str
    kind: str
    place: int = 0
    offset: int = 0
    size: int = 0
    inside: tuple[int, int] | None = None


class ArchiveCsvSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive_csv"

    def schema(self) -> str:
        raise ValueError("archive_csv needs a schema: spark.read.format('archive_csv').schema(...)")

    def reader(self, schema) -> "ArchiveCsvReader":
        return ArchiveCsvReader(dict(self.options), [f.name for f in schema.fields])


class ArchiveCsvReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.path = options.get("path")
        self.inner = json.loads(options.get("inner", "[]"))
        if not (self.path or self.inner):
            raise ValueError("archive_csv needs a path")
        self.pattern = options.get("member", "*.csv")
        self.kind = options.get("format", "auto")
        self.columns = columns
        self.filters: list[Filter] = [asked(*given) for given in json.loads(options.get("keep", "[]"))]

    def partitions(self) -> list[Member]:
        archives = [(file, (begin, length)) for file, begin, length in self.inner]
        archives += [(name, None) for name in (archives_at(self.path) if self.path else ())]
        with ThreadPoolExecutor(LISTING_THREADS) as pool:
            listed = list(pool.map(self._members, *zip(*archives))) if archives else []
        found = [member for members in listed for member in members]
        if not found:
            raise FileNotFoundError(f"no member {self.pattern} in {self.path or self.inner[0][0]}")
        return found

    def _members(self, archive: str, inside: tuple[int, int] | None) -> list[Member]:
        kind = archive_kind(archive) if self.kind == "auto" else self.kind
        if kind == "compressed-tar" or (kind == "tar" and not is_plain_tar(archive)):
            return [Member(archive, "compressed-tar")]
        with open_file(archive, inside) as file:
            if kind == "zip":
                with zipfile.ZipFile(file) as z:
                    return [
                        Member(archive, "zip", place, inside=inside)
                        for place, i in enumerate(z.infolist())
                        if not i.is_dir() and self._wanted(i.filename)
                    ]
            with tarfile.open(fileobj=file, mode="r:") as tar:
                return [
                    Member(archive, "tar", 0, i.offset_data, i.size)
                    for i in tar
                    if i.isfile() and self._wanted(i.name)
                ]

    def _wanted(self, name: str) -> bool:
        """A pattern from the root (`/a.csv`), a path pattern, or a pattern of names in any folder."""
        if self.pattern.startswith("/"):
            return fnmatch.fnmatchcase(f"/{name}", self.pattern) and name.count("/") == self.pattern.count("/") - 1
        compared = name if "/" in self.pattern else posixpath.basename(name)
        return fnmatch.fnmatchcase(compared, self.pattern)

    def read(self, member: Member) -> Iterator[pa.RecordBatch]:
        for batch in self._rows(member):
            for given in self.filters:
                batch = batch.filter(condition(given)(batch))
            if batch.num_rows:
                yield batch

    def _rows(self, member: Member) -> Iterator[pa.RecordBatch]:
        if member.kind in ("zip", "tar"):
            yield from csv_batches(lambda: opened(member), self.columns)
            return
        with open_file(member.path) as file, tarfile.open(fileobj=file, mode="r|*") as tar:
            for info in tar:
                if info.isfile() and self._wanted(info.name):
                    # The stream does not go back, so its rows are bounded by one block, a larger one.
                    content = tar.extractfile(info)
                    yield from _blocks(lambda: contextlib.nullcontext(content), self.columns, 8 * BLOCK_BYTES)


@contextlib.contextmanager
def opened(member: Member):
    """The content of a member as a stream."""
    with open_file(member.path, member.inside) as file:
        if member.kind == "zip":
            with zipfile.ZipFile(file) as z, z.open(z.infolist()[member.place]) as content:
                yield content
        else:
            yield Slice(file, member.offset, member.size)


def asked(column: str, comparison: str, value=None) -> Filter:
    """A condition as it is written in `keep`: column, comparison and, for most, a text."""
    kind = COMPARISONS[comparison]
    return kind((column,)) if kind in (IsNull, IsNotNull) else kind((column,), tuple(value) if kind is In else value)


def condition(given: Filter):
    """A function from a batch to the rows that pass a filter; a NULL value passes none but `is null`."""
    (name,) = given.attribute
    if isinstance(given, (IsNull, IsNotNull)):
        found = pc.is_null if isinstance(given, IsNull) else pc.is_valid
        return lambda batch: found(batch.column(name))
    if isinstance(given, In):
        return lambda batch: pc.is_in(batch.column(name), pa.array(given.value, pa.string()))
    return lambda batch: TESTS[type(given)](batch.column(name), given.value)


COMPARISONS = {
    "=": EqualTo, "<=>": EqualNullSafe, ">": GreaterThan, ">=": GreaterThanOrEqual, "<": LessThan, "<=": LessThanOrEqual,
    "in": In, "is null": IsNull, "is not null": IsNotNull,
    "starts with": StringStartsWith, "ends with": StringEndsWith, "contains": StringContains,
}

TESTS = {
    EqualTo: pc.equal,
    EqualNullSafe: lambda column, value: pc.fill_null(pc.equal(column, value), False),
    GreaterThan: pc.greater,
    GreaterThanOrEqual: pc.greater_equal,
    LessThan: pc.less,
    LessThanOrEqual: pc.less_equal,
    StringStartsWith: lambda column, value: pc.starts_with(column, value),
    StringEndsWith: lambda column, value: pc.ends_with(column, value),
    StringContains: lambda column, value: pc.match_substring(column, value),
}


class Slice:
    """A read-only stream over one range of an open file."""

    closed = False

    def __init__(self, file, offset: int, size: int):
        self.file = file
        self.left = size
        file.seek(offset)

    def read(self, n: int = -1) -> bytes:
        n = self.left if n is None or n < 0 else min(n, self.left)
        data = self.file.read(n)
        self.left -= len(data)
        return data

    def readable(self) -> bool:
        return True

    def writable(self) -> bool:
        return False

    def seekable(self) -> bool:
        return False

    def close(self) -> None:
        self.closed = True


class Replayed:
    """A stream of which the beginning has been looked at."""

    closed = False

    def __init__(self, stream):
        self.stream = stream
        self.head = b""
        while len(self.head) < HEADER_BYTES and (more := stream.read(HEADER_BYTES - len(self.head))):
            self.head += more
        self.kept = self.head

    def read(self, n: int = -1) -> bytes:
        if self.kept:
            n = len(self.kept) if n is None or n < 0 else n
            found, self.kept = self.kept[:n], self.kept[n:]
            return found
        return self.stream.read(n)

    def readable(self) -> bool:
        return True

    def writable(self) -> bool:
        return False

    def seekable(self) -> bool:
        return False

    def close(self) -> None:
        self.closed = True


def csv_batches(source, columns: list[str], block: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Stream a CSV as batches of text columns; a missing column is NULL.

    `source` opens the stream.  A row that is longer than a block makes it start again with larger
    blocks, without the rows it has given.
    """
    given = 0
    while True:
        try:
            for batch in _blocks(source, columns, block):
                if batch.num_rows <= given:
                    given -= batch.num_rows
                    continue
                yield batch.slice(given)
                given = 0
            return
        except TooLong as error:
            if block >= MOST_BLOCK_BYTES:
                raise ValueError(f"a row of more than {block} bytes") from error
            given, block = error.rows, block * 8


class TooLong(Exception):
    def __init__(self, rows: int):
        super().__init__(rows)
        self.rows = rows


def _blocks(source, columns: list[str], block: int) -> Iterator[pa.RecordBatch]:
    """Batches of a stream, after each the rows of it that had not as many fields as the header."""
    damaged: list[str] = []
    rows = 0

    def set_aside(row) -> str:
        damaged.append(row.text)
        return "skip"

    with source() as stream:
        stream = Replayed(stream)
        header = next(csv.reader(io.StringIO(stream.head.decode("utf-8-sig", errors="replace"))), [])
        if not header:
            return
        schema = pa.schema([(c, pa.string()) for c in columns])
        try:
            reader = pacsv.open_csv(
                pa.PythonFile(stream, mode="r"),
                read_options=pacsv.ReadOptions(block_size=block),
                parse_options=pacsv.ParseOptions(newlines_in_values=True, invalid_row_handler=set_aside),
                convert_options=pacsv.ConvertOptions(
                    include_columns=columns,
                    include_missing_columns=True,
                    column_types={c: pa.binary() for c in columns},
                    null_values=[""],
                    strings_can_be_null=True,
                    quoted_strings_can_be_null=False,
                ),
            )
            for batch in reader:
                found = [as_text(batch.column(c)) for c in columns]
                if batch.num_rows:
                    rows += batch.num_rows
                    yield pa.RecordBatch.from_arrays(found, schema=schema)
                if damaged:
                    rows += len(damaged)
                    yield mended(damaged, header, schema)
                    damaged.clear()
            if damaged:
                yield mended(damaged, header, schema)
        except pa.ArrowInvalid as error:
            if "Empty CSV file" in str(error):
                return
            if "straddling" in str(error):
                raise TooLong(rows) from error
            raise


def as_text(column: pa.Array) -> pa.Array:
    """Bytes as text; what is not UTF-8 becomes replacement characters."""
    if pa.types.is_null(column.type):
        return column.cast(pa.string())
    try:
        return column.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x if x is None else x.decode("utf-8", errors="replace") for x in column.to_pylist()], pa.string())


def mended(rows: list[str], header: list[str], schema: pa.Schema) -> pa.RecordBatch:
    """Rows with too few fields filled up with NULL, those with too many cut."""
    place = {name: k for k, name in reversed(list(enumerate(header)))}
    fields = [next(csv.reader(io.StringIO(row, newline=""), quoting=csv.QUOTE_NOTNULL), []) for row in rows]
    of = lambda row, c: row[place[c]] if c in place and place[c] < len(row) else None
    return pa.RecordBatch.from_arrays([pa.array([of(row, c) for row in fields], pa.string()) for c in schema.names], schema=schema)


def filesystem_of(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path.replace("file:///", "file:/").replace("file:/", "file:///"))
    return pafs.LocalFileSystem(), path


class RandomAccessFile(io.RawIOBase):
    """An Arrow input file with the errors that Python's archive readers expect.

    They look for optional trailers before the start of a very short archive and take
    an OSError for "not there", where Arrow raises a ValueError.
    """

    def __init__(self, file: pa.NativeFile):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        try:
            return self.file.seek(offset, whence)
        except ValueError as error:
            raise OSError(str(error)) from error

    def tell(self) -> int:
        return self.file.tell()

    def readinto(self, buffer) -> int:
        data = self.file.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)

    def close(self) -> None:
        if not self.closed:
            self.file.close()
        super().close()


class Range(io.RawIOBase):
    """A range of bytes of an open file, as a file of its own."""

    def __init__(self, file: io.RawIOBase, begin: int, length: int):
        self.file, self.begin, self.length, self.at = file, begin, length, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        at = offset + (0, self.at, self.length)[whence]
        if at < 0:
            raise OSError("before the start of the range")
        self.at = at
        return at

    def tell(self) -> int:
        return self.at

    def readinto(self, buffer) -> int:
        wanted = min(len(buffer), max(self.length - self.at, 0))
        self.file.seek(self.begin + self.at)
        found = self.file.readinto(memoryview(buffer)[:wanted]) if wanted else 0
        self.at += found
        return found

    def close(self) -> None:
        if not self.closed:
            self.file.close()
        super().close()


def open_file(path: str, inside: tuple[int, int] | None = None) -> io.BufferedReader:
    filesystem, name = filesystem_of(path)
    raw = RandomAccessFile(filesystem.open_input_file(name))
    return io.BufferedReader(Range(raw, *inside) if inside else raw, READ_BYTES)


def stored_range(file, info: zipfile.ZipInfo) -> tuple[int, int] | None:
    """Where a member stands in its archive as it is; None if it is compressed or encrypted."""
    if info.compress_type != zipfile.ZIP_STORED or info.flag_bits & 1:
        return None
    file.seek(info.header_offset)
    # The header of a member ends with the lengths of its name and of an extra field, which follow.
    name, extra = struct.unpack("<26xHH", file.read(30))
    return info.header_offset + 30 + name + extra, info.file_size


def archives_at(path: str) -> list[str]:
    """The archive itself, or the archives of a folder, in name order."""
    path = path.rstrip("/")
    filesystem, name = filesystem_of(path)
    info = filesystem.get_file_info(name)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(f"{path} does not exist")
    if info.type == pafs.FileType.File:
        return [path]
    entries = filesystem.get_file_info(pafs.FileSelector(name))
    prefix = path[: len(path) - len(name)] if path.endswith(name) else ""
    files = sorted(e.path for e in entries if e.type == pafs.FileType.File)
    return [prefix + f for f in files if not posixpath.basename(f).startswith(("_", "."))]


def is_archive(path: str) -> bool:
    return path.lower().endswith((".zip", ".tar", *COMPRESSED_TAR_SUFFIXES))


def archive_kind(path: str) -> str:
    if not is_archive(path):
        raise ValueError(f"unknown archive type: {path}")
    lowered = path.lower()
    if lowered.endswith(".zip"):
        return "zip"
    return "tar" if lowered.endswith(".tar") else "compressed-tar"


def is_plain_tar(path: str) -> bool:
    """Whether a .tar holds a plain TAR: its first header carries the format's mark."""
    with open_file(path) as file:
        return file.read(512)[257:262] == b"ustar"


# Executors may not have this package installed; send the module's code along.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
