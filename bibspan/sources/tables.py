"""Readers for repository tables, dumps, lookups and the written datasets."""

import csv
import io
import json
import posixpath
import zipfile
from functools import reduce

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from bibspan import fixed_values as fixed
from bibspan import schemas
from bibspan.session import fresh_folder
from bibspan.sources import archive, unpacking
from bibspan.sources.sinks import current_version

# Keeps a quoted empty field as '' and makes only an unquoted one NULL.
CSV_OPTIONS = {
    "header": True,
    "nullValue": "\u0000",
    "quote": '"',
    "escape": '"',
    "multiLine": True,
    "mode": "PERMISSIVE",
    "enforceSchema": False,
}
HEADER_BYTES = 64 * 1024

REPOSITORY_TABLES = {
    "master": (fixed.MASTER_FILE, schemas.ITEM_MASTER),
    "identifier": (fixed.IDENTIFIER_FILE, schemas.ITEM_IDENTIFIER),
    "description": (fixed.DESCRIPTION_FILE, schemas.ITEM_DESCRIPTION),
    "publisher": (fixed.PUBLISHER_FILE, schemas.ITEM_PUBLISHER),
    "language": (fixed.LANGUAGE_FILE, schemas.ITEM_LANGUAGE),
    "relation": (fixed.RELATION_FILE, schemas.ITEM_RELATION),
}


def require(path: str) -> str:
    """Fail before any planning when an input is missing."""
    filesystem, name = archive.filesystem_of(path)
    if filesystem.get_file_info(name).type == pafs.FileType.NotFound:
        raise FileNotFoundError(f"{path} does not exist")
    return path


def typed(df: DataFrame, schema: str) -> DataFrame:
    """Pick the columns of a schema by name and convert them; a bad value becomes NULL."""
    fields = StructType.fromDDL(schema).fields
    return df.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in fields])


def _header(path: str) -> tuple[str, ...]:
    """Column names of a CSV file, from its first row."""
    filesystem, name = archive.filesystem_of(path)
    with filesystem.open_input_stream(name) as file:
        start = file.read(HEADER_BYTES).decode("utf-8-sig", errors="replace")
    return tuple(next(csv.reader(io.StringIO(start)), ()))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header: columns by name in every file, whatever else the files hold.

    Files of a folder are read in groups of equal headers.
    """
    groups: dict[tuple[str, ...], list[str]] = {}
    for file in archive.archives_at(require(path)):
        groups.setdefault(_header(file), []).append(file)
    read = spark.read.options(**CSV_OPTIONS)
    frames = [typed(read.csv(files), schema) for header, files in groups.items() if header]
    return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], schema)


def read_archive(
    spark: SparkSession,
    path: str | None,
    schema: str,
    member: str = "*.csv",
    kind: str = "auto",
    columns: tuple[str, ...] | None = None,
    keep: tuple = (),
    inner: tuple[tuple[str, int, int], ...] = (),
) -> DataFrame:
    """CSV members of one archive or of a folder of archives, and of `inner` ZIPs: file, first byte and length.

    With `columns` only these are converted.  `keep` has conditions on them as texts, such as
    ("type", "=", "book") or ("pub_date", "starts with", "19"); rows that do not meet them all are
    dropped in the reader, before they come to Spark.
    """
    if path:
        require(path)
    if path and kind == "auto":
        for name in archive.archives_at(path):
            archive.archive_kind(name)
    spark.dataSource.register(archive.ArchiveCsvSource)
    fields = [f for f in StructType.fromDDL(schema).fields if columns is None or f.name in columns]
    schema, names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), [f.name for f in fields]
    as_text = StructType([StructField(n, StringType()) for n in names])
    raw = (
        (spark.read.option("path", path) if path else spark.read)
        .format("archive_csv")
        .schema(as_text)
        .option("member", member)
        .option("format", kind)
        .option("keep", json.dumps(keep))
        .option("inner", json.dumps(inner))
        .load()
    )
    return typed(raw, schema)


def archive_to_parquet(spark: SparkSession, path: str, schema: str, out: str) -> DataFrame:
    """Convert an archive once into a table with many splits."""
    read_archive(spark, path, schema).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def repository_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One repository table from a folder or a ZIP of CSV files."""
    file, schema = REPOSITORY_TABLES[name]
    release = posixpath.basename(path.rstrip("/"))
    subfolder = next((s for r, s in fixed.RELEASE_SUBFOLDERS.items() if r in release), "")
    inside = posixpath.join(subfolder, file)
    if path.endswith(".zip"):
        return read_archive(spark, path, schema, member=f"/{inside}")
    return read_csv(spark, posixpath.join(require(path), inside), schema)


def read_meta(
    spark: SparkSession, path: str, columns: tuple[str, ...] | None = None, keep: tuple = ()
) -> DataFrame:
    """Global metadata dump: an archive, or a folder of archives, of CSV shards; or Parquet.

    `columns` and `keep` cut it in the reader, whichever it is.
    """
    if any(archive.is_archive(name) for name in archive.archives_at(require(path))):
        return read_archive(spark, path, schemas.META, columns=columns, keep=keep)
    found = read_parquet(spark, path)
    for column, comparison, *value in keep:
        found = found.where(KEPT[comparison](F.col(column), *value))
    return found.select(*columns) if columns else found


KEPT = {
    "=": Column.__eq__, "<=>": Column.eqNullSafe, ">": Column.__gt__, ">=": Column.__ge__, "<": Column.__lt__, "<=": Column.__le__,
    "in": Column.isin, "is null": Column.isNull, "is not null": Column.isNotNull,
    "starts with": Column.startswith, "ends with": Column.endswith, "contains": Column.contains,
}


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Citation dump: a folder of ZIP archives of CSV shards, or a ZIP of such archives.

    Inner archives that are stored as they are are read where they stand; only compressed ones are copied.
    """
    found = _inner_archives(require(path)) if path.lower().endswith(".zip") else []
    if not found:
        return read_archive(spark, path, schemas.INDEX)
    stored = tuple((path, *range_) for _, _, range_ in found if range_)
    compressed = [(place, name) for place, name, range_ in found if not range_]
    folder = _copied(spark, path, compressed, fresh_folder(spark, "unpacked")) if compressed else None
    return read_archive(spark, folder, schemas.INDEX, inner=stored)


def _inner_archives(outer: str) -> list[tuple[int, str, tuple[int, int] | None]]:
    """Places and names of the ZIP members of a ZIP, and where those that are stored stand."""
    with archive.open_file(outer) as file, zipfile.ZipFile(file) as z:
        inner = [(k, i) for k, i in enumerate(z.infolist()) if i.filename.lower().endswith(".zip")]
        return [(k, i.filename, archive.stored_range(file, i)) for k, i in inner]


def unpack_archives(spark: SparkSession, outer: str, folder: str) -> str:
    """Copy the inner archives of an outer ZIP to a shared folder, one task per archive."""
    inner = _inner_archives(require(outer))
    if not inner:
        raise ValueError(f"no archive in {outer}")
    return _copied(spark, outer, [(place, name) for place, name, _ in inner], folder)


def _copied(spark: SparkSession, outer: str, inner: list[tuple[int, str]], folder: str) -> str:
    """A task writes under a name of its own and renames at the end, so a repeated task does no harm."""
    names = spark.createDataFrame(inner, "place int, name string")
    spread = names.repartition(len(inner))
    copied = spread.mapInArrow(unpacking.copier(outer, folder), "place int, name string")
    copied.write.format("noop").mode("overwrite").save()
    return folder


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table; of a published one the current version."""
    return spark.read.parquet(current_version(require(path)))


def read_lookup(spark: SparkSession, path: str, schema: str = schemas.TYPE_MAPPING) -> DataFrame:
    """A small lookup CSV, blank and missing values kept apart."""
    return read_csv(spark, path, schema)
