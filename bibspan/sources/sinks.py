"""Writers.  Spark writes one file per task; a single file is made only on request."""

import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame

from bibspan.sources.archive import filesystem_of

# The file of a published table that names its current version, and how many versions are kept.
POINTER = "_current"
KEPT_VERSIONS = 2


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with a header, for reports such as histograms."""
    out = df.coalesce(1) if single_file else df
    kept_as_is = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    out.write.mode("overwrite").options(header=True, escape='"', **kept_as_is).csv(path)


def append_results(results: DataFrame, path: str) -> None:
    """Add finished results to a table that a later run consults."""
    results.write.mode("append").parquet(path)


def publish(df: DataFrame, path: str) -> str:
    """Write a new version of a table below `path` and switch to it; the folder of the version.

    The version has files of even size: small ones are merged and large ones split by Spark's rebalancing.  The
    pointer is switched last and in one move, so a reader sees the old version or the new one, a run that is
    killed leaves the old one, and a table may be made from its own last version.  The last
    versions are kept for readers that have begun.
    """
    version = f"v-{uuid.uuid4().hex}"
    df.hint("rebalance").write.mode("overwrite").parquet(f"{path}/{version}")
    filesystem, folder = filesystem_of(path)
    partial = f"{folder}/{POINTER}-{version}"
    with filesystem.open_output_stream(partial) as out:
        out.write(version.encode())
    before = _versions(filesystem, folder, version)
    _replace(filesystem, partial, f"{folder}/{POINTER}")
    for old in before[: max(len(before) - KEPT_VERSIONS + 1, 0)]:
        filesystem.delete_dir(old)
    return f"{path}/{version}"


def _versions(filesystem: pafs.FileSystem, folder: str, new: str) -> list[str]:
    """Folders of the versions but the new one, the oldest first."""
    entries = filesystem.get_file_info(pafs.FileSelector(folder))
    folders = [e for e in entries if e.type == pafs.FileType.Directory and e.base_name.startswith("v-") and e.base_name != new]
    return [e.path for e in sorted(folders, key=lambda e: (e.mtime_ns or 0, e.path))]


def _replace(filesystem: pafs.FileSystem, partial: str, final: str) -> None:
    try:
        filesystem.move(partial, final)
    except OSError:
        # Stores that do not move over an existing file.
        filesystem.delete_file(final)
        filesystem.move(partial, final)


def current_version(path: str) -> str:
    """The folder of the current version of a published table; `path` itself for any other table."""
    filesystem, folder = filesystem_of(path)
    pointer = f"{folder}/{POINTER}"
    if filesystem.get_file_info(pointer).type != pafs.FileType.File:
        return path
    with filesystem.open_input_stream(pointer) as file:
        return f"{path}/{file.read().decode()}"
