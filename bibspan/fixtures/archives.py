"""CSV archives made by Spark from a table, one archive per task, to read back in checks.

Sent to the executors by value, like the archive source.
"""

import io
import posixpath
import sys
import tarfile
import zipfile

import pyarrow as pa
import pyarrow.csv as pacsv
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame


def _filesystem(path: str):
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _csv(batch: pa.RecordBatch) -> bytes:
    """A batch as CSV: texts quoted, NULL an unquoted empty field."""
    buffer = io.BytesIO()
    pacsv.write_csv(pa.Table.from_batches([batch]), buffer)
    return buffer.getvalue()


def _packer(folder: str, kind: str, member: str):
    def pack(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        filesystem, root = _filesystem(folder)
        filesystem.create_dir(root, recursive=True)
        suffix = "zip" if kind == "zip" else "tar"
        final = posixpath.join(root, f"shard-{part:05d}.{suffix}")
        partial = posixpath.join(root, f"_{part}-{TaskContext.get().taskAttemptId()}")
        with filesystem.open_output_stream(partial) as out:
            if kind == "zip":
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                    for n, batch in enumerate(batches):
                        z.writestr(member.format(n=n), _csv(batch))
            else:
                mode = "w|gz" if kind == "tar.gz" else "w|"
                with tarfile.open(fileobj=out, mode=mode) as tar:
                    for n, batch in enumerate(batches):
                        data = _csv(batch)
                        info = tarfile.TarInfo(member.format(n=n))
                        info.size = len(data)
                        tar.addfile(info, io.BytesIO(data))
        filesystem.move(partial, final)
        yield pa.RecordBatch.from_pydict({"archive": [final]})

    return pack


def pack(df: DataFrame, folder: str, kind: str = "zip", member: str = "csv/{n:04d}.csv") -> str:
    """Write a table as a folder of archives whose members are CSV shards.

    A task writes under a name of its own and renames at the end, so a repeated task
    does no harm.
    """
    packed = df.mapInArrow(_packer(folder, kind, member), "archive string")
    packed.write.format("noop").mode("overwrite").save()
    return folder


cloudpickle.register_pickle_by_value(sys.modules[__name__])
