"""Task-side copying of inner archives; sent to the executors by value."""

import posixpath
import shutil
import sys
import uuid
import zipfile

import pyarrow.fs as pafs
from pyspark import cloudpickle

COPY_BYTES = 8 * 1024 * 1024


def _filesystem(path: str):
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def copier(outer: str, folder: str):
    """A function over batches of member places and names that copies each member into the folder.

    The place of a member in the archive goes into its new name, so that members of equal
    basename from different folders stay apart.
    """

    def copy(batches):
        source, outer_name = _filesystem(outer)
        target, target_name = _filesystem(folder)
        target.create_dir(target_name, recursive=True)
        for batch in batches:
            for place, name in zip(batch.column("place").to_pylist(), batch.column("name").to_pylist()):
                final = posixpath.join(target_name, f"{place:06d}-{posixpath.basename(name)}")
                partial = posixpath.join(target_name, f"_{uuid.uuid4().hex}")
                with source.open_input_file(outer_name) as file, zipfile.ZipFile(file) as z:
                    with z.open(z.infolist()[place]) as inner, target.open_output_stream(partial) as out:
                        shutil.copyfileobj(inner, out, COPY_BYTES)
                target.move(partial, final)
            yield batch

    return copy


cloudpickle.register_pickle_by_value(sys.modules[__name__])
