"""Small helpers of the operators: tables, worker state, ordered pieces of Arrow batches."""

import gc
import sys
import types

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Text handled at once in a task; longer texts are cut at a separator, so that working
# arrays stay small whatever the length of a text.
PIECE_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def worker_state(name: str) -> dict:
    """A dict that lives as long as the Python worker and is shared by its tasks.

    A name is an operator, a stroke and what is held.  A worker holds the state of one
    operator only: that of others goes when it comes to a task of the next.
    """
    holder = sys.modules.setdefault("_bibspan_worker", types.ModuleType("_bibspan_worker")).__dict__
    family = name.partition("/")[0]
    others = [k for k in holder if "/" in k and k.partition("/")[0] != family]
    for other in others:
        del holder[other]
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
    return holder.setdefault(name, {})


def free_name(df: DataFrame, name: str, *others: str) -> str:
    """A column name like `name` that `df` has not, whatever the case of letters, and that is none of the others."""
    taken = {c.lower() for c in (*df.columns, *others)}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(doc_id):
    """Rows that no model may learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column laid end to end, and where each row starts; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches, text: str = "text", limit: int = PIECE_BYTES):
    """Slices of the batches that hold about `limit` bytes of text, but one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(text))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


cloudpickle.register_pickle_by_value(sys.modules[__name__])
