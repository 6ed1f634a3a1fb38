"""Broadcasts behind a measured size, and tables written between stages."""

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspan.session import fresh_folder
from bibspan.sources.sinks import publish

# Largest side shipped to every executor.  Beyond it joins are shuffled.
BROADCAST_BYTES = 64 * 1024 * 1024
ROW_OVERHEAD_BYTES = 32
FIELD_OVERHEAD_BYTES = 8


def measured_bytes(df: DataFrame) -> int:
    """Size of the rows as sent, from one distributed sum over the table."""
    fields = [
        F.coalesce(F.octet_length(F.col(f"`{name}`").cast("string")), F.lit(0))
        + F.lit(FIELD_OVERHEAD_BYTES)
        for name in df.columns
    ]
    row = reduce(add, fields, F.lit(ROW_OVERHEAD_BYTES)).cast("bigint")
    return df.agg(F.coalesce(F.sum(row), F.lit(0)).alias("bytes")).first()["bytes"]


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only for a side whose measured size is within the limit.

    A larger side comes back without a hint: Spark then shuffles the join, and
    adaptive execution splits the partitions of hot keys.  The measuring reads `df`
    once, so give it a written table rather than a long plan.
    """
    return F.broadcast(df) if measured_bytes(df) <= limit else df


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write a table and read it back: cuts the lineage and gives exact statistics.

    With a folder it becomes the current version of the table of that name there.  Without
    one the table goes to the shared folder, so that it is
    there for every executor, also after one is lost.
    """
    spark = df.sparkSession
    if folder:
        return spark.read.schema(df.schema).parquet(publish(df, f"{folder}/{name}"))
    path = fresh_folder(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lookup_side(keys: DataFrame, name: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """An aggregated table made ready to be joined by its key: broadcast, or at least splittable.

    An aggregate leaves its rows partitioned by its key, and a join on that key would use
    them as they are.  Adaptive execution then cannot split the hot partitions of the
    other side, as it only does so between two plain shuffles.  A written table is
    shuffled for the join, so a key with very many rows on the other side is split.
    """
    return broadcast_if_small(written(keys, name), limit)
