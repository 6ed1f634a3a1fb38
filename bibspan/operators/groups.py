"""Counting operators.  Each aggregates before its shuffle; none windows over raw rows."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibspan.functions import identifiers
from bibspan.operators.sizing import BROADCAST_BYTES, lookup_side


def count_by(df: DataFrame, *keys: str | Column, name: str = "len") -> DataFrame:
    """Rows per group; NULL is a group."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def ranked_counts(df: DataFrame, key: str, name: str = "len") -> DataFrame:
    """Rows per value, most frequent first."""
    return count_by(df, key, name=name).orderBy(F.col(name).desc(), F.col(key).asc_nulls_last())


def duplicated_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Key values that occur more than once, with their number of rows."""
    return count_by(df, *keys, name="n_rows").where("n_rows > 1")


def duplicate_rows(df: DataFrame, *keys: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """All rows whose key occurs more than once; NULL keys equal each other.

    The keys are counted with partial aggregation and the rows come from a semi join
    with the repeated keys: a broadcast when they are few, else a shuffled join in which
    adaptive execution splits the rows of a hot key.  A count window would put them all
    into one task.  `df` is read twice, so give it a written table.
    """
    repeated = lookup_side(duplicated_keys(df, *keys).select(*keys), "repeated", limit)
    same = [F.col(f"rows.{k}").eqNullSafe(F.col(f"repeated.{k}")) for k in keys]
    condition = reduce(lambda a, b: a & b, same)
    return df.alias("rows").join(repeated.alias("repeated"), condition, "left_semi")


def group_size_distribution(df: DataFrame, key: str) -> DataFrame:
    """How many key values occur how many times, among those that repeat."""
    return duplicated_keys(df, key).groupBy("n_rows").agg(F.count(F.lit(1)).alias("n_keys"))


def distinct_values(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows and distinct values per key, NULL counting as a value.

    Two levels: the first has one row per key and value, so nothing but the distinct
    values of a key ever meets in one task.
    """
    per_value = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return per_value.groupBy(key).agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_values")
    )


def ambiguous_keys(df: DataFrame, key: str, value: str) -> DataFrame:
    """Repeated keys with more than one distinct value, and the list of these values.

    A NULL value stays in the list, which collect_set alone would drop.
    """
    per_value = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return (
        per_value.groupBy(key)
        .agg(
            F.sum("n").alias("n_rows"),
            F.transform(
                F.array_sort(F.collect_list(F.struct(value))), lambda s: s[value]
            ).alias("values"),
        )
        .where(F.size("values") > 1)
    )


def duplicates_by_scheme(pids: DataFrame) -> DataFrame:
    """Per scheme: ids that several items share, and the rows they cover."""
    return (
        duplicated_keys(pids, "id")
        .groupBy(identifiers.scheme(F.col("id")).alias("id_type"))
        .agg(F.count(F.lit(1)).alias("n_ids"), F.sum("n_rows").alias("n_rows"))
    )


def top_keys(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n most repeated keys."""
    return (
        duplicated_keys(df, key)
        .orderBy(F.col("n_rows").desc(), F.col(key).asc_nulls_last())
        .limit(n)
    )
