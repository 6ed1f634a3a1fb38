"""Code and type lookups."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibspan import fixed_values as fixed
from bibspan.operators.sizing import broadcast_if_small


def type_labels(items: DataFrame) -> DataFrame:
    """Label of every type code in use; of several labels the first in order."""
    return (
        items.na.drop(subset=["OWNING_COLLECTION"])
        .groupBy("OWNING_COLLECTION")
        .agg(F.min("OWNING_COLLECTION_DES").alias("OWNING_COLLECTION_DES"))
    )


def label_type_codes(df: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """Replace type codes by labels: an unknown code is an error, NULL stays NULL.

    Labels come after the reducing steps, so the wide text is never shuffled with the
    rows.  A code that is in the dictionary with a NULL label gives NULL.
    """
    known = labels.select(
        F.col("OWNING_COLLECTION").alias("_code"),
        F.col("OWNING_COLLECTION_DES").alias("_label"),
    )
    joined = df.join(broadcast_if_small(known), F.col(column) == F.col("_code"), "left")
    label = F.when(
        F.col(column).isNotNull() & F.col("_code").isNull(),
        F.raise_error(F.concat(F.lit("no label for type code "), F.col(column).cast("string"))),
    ).otherwise(F.col("_label"))
    kept = [label.alias(column) if c == column else F.col(c) for c in df.columns]
    return joined.select(*kept)


def type_mapping(spark: SparkSession) -> DataFrame:
    """The local-to-global type pairs that count as matching; 28 fixed rows."""
    pairs = [
        F.struct(F.lit(local).cast("string").alias("iris_type"), F.lit(name).alias("meta_type"))
        for local, name in fixed.TYPE_MAPPING
    ]
    return spark.range(1).select(F.inline(F.array(*pairs)))


def matching_types(iim: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows whose two types are a pair of the mapping."""
    return iim.join(broadcast_if_small(mapping), ["iris_type", "meta_type"], "inner")


def mismatching_types(iim: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows whose two types are no pair of the mapping, NULL types included."""
    return iim.join(broadcast_if_small(mapping), ["iris_type", "meta_type"], "left_anti")
