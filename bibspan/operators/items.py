"""Repository items: the joined identifier table and its three reading modes."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibspan.functions import identifiers
from bibspan.operators.sizing import lookup_side

PID_COLUMNS = ("IDE_DOI", "IDE_ISBN", "IDE_PMID")


def joined_items(identifier: DataFrame, master: DataFrame) -> DataFrame:
    """Identifiers with type code and label of their item."""
    typed = master.select("ITEM_ID", "OWNING_COLLECTION", "OWNING_COLLECTION_DES")
    return identifier.join(typed, "ITEM_ID", "inner")


def _has_pid() -> Column:
    return F.coalesce(*PID_COLUMNS).isNotNull()


def with_pid(items: DataFrame) -> DataFrame:
    """Items with any identifier; an empty text counts as present."""
    return items.where(_has_pid()).drop("OWNING_COLLECTION_DES")


def without_pid(items: DataFrame) -> DataFrame:
    return items.where(~_has_pid())


def no_id_dataset(
    described: DataFrame, description: DataFrame, publisher: DataFrame, language: DataFrame
) -> DataFrame:
    """Items without identifier, with everything known about them.

    `described` has the identifiers with the columns of the master table, so each table is joined once, and only
    for the items without identifier.  A table that repeats an item repeats the item in the result.
    """
    dated = ("DATE_ISSUED_YEAR", "TITLE")
    result = without_pid(described)
    for details in (description, publisher, language):
        result = result.join(details, "ITEM_ID", "left")
    last = [c for c in (*publisher.columns, *language.columns) if c != "ITEM_ID"]
    first = [c for c in result.columns if c not in (*dated, *last)]
    return result.select(*first, *dated, *last)


def raw_identifiers(items: DataFrame, column: str) -> DataFrame:
    return items.select("ITEM_ID", column, "OWNING_COLLECTION").na.drop(subset=[column])


_NORMALIZERS = {
    "IDE_DOI": identifiers.normalized_doi,
    "IDE_PMID": identifiers.normalized_pmid,
    "IDE_ISBN": identifiers.normalized_isbn,
}


def normalized_identifiers(items: DataFrame, column: str) -> DataFrame:
    """One scheme's ids of the items, without the values that hold no valid id."""
    pid = _NORMALIZERS[column](F.col(column))
    return items.select(
        F.col("ITEM_ID").alias("iris_id"),
        F.col("OWNING_COLLECTION").alias("iris_type"),
        identifiers.row_if_present(pid).alias("id"),
    )


def rejected_identifiers(items: DataFrame, column: str) -> DataFrame:
    """Raw values of the items none of whose values in this column holds a valid id.

    Rows that do normalise are left out before the anti-join, so only the rejects
    travel on that side.
    """
    pid = _NORMALIZERS[column](F.col(column))
    rejects = raw_identifiers(items, column).where(pid.isNull())
    accepted = normalized_identifiers(items, column).select(F.col("iris_id").alias("ITEM_ID"))
    return rejects.join(lookup_side(accepted.distinct(), "accepted"), "ITEM_ID", "left_anti")


def extract_pids(items: DataFrame) -> DataFrame:
    """All normalised ids, one row each, from a single pass over the items."""
    ids = F.array(*[build(F.col(column)) for column, build in _NORMALIZERS.items()])
    return items.select(
        F.col("ITEM_ID").alias("iris_id"),
        F.col("OWNING_COLLECTION").alias("iris_type"),
        F.explode(F.array_compact(ids)).alias("id"),
    )


def preferred_pids(items: DataFrame) -> DataFrame:
    """The best id of each item row: DOI, else PMID, else ISBN.

    The same as ranking the rows of `extract_pids` within an item row, without
    writing the weaker ids out first.
    """
    best = F.coalesce(*[build(F.col(column)) for column, build in _NORMALIZERS.items()])
    return items.select(
        F.col("ITEM_ID").alias("iris_id"),
        F.col("OWNING_COLLECTION").alias("iris_type"),
        identifiers.row_if_present(best).alias("id"),
    )


def pid_yield(items: DataFrame) -> DataFrame:
    """Per scheme, how many raw values give an id and how many are removed."""
    per_scheme = F.array(
        *[
            F.struct(
                F.lit(build_name).alias("scheme"),
                F.col(column).isNotNull().alias("present"),
                build(F.col(column)).isNotNull().alias("valid"),
            )
            for build_name, column, build in (
                ("doi", "IDE_DOI", identifiers.normalized_doi),
                ("pmid", "IDE_PMID", identifiers.normalized_pmid),
                ("isbn", "IDE_ISBN", identifiers.normalized_isbn),
            )
        ]
    )
    return (
        items.select(F.inline(per_scheme))
        .where("present")
        .groupBy("scheme")
        .agg(
            F.count(F.lit(1)).alias("raw"),
            F.count_if("valid").alias("kept"),
            F.count_if(~F.col("valid")).alias("removed"),
        )
    )


def rows_matching(df: DataFrame, column: str, text: str, regex: bool = False) -> DataFrame:
    """Rows whose column contains a text, or a match of a pattern."""
    return df.where(F.col(column).rlike(text) if regex else F.col(column).contains(text))


def without_type(master: DataFrame) -> DataFrame:
    return master.where(F.col("OWNING_COLLECTION").isNull())
