"""Profiles: types, shares, items without identifiers, unmatched items, years."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bibspan import fixed_values as fixed
from bibspan.functions import identifiers, records
from bibspan.operators import groups, items as item_ops
from bibspan.operators.lookup import label_type_codes


def coverage_by_type(pids: DataFrame, in_meta: DataFrame, labels: DataFrame) -> DataFrame:
    """Per item type: items with an id, those found, those not found, percent found."""
    available = label_type_codes(groups.count_by(pids, "iris_type", name="in_repository"), labels, "iris_type")
    found = groups.count_by(in_meta, "iris_type", name="found")
    return (
        available.join(found, "iris_type", "left")
        .withColumn("found", F.coalesce("found", F.lit(0)))
        .withColumn("not_found", F.col("in_repository") - F.col("found"))
        .withColumn("pct_found", records.percent(F.col("found"), F.col("in_repository")))
        .orderBy(F.col("not_found").desc(), F.col("iris_type").asc_nulls_last())
    )


def type_ranking_side_by_side(meta_types: DataFrame, item_types: DataFrame) -> DataFrame:
    """The two type rankings next to each other, the shorter one padded with NULL.

    Both inputs are aggregates with one row per type.
    """

    def ranked(df: DataFrame, key: str, count: str) -> DataFrame:
        order = Window.orderBy(F.col(count).desc(), F.col(key).asc_nulls_last())
        return df.withColumn("position", F.row_number().over(order).cast("bigint"))

    left = ranked(meta_types.select("meta_type", "len"), "meta_type", "len")
    right = ranked(
        item_types.select("iris_type", F.col("len").alias("len_iris")), "iris_type", "len_iris"
    )
    return left.join(right, "position", "full").select(
        "position", "meta_type", "len", "iris_type", "len_iris"
    )


def type_pairs(typed: DataFrame) -> DataFrame:
    """Rows with both types as one list."""
    return typed.withColumn("types", F.array("meta_type", "iris_type"))


def type_breakdown(typed: DataFrame) -> DataFrame:
    """Per global type: rows, and the item types with their counts, most frequent first.

    Counting per pair first leaves one row per pair of types to collect.
    """
    per_pair = groups.count_by(typed, "meta_type", "iris_type", name="iris_count")
    by_count = F.array_sort(
        F.collect_list(F.struct((-F.col("iris_count")).alias("order"), "iris_type", "iris_count"))
    )
    return per_pair.groupBy("meta_type").agg(
        F.sum("iris_count").alias("count"),
        F.transform(
            by_count,
            lambda s: F.struct(s["iris_type"].alias("iris_type"), s["iris_count"].alias("iris_count")),
        ).alias("iris_types"),
    )


def type_breakdown_long(breakdown: DataFrame) -> DataFrame:
    """One row per pair of types."""
    return breakdown.select("meta_type", "count", F.inline("iris_types"))


def type_pivot(typed: DataFrame, types: list[str]) -> DataFrame:
    """Item types as columns over global types, missing pairs as 0.

    The columns are the stated types, those of the type dictionary, whether they occur or not;
    so no job has to find them and any number of them will do.
    """
    per_pair = groups.count_by(typed, "meta_type", "iris_type", name="iris_count")
    counts = [F.coalesce(F.sum(F.when(F.col("iris_type") == t, F.col("iris_count"))), F.lit(0)).alias(t) for t in types]
    return per_pair.groupBy("meta_type").agg(*counts)


def type_share(typed: DataFrame) -> DataFrame:
    """Share of each item type within its global type."""
    per_pair = groups.count_by(typed, "meta_type", "iris_type", name="iris_count")
    of_type = Window.partitionBy("meta_type")
    return per_pair.withColumn(
        "share", F.round(F.col("iris_count") / F.sum("iris_count").over(of_type), 4)
    )


def mismatch_breakdown(mismatching: DataFrame) -> DataFrame:
    """Pairs of types that do not match; a missing global type is named."""
    counts = groups.count_by(mismatching, "meta_type", "iris_type", name="iris_count")
    return counts.withColumn(
        "meta_type", F.coalesce("meta_type", F.lit(fixed.MISSING_TYPE_LABEL))
    )


def share_of_total(counts: DataFrame, count: str, total: str) -> DataFrame:
    """Percentage of a count in the sum of another; the sum reuses the counts' shuffle."""
    whole = counts.agg(F.sum(total)).scalar()
    return counts.withColumn("percentage", F.round(F.col(count) * 100 / whole, 2))


def no_id_type_share(clean: DataFrame) -> DataFrame:
    """Items per type label and their share; the row of missing labels counts 0."""
    counts = clean.groupBy("OWNING_COLLECTION_DES").agg(
        F.count("OWNING_COLLECTION_DES").alias("count"), F.count(F.lit(1)).alias("rows")
    )
    return share_of_total(counts, "count", "rows").drop("rows")


def no_id_country_share(clean: DataFrame) -> DataFrame:
    counts = groups.count_by(clean, "PUB_COUNTRY", name="count")
    return share_of_total(counts, "count", "count")


def no_id_duplicates(titled: DataFrame) -> DataFrame:
    """Repeated title-and-author texts, counted by title."""
    return (
        groups.duplicated_keys(titled, "TITLE", "DES_ALLPEOPLE")
        .groupBy("TITLE")
        .agg(F.sum("n_rows").alias("count"))
    )


def traceability(items: DataFrame) -> DataFrame:
    """Items with and without an identifier, and the percentages, from one pass."""
    has_pid = F.coalesce(*item_ops.PID_COLUMNS).isNotNull()
    counts = items.agg(F.count(F.lit(1)).alias("total"), F.count_if(has_pid).alias("traceable"))
    return counts.select(
        "total",
        "traceable",
        (F.col("total") - F.col("traceable")).alias("not_traceable"),
        records.percent(F.col("traceable"), F.col("total")).alias("pct_traceable"),
        F.round(
            F.lit(100) - F.col("traceable") * 100 / F.col("total"), 2
        ).alias("pct_not_traceable"),
    )


def scheme_share(pids: DataFrame) -> DataFrame:
    """Ids per scheme and their percentages, in one row."""
    counts = pids.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("id").startswith(s + ":")).alias(s) for s in fixed.SCHEMES],
    )
    shares = [records.percent(F.col(s), F.col("total")).alias(f"pct_{s}") for s in fixed.SCHEMES]
    return counts.select("total", *fixed.SCHEMES, *shares)


def coverage_rates(items: DataFrame, pids: DataFrame, in_meta: DataFrame) -> DataFrame:
    """Matched items against all items and against items with an id, each on its own base."""
    found = in_meta.agg(F.count(F.lit(1))).scalar()
    with_id = pids.agg(F.count(F.lit(1))).scalar()
    counts = items.agg(F.count(F.lit(1)).alias("n_items")).select(
        found.alias("found"), "n_items", with_id.alias("n_with_id")
    )
    return counts.select(
        "*",
        records.percent(F.col("found"), F.col("n_items")).alias("pct_of_items"),
        records.percent(F.col("found"), F.col("n_with_id")).alias("pct_of_with_id"),
    )


def reconciliation_rate(found: DataFrame, clean: DataFrame) -> DataFrame:
    """Reconciled records as a percentage of the cleaned items without identifier."""
    total = clean.agg(F.count(F.lit(1))).scalar()
    return found.agg(F.count(F.lit(1)).alias("found")).select(
        "found", total.alias("total"), F.round(F.col("found") * 100 / total, 2).alias("percentage")
    )


def meta_years(meta: DataFrame) -> DataFrame:
    """Records per publication year as written; no year is a group."""
    return groups.count_by(meta, records.year_text(F.col("pub_date")).alias("year"), name="count")


def year_anomalies(years: DataFrame, after: int = fixed.LAST_VALID_YEAR) -> DataFrame:
    """Records without a year, and records of a year still to come."""
    number = records.year_number(F.col("year"))
    return years.agg(
        F.coalesce(F.sum(F.when(F.col("year").isNull(), F.col("count"))), F.lit(0)).alias("no_year"),
        F.coalesce(F.sum(F.when(number > after, F.col("count"))), F.lit(0)).alias("future_year"),
    )


def chart_years(years: DataFrame) -> DataFrame:
    """The years shown in the charts, as numbers."""
    number = records.year_number(F.col("year"))
    return (
        years.select(number.alias("year"), "count")
        .where((F.col("year") > fixed.FIRST_CHART_YEAR) & (F.col("year") <= fixed.LAST_VALID_YEAR))
        .groupBy("year")
        .agg(F.sum("count").alias("count"))
        .orderBy("year")
    )


def item_years(master: DataFrame) -> DataFrame:
    """Items per year of issue, items without one left out."""
    years = master.select(records.year_of_issue(F.col("DATE_ISSUED_YEAR")).alias("DATE_ISSUED_YEAR"))
    return groups.count_by(years.na.drop(), "DATE_ISSUED_YEAR").orderBy("DATE_ISSUED_YEAR")


def common_years(no_id_years: DataFrame, all_years: DataFrame) -> DataFrame:
    """Both counts for the years, up to the last valid one, that occur in both."""
    return (
        no_id_years.join(all_years.withColumnRenamed("len", "len2"), "DATE_ISSUED_YEAR", "inner")
        .where(F.col("DATE_ISSUED_YEAR") <= fixed.LAST_VALID_YEAR)
        .orderBy("DATE_ISSUED_YEAR")
    )


def year_set_intersection(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("DATE_ISSUED_YEAR").intersect(right.select("DATE_ISSUED_YEAR"))


def unmatched_by_type(not_in_meta: DataFrame, labels: DataFrame) -> DataFrame:
    counts = groups.count_by(not_in_meta, "iris_type")
    return label_type_codes(counts, labels, "iris_type").orderBy(
        F.col("len").desc(), F.col("iris_type").asc_nulls_last()
    )


def ids_by_scheme(pids: DataFrame) -> DataFrame:
    """Ids per scheme, in the four-letter form of the reports; a missing id counts 0."""
    return pids.groupBy(identifiers.scheme_key(F.col("id")).alias("id")).agg(
        F.count("id").alias("count"), F.count(F.lit(1)).alias("len")
    )
