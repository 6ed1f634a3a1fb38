"""Linking identifiers with the global metadata table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspan import fixed_values as fixed
from bibspan.functions import identifiers, records
from bibspan.operators.dedup import first_by_key, one_record_per_pid
from bibspan.operators.lookup import label_type_codes
from bibspan.operators.sizing import BROADCAST_BYTES, measured_bytes

DETAILS = ("title", "type", "pub_date")


def identified_records(meta: DataFrame) -> DataFrame:
    """Records with their canonical id and the whole id list; records without an id are dropped."""
    details = [c for c in DETAILS if c in meta.columns]
    return meta.select(
        identifiers.row_if_present(records.canonical_id(F.col("id"))).alias("id"),
        *details,
        F.col("id").alias("id_list"),
    )


def with_omid(identified: DataFrame) -> DataFrame:
    return identified.select(
        *[records.omid(F.col(c)).alias("omid") if c == "id_list" else F.col(c) for c in identified.columns]
    )


def parse_meta(meta: DataFrame) -> DataFrame:
    """Records with their canonical id and omid; records without an id are dropped."""
    return with_omid(identified_records(meta))


def match_meta(meta: DataFrame, pids: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Every record that carries an item's id, with the item.

    `pids` is measured: within the limit it is broadcast, the records, which are by far
    the larger side, are not shuffled, and only those that match get their omid
    extracted.  Beyond it the join is shuffled; `pids` has one row per id, and adaptive
    execution splits an id that very many records carry.
    """
    if measured_bytes(pids) <= limit:
        return with_omid(identified_records(meta).join(F.broadcast(pids), "id", "inner"))
    return parse_meta(meta).join(pids, "id", "inner")


def in_meta(
    meta: DataFrame, pids: DataFrame, labels: DataFrame, limit: int = BROADCAST_BYTES
) -> DataFrame:
    """One record per matched id, with the label of the item's type."""
    if measured_bytes(pids) <= limit:
        matched = with_omid(identified_records(meta).join(F.broadcast(pids), "id", "inner"))
    else:
        matched = best_candidates(parse_meta(meta)).join(pids, "id", "inner")
    kept = one_record_per_pid(matched).withColumnRenamed("type", "meta_type")
    return label_type_codes(kept, labels, "iris_type")


def in_parsed_meta(
    parsed: DataFrame, pids: DataFrame, labels: DataFrame, limit: int = BROADCAST_BYTES
) -> DataFrame:
    """`in_meta` from records that have been parsed and written before."""
    if measured_bytes(pids) <= limit:
        matched = parsed.join(F.broadcast(pids), "id", "inner")
    else:
        matched = best_candidates(parsed).join(pids, "id", "inner")
    kept = one_record_per_pid(matched).withColumnRenamed("type", "meta_type")
    return label_type_codes(kept, labels, "iris_type")


def best_candidates(parsed: DataFrame) -> DataFrame:
    """The few records per id that can win, before the item's type is known.

    Preference depends on the record only through its type, so the first record of
    each preferred type and the first of all others are enough.  This bounds the
    rows per id ahead of a shuffled join.
    """
    names = sorted({name for name, _, _ in fixed.TYPE_PREFERENCE})
    kind = F.when(F.col("type").isin(names), F.col("type")).otherwise("")
    reduced = first_by_key(parsed.withColumn("_kind", kind), ["id", "_kind"], [F.col("omid").asc()])
    return reduced.drop("_kind")


def not_in_meta(pids: DataFrame, matched: DataFrame) -> DataFrame:
    """Ids of the items that have no record; both tables have one row per item."""
    return pids.join(matched.select("iris_id"), "iris_id", "left_anti")


def reconciled_ids(best_matches: DataFrame) -> DataFrame:
    """Distinct `doi:` ids of accepted best matches."""
    found = F.lower(F.concat(F.lit("doi:"), F.col("doi")))
    return best_matches.select(found.alias("id")).na.drop(subset=["id"]).distinct()


def reconciled_in_meta(
    parsed: DataFrame, ids: DataFrame, limit: int = BROADCAST_BYTES
) -> DataFrame:
    """Records that carry a reconciled id."""
    small = measured_bytes(ids) <= limit
    return parsed.join(F.broadcast(ids) if small else ids, "id", "inner")
