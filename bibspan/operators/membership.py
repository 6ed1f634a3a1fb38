"""Membership of citation ends in the set of matched records."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspan.operators.prefilter import key_filter, possible_members
from bibspan.operators.sizing import BROADCAST_BYTES, measured_bytes, written


def members(matched: DataFrame) -> DataFrame:
    """The omids, distinct and without NULL."""
    return matched.select("omid").na.drop().distinct()


def end_flags(
    index: DataFrame, omids: DataFrame, limit: int = BROADCAST_BYTES, filter_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Citations with a member end, with two flags: is the citing end a member, is the cited end one.

    `omids` has one row per member; as it is read more than once, it is a written table.
    Both flags come from one scan of the citations.  A member set within the limit is
    broadcast once and used by both joins, without any shuffle of the citations.
    Beyond it a filter of bounded size is broadcast instead, and only the citations that pass it
    are shuffled for the outer joins, which adaptive execution splits where one
    much-cited record holds a large share of the citations.
    """
    if measured_bytes(omids) <= limit:
        side, likely = F.broadcast(omids), index
    else:
        side, likely = omids, likely_citations(index, omids, filter_bytes)
    return (
        likely.join(side.alias("a"), F.col("citing") == F.col("a.omid"), "left")
        .join(side.alias("b"), F.col("cited") == F.col("b.omid"), "left")
        .select(
            *[F.col(c) for c in index.columns],
            F.col("a.omid").isNotNull().alias("citing_in"),
            F.col("b.omid").isNotNull().alias("cited_in"),
        )
        .where("citing_in or cited_in")
    )


def likely_citations(index: DataFrame, omids: DataFrame, filter_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Citations of which an end may be a member: all that have one, and few others."""
    return possible_members(index, ["citing", "cited"], key_filter(omids, "omid", filter_bytes))


def filter_citations(index: DataFrame, omids: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Citations with at least one end among the members, repeated rows kept."""
    return of_members(index, written(omids, "members"), limit)


def of_members(index: DataFrame, omids: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """`filter_citations` for members that are written already."""
    return end_flags(index, omids, limit).drop("citing_in", "cited_in")
