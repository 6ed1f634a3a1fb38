"""Bringing the datasets up to date with new shards of the dumps, without reading the old shards again.

First-per-key choices can be maintained: the winner among all records of an id is the winner among the old
winner and the new records.  A new shard therefore touches only the ids it holds.
"""

from functools import reduce

from pyspark.sql import DataFrame

from bibspan.operators import dedup, lookup, matching, membership
from bibspan.operators.sizing import BROADCAST_BYTES, broadcast_if_small, lookup_side, written


def updated_in_meta(
    in_meta: DataFrame, shard: DataFrame, pids: DataFrame, labels: DataFrame, limit: int = BROADCAST_BYTES
) -> DataFrame:
    """The matched items after new records have come.

    Rows of ids without a new record are passed on as they are.  Of the others the old winner, with the type
    code of its item again, competes with the new records; `pids` are those `in_meta` was built with.
    """
    fresh = written(dedup.one_record_per_pid(matching.match_meta(shard, pids, limit)), "fresh-matches")
    touched = broadcast_if_small(fresh.select("id"), limit)
    codes = broadcast_if_small(pids.select("id", "iris_type"), limit)
    old = in_meta.join(touched, "id", "left_semi").withColumnRenamed("meta_type", "type").drop("iris_type").join(codes, "id")
    rivals = old.unionByName(fresh, allowMissingColumns=True)
    winners = dedup.one_record_per_pid(rivals).withColumnRenamed("type", "meta_type")
    named = lookup.label_type_codes(winners, labels, "iris_type")
    return in_meta.join(touched, "id", "left_anti").unionByName(named.select(*in_meta.columns))


def updated_citations(
    citations: DataFrame,
    new_index: DataFrame,
    before: DataFrame,
    after: DataFrame,
    old_index: DataFrame | None = None,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """The citations of members after new citations, or new members, have come.

    `before` and `after` are the written members of the old and the new matches.  Old citations stay if an end
    still is a member; they and the new ones are filtered in one pass, with one filter of the members.  Old citations that only a new member brings in have to be found in the old dump,
    which is read for the few added members and only if there are any.
    """
    added = written(after.join(lookup_side(before, "members-before", limit), "omid", "left_anti"), "added-members")
    parts = [membership.of_members(citations.unionByName(new_index), after, limit)]
    if added.limit(1).count():
        if old_index is None:
            raise ValueError("new members need the old citations")
        found = membership.of_members(old_index, added, limit)
        # Those with an end among the old members are among the old citations.
        for end in ("citing", "cited"):
            known = broadcast_if_small(before.withColumnRenamed("omid", end), limit)
            found = found.join(known, end, "left_anti")
        parts.append(found.select(*citations.columns))
    return reduce(DataFrame.unionByName, parts)


def updated_not_in_meta(pids: DataFrame, in_meta: DataFrame) -> DataFrame:
    return matching.not_in_meta(pids, in_meta)
