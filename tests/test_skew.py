"""A key that holds a third of all rows is split over many tasks where sides are too large to broadcast."""

import pytest
from pyspark.sql import functions as F

from bibspan.operators import dedup, groups, linkage, matching, membership
from bibspan.operators.sizing import written
from tests.conftest import plan

N = 120_000
SMALL = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


@pytest.fixture
def small_partitions(spark, no_auto_broadcast):
    """Sizes at which a few megabytes count as much data."""
    for name, value in SMALL.items():
        spark.conf.set(name, value)
    yield
    for name in SMALL:
        spark.conf.unset(name)


@pytest.fixture
def keyed(spark):
    """Rows of which a third share the key `hot`."""
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") / 2).cast("int").cast("string"))
    return spark.range(0, N, 1, 16).select(key.alias("key"), "id")


def run(df):
    """Execute a plan and return its final text."""
    count = len(df.collect())
    return count, plan(df)


def is_split(text):
    return "(skew=true)" in text


def test_matches(spark, keyed, small_partitions):
    meta = keyed.select(
        F.concat(F.lit("omid:br/"), F.col("id").cast("string"), F.lit(" doi:10.1/"), "key").alias("id"),
        F.lit("t").alias("title"),
        F.lit("book").alias("type"),
    )
    pids = keyed.select(F.concat(F.lit("doi:10.1/"), "key").alias("id")).distinct().select(
        F.monotonically_increasing_id().alias("iris_id"), F.lit(35).alias("iris_type"), "id"
    )
    count, text = run(matching.match_meta(meta, written(pids, "pids"), limit=0))
    assert count == N and is_split(text), text


def test_citations(spark, keyed, small_partitions):
    index = keyed.select(
        F.col("id").cast("string").alias("id"),
        F.concat(F.lit("c"), F.col("id").cast("string")).alias("citing"),
        F.col("key").alias("cited"),
    )
    omids = keyed.select(F.col("key").alias("omid")).distinct()
    count, text = run(membership.filter_citations(index, omids, limit=0))
    assert count == N and is_split(text), text


def test_duplicate_rows(keyed, small_partitions):
    count, text = run(groups.duplicate_rows(keyed, "key", limit=0))
    repeated = keyed.groupBy("key").count().where("count > 1").agg(F.sum("count")).first()[0]
    assert count == repeated and is_split(text), text


def test_titles(spark, keyed, small_partitions):
    parsed = keyed.select(
        F.concat(F.lit("doi:"), F.col("id").cast("string")).alias("id"),
        F.concat(F.lit("a long title "), "key").alias("title"),
        F.lit("book").alias("type"),
        F.concat(F.lit("omid:"), F.col("id").cast("string")).alias("omid"),
    )
    items = keyed.select("key").distinct().select(
        F.monotonically_increasing_id().alias("ITEM_ID"), F.concat(F.lit("a long title "), "key").alias("TITLE")
    )
    count, text = run(linkage.title_match(written(items, "items"), parsed, limit=0))
    assert count == N and is_split(text), text


def test_first_of_a_hot_key_sends_one_row_per_task(keyed):
    """The rows that reach the shuffle are the winners of each task, not the group."""
    first = dedup.first_by_key(keyed, ["key"], [F.col("id").asc()])
    assert first.where("key = 'hot'").collect()[0]["id"] == 0
    text = plan(first)
    assert text.index("WindowGroupLimit [key") < text.index("Exchange") < text.rindex("WindowGroupLimit [key")


def test_copies_collapse_before_matching(spark, keyed):
    """A third of all documents are copies of one text; each counts, none is paired."""
    corpus = keyed.select(F.col("id").alias("doc_id"), F.concat(F.lit("common words "), "key").alias("text"))
    queries = spark.createDataFrame([(1, "common words hot"), (2, "common words 7")], "item_id bigint, text string")
    found = {r["item_id"]: r for r in linkage.best_match(queries, corpus).collect()}
    assert found[1]["doc_id"] == 0 and found[1]["ambiguous_match"]
    assert found[2]["doc_id"] == 14
