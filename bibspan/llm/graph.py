"""Connected components of links, by alternating large and small stars.

Every round points the larger neighbours of a node, and then the smaller ones, at its
smallest neighbour; links become stars around the smallest node of each component in a
logarithmic number of rounds.  Each round is written, so lineage stays short and a lost
executor costs one round at most.  A node with very many neighbours is a key of partial
minima and of joins whose other side is written, which adaptive execution splits.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspan.operators.sizing import lookup_side, written


def _stars(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a")).toDF("u", "v")
    least = lookup_side(both.groupBy("u").agg(F.min("v").alias("m")), "star")
    large = (
        both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.least("m", "u").alias("b")).where("a > b")
    )
    large = written(large.distinct(), "large")
    least = lookup_side(large.groupBy("a").agg(F.min("b").alias("m")), "star")
    small = large.join(least, "a")
    kept = small.select("a", F.col("m").alias("b"))
    moved = small.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return written(kept.union(moved).distinct(), "small")


def _signature(links: DataFrame):
    # A sum of hashes in wide decimals does not overflow and ignores the order of rows.
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """Smallest node of the component of every linked node: columns node and root.

    `links` has two columns of one orderable type; its direction, repeated links and
    links of a node with itself do not matter.  Nodes without links are not listed, so an
    empty table of links gives an empty result.
    """
    a, b = links.columns
    links = links.toDF("a", "b").where("a != b")
    links = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before, now = None, _signature(links)
    while now[0] and now != before:
        links = _stars(links)
        before, now = now, _signature(links)
    roots = links.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
