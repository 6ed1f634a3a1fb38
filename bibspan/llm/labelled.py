"""A bounded sample of labelled documents that models may learn from."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspan.llm.common import held_out


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most_of_each: int) -> DataFrame:
    """Text and label of documents outside the held-out quarter: columns text and label.

    At most `most_of_each` labelled ids of either class, those of the smallest hash of
    doc_id, so that the sample does not depend on the order of rows, and one text of each: of
    rows that share a doc_id that of the smallest hash.  They are picked from the labels before any text is
    read; the few ids are broadcast and only their texts are shuffled.  An id with both labels counts for both.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("label"))
    known = known.where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id"))).distinct()
    picked = [
        known.where(F.col("label") == value).orderBy(F.xxhash64("id"), "id").limit(most_of_each) for value in (0, 1)
    ]
    picked = F.broadcast(picked[0].union(picked[1]))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(picked, F.col("doc_id") == F.col("id"))
    one = F.min(F.struct(F.xxhash64("text"), "text")).alias("one")
    return found.groupBy("id", "label").agg(one).select(F.col("one.text").alias("text"), "label")


def label_share(labels: DataFrame, label: str) -> float:
    """Share of label 1 among all rows that may be learnt from; one half without any."""
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id").cast("long")))
    share = known.agg(F.avg(F.col(label).cast("double")).alias("share")).first()["share"]
    return 0.5 if share is None else float(share)
