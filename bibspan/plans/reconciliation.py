"""Reconciliation of items without identifier: best match by title and authors, then a look into the metadata.

`publications` is a table of known works: doc_id, title, authors (given and family names), doi, issn.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bibspan import fixed_values as fixed
from bibspan.functions import records
from bibspan.operators import linkage, matching
from bibspan.operators.sizing import written
from bibspan.plans import profiles
from bibspan.streaming import resume


def described_publications(publications: DataFrame) -> DataFrame:
    """Works with a DOI, with the text that is searched: title, then authors."""
    text = records.bibliographic_text(F.col("title"), F.nullif(records.author_line(F.col("authors")), F.lit("")))
    known = publications.where(F.col("doi").isNotNull() & F.col("title").isNotNull())
    return known.select("doc_id", text.alias("text"), "title", "doi", "issn")


def asked_items(items: DataFrame) -> DataFrame:
    """Titled items with the text to search for: title, then authors when known."""
    text = records.bibliographic_text(F.col("TITLE"), F.col("DES_ALLPEOPLE"))
    return items.where(F.col("TITLE").isNotNull()).select(F.col("ITEM_ID").alias("item_id"), text.alias("text"))


def best_matches(items: DataFrame, publications: DataFrame, percent_above: int = fixed.MATCH_SCORE_ABOVE) -> DataFrame:
    """One result per item whose best match scores above the threshold, as it is saved."""
    works = written(described_publications(publications), "works")
    best = linkage.best_match(asked_items(items), works.select("doc_id", "text"), percent_above)
    return linkage.match_results(best, works)


def reconciled(results: DataFrame, parsed: DataFrame) -> DataFrame:
    """Records of the metadata that carry the DOI of a best match."""
    return matching.reconciled_in_meta(parsed, written(matching.reconciled_ids(results), "reconciled-ids"))


def rate(found: DataFrame, items: DataFrame) -> DataFrame:
    """How many records were found, of how many items, in percent."""
    return profiles.reconciliation_rate(found, items)


def match_as_they_come(
    spark: SparkSession, items_folder: str, schema, publications: DataFrame, out: str, checkpoint: str
) -> StreamingQuery:
    """Match the items of a folder, go on where the last run ended, and append results to `out`."""
    items = spark.readStream.schema(schema).parquet(items_folder)
    return resume.match_new_items(items, lambda batch: best_matches(batch, publications), out, checkpoint)
