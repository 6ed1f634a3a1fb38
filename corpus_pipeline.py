"""The corpus pipeline: documents in, token ids out, each stage on what the one before kept.

A stage takes the session, the documents so far and the folder of the input tables, and
returns what it keeps with the columns of documents; the last one returns token ids.  Null
and empty texts are documents like others and stay; empty tables give empty results.
"""

import public_tokenizers
from pyspark.sql import functions as F

from bibspan.llm import toxicity
from bibspan.llm.bpe import encode_texts
from bibspan.llm.common import free_name, table
from bibspan.llm.decontaminate import contained_windows
from bibspan.llm.line_dedup import without_repeated_blocks
from bibspan.llm.set_join import similar_sets
from bibspan.operators.sizing import broadcast_if_small, written
from bibspan.session import configured

TOXIC = 0.3
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
TOKENIZER = "word_bpe_49k.json"


def columns(docs):
    """The columns by name, also those with a dot in it."""
    return [F.col(f"`{c}`") for c in docs.columns]


def toxicity_stage(spark, docs, sf_dir):
    """Documents scored below the threshold, by a model of the labels of documents still here."""
    configured(spark)
    model, score = toxicity.fit(docs, table(spark, sf_dir, "labels")), free_name(docs, "score")
    return toxicity.with_toxicity(docs, model, score).where(F.col(score) < TOXIC).drop(score)


def line_dedup_stage(spark, docs, sf_dir):
    """All documents, without blocks of lines that an earlier one has; n_chars follows the text."""
    configured(spark)
    count = free_name(docs, "n_deleted")
    done = without_repeated_blocks(docs, count=count)
    n_chars = F.when(F.col(count) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", n_chars).select(*columns(docs))


def ngram_jaccard_stage(spark, docs, sf_dir):
    """One document, that of the smallest doc_id, of each group of near-duplicates.

    Rows of one doc_id stay or go together, and stay if any of them is to stay; rows with a
    null doc_id stay.
    """
    configured(spark)
    groups = similar_sets(docs, SHINGLE_WORDS, SIMILAR_PERCENT)
    least = groups.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"))
    whose = free_name(docs, "id")
    gone = written(least.where("not stays").select(F.col("doc_id").alias(whose)), "near-duplicates")
    return docs.join(broadcast_if_small(gone), F.col("doc_id") == F.col(whose), "left_anti")


def decontamination_stage(spark, docs, sf_dir):
    """Documents without a word in a window of a benchmark item."""
    configured(spark)
    names = {k: free_name(docs, f"found_{k}") for k in ("words", "hits", "items")}
    found = contained_windows(docs, table(spark, sf_dir, "benchmark"), names=names)
    return found.where(F.size(names["hits"]) == 0).select(*columns(docs))


def bpe_stage(spark, docs, sf_dir):
    """Token ids of every document, with the digest of the text they decode to."""
    configured(spark)
    path = public_tokenizers.path(TOKENIZER)
    docs = docs.select("doc_id", "lang", "source", "text")
    return encode_texts(docs, path, decoded=True).select(
        "doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard", ngram_jaccard_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

# Models, alignments and tokenizers are not to be had in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents table; what a stage keeps is written before the next one reads it."""
    docs = table(configured(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
