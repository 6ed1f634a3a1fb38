"""Extra columns of any name, nulls, empty and very long texts, repeated rows and empty tables, through every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from bibspan.llm import quality, toxicity
from bibspan.llm.bpe import encode_texts
from bibspan.llm.decontaminate import contained_windows
from bibspan.llm.line_dedup import without_repeated_blocks
from bibspan.llm.main_text import fit as main_text_of, with_main_text
from bibspan.llm.mixing import mixed, taken_words
from bibspan.llm.search import ranked_documents
from bibspan.llm.set_join import similar_sets
from bibspan.llm.spelling import spelling_variants
from bibspan.llm.tiles import near_vectors
from bibspan.llm.token_files import read_token_files, write_token_files
from bibspan.llm.warc import read_chunks, stored_records, with_record_types, write_archives
from bibspan.session import fresh_folder

CLASHING = (
    "label _id _key _gone _score _hits _items _n_words _deleted count key gone mark run start stop first lines words ids decoded "
    "n k g token pos hits items shard bits id picked h h1 h2 one two place span number copies digest part html_ payload target"
).split()

PASSAGE = " ".join(f"passage{k}" for k in range(60))
TEXTS = [
    (1, f"You idiot.\n{PASSAGE}\nend", "en", "a"), (2, f"begin\n{PASSAGE}\nYou are fine.", "en", "b"), (2, f"begin\n{PASSAGE}\nYou are fine.", "en", "b"),
    (3, None, "de", None), (4, "", None, "a"), (None, PASSAGE, "fr", "a"), (5, "w " * 200_000, "en", "c"), (6, "\n \t", "en", "c"), (7, "中文。" * 500, "zh", "c"),
]


def documents(spark, clashing):
    rows = [(*r, len(r[1] or "")) for r in TEXTS]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit(f"own {c}") for c in CLASHING}) if clashing else docs


def others(spark, clashing):
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in (1, 2, 4, 5, 6, 7)] + [(None, 1, None)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "passage3 passage4 passage5"), (2, None), (None, "w w w"), (1, "passage3 passage4 passage5")], "item_id long, text string")
    if clashing:
        labels, items = (df.withColumns({c: F.lit("x") for c in CLASHING}) for df in (labels, items))
    return labels, items


def token_files(spark, docs):
    folder = fresh_folder(spark, "tokens")
    write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_token_files(spark, folder)


def warc(spark, docs):
    pages = docs.withColumnsRenamed({"doc_id": "page_id", "text": "html", "lang": "url"})
    folder = fresh_folder(spark, "warc")
    write_archives(with_record_types(pages), folder)
    return stored_records(read_chunks(spark, folder, with_payload=False))


def vectors(docs):
    vector = F.when(F.col("text").isNotNull(), F.array(F.length("text").cast("float"), F.lit(1.0).cast("float")))
    return docs.withColumn("vec_id", F.col("doc_id")).withColumn("embedding", vector)


def pages_of(docs):
    html = F.concat(F.lit("<html><nav>menu</nav><article><p>"), "text", F.lit("</p></article></html>"))
    return docs.withColumnsRenamed({"doc_id": "page_id", "lang": "url"}).withColumn("html", html).drop("text")


OPERATORS = {
    "quality": lambda s, d, labels, items: quality.with_quality(d, quality.fit(d, labels)).select("doc_id", F.round("score", 6).alias("score")),
    "set_join": lambda s, d, labels, items: similar_sets(d, 3, 90),
    "line_dedup": lambda s, d, labels, items: without_repeated_blocks(d, count="count").select("doc_id", "text", "count"),
    "vectors": lambda s, d, labels, items: near_vectors(vectors(d)),
    "warc": lambda s, d, labels, items: warc(s, d),
    "token_files": lambda s, d, labels, items: token_files(s, d),
    "decontamination": lambda s, d, labels, items: contained_windows(d, items).select("doc_id", "n_words", "hits", "items"),
    "bpe": lambda s, d, labels, items: encode_texts(d, public_tokenizers.path("word_bpe_49k.json"), decoded=True).select("doc_id", "ids", "decoded"),
    "html": lambda s, d, labels, items: with_main_text(pages_of(d), main_text_of(pages_of(d))).select("page_id", "text"),
    "toxicity": lambda s, d, labels, items: toxicity.with_toxicity(d, toxicity.fit(d, labels)).select("doc_id", F.round("score", 6).alias("score")),
    "search": lambda s, d, labels, items: ranked_documents(d, items),
    "mixing": lambda s, d, labels, items: taken_words(mixed(d)),
    "spelling": lambda s, d, labels, items: spelling_variants(d),
}
PER_ROW = set(OPERATORS) - {"search", "spelling"}


def found(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operator(spark, name):
    run = OPERATORS[name]
    plain = found(run(spark, documents(spark, False), *others(spark, False)))
    assert plain == found(run(spark, documents(spark, True), *others(spark, True)))
    assert (len(plain) == len(TEXTS)) == (name in PER_ROW)
    empty = documents(spark, True).limit(0)
    assert found(run(spark, empty, *others(spark, True))) == []


def test_pipeline(spark, tmp_path):
    labels, items = others(spark, True)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {}
    for clashing in (False, True):
        docs = documents(spark, clashing)
        for name, stage in corpus_pipeline.STAGES:
            before = docs.columns
            out = str(tmp_path / f"{name}-{clashing}")
            stage(spark, docs, str(tmp_path)).write.parquet(out)
            docs = spark.read.parquet(out)
            if name != "bpe":
                assert docs.columns == before
                if clashing:
                    assert all(r[c] == f"own {c}" for r in docs.collect() for c in CLASHING)
            kept[name, clashing] = sorted(repr(tuple(r)) for r in docs.select("doc_id", *(["text"] if name != "bpe" else ["ids"])).collect())
    assert all(kept[name, False] == kept[name, True] for name, _ in corpus_pipeline.STAGES)
    assert any("None" in r for r in kept["decontamination", True])
