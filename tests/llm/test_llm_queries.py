"""Queries of the operators against their SQL, and the pipeline against what its stages decide."""

import duckdb
import pytest

import corpus_pipeline
from bibspan.llm import queries
from bibspan.llm.bpe import load
from tests.conftest import SF_DIR

TABLES = "documents embeddings pages benchmark labels".split()


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sql, name):
    found = queries.QUERIES[name](spark, SF_DIR)
    expected = sql.execute(queries.ORACLES[name])
    columns = [c[0] for c in expected.description]
    assert sorted(columns) == sorted(found.columns)
    got = sorted(map(tuple, found.select(*columns).collect()), key=repr)
    assert got == sorted(expected.fetchall(), key=repr)


def test_pipeline(spark, sql, tmp_path):
    """Every stage on its own input, written and read again."""
    docs = before = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF_DIR)
        path = str(tmp_path / name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != "bpe":
            assert docs.columns == before.columns
    texts = kept["line_dedup"]
    assert texts.keys() == kept["toxicity"].keys()
    assert all(r["n_chars"] == len(r["text"]) for r in texts.values() if r["text"] != kept["toxicity"][r["doc_id"]]["text"])

    words = {i: r["text"].lower().split() for i, r in texts.items()}
    sets = {i: {tuple(w[k : k + min(5, len(w))]) for k in range(len(w) - min(5, len(w)) + 1)} if w else set() for i, w in words.items()}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and (both := len(sets[a] & sets[b])) and 100 * both >= 80 * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {i: new if r == old else r for i, r in root.items()}
    assert set(kept["ngram_jaccard"]) == {i for i, r in root.items() if i == r}

    contaminated = {r[0] for r in sql.execute(f"select doc_id from ({queries.ORACLES['op7_decontamination']}) where contaminated").fetchall()}
    clean, input_ids = set(kept["decontamination"]), set(kept["ngram_jaccard"])
    assert clean <= input_ids and input_ids - clean <= contaminated
    assert clean & contaminated <= {i for i in clean if texts[i]["text"] != kept["toxicity"][i]["text"]}

    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        library = load(file.read())
    assert kept["bpe"].keys() == clean
    for i, r in kept["bpe"].items():
        assert list(r["ids"]) == library.encode(texts[i]["text"], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF_DIR).count() == 0
