"""Quality and toxicity: accuracy on rows they have not learnt from, and rows of all kinds."""

import os
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from bibspan.llm import quality, queries, toxicity
from bibspan.llm.labelled import training_rows
from bibspan.llm.words import WordHasher

SF = "/root/testdata/sf0.01"


def compared(spark, name, label):
    found = queries.QUERIES[name](spark, SF)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    known = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    found = found.collect()
    assert len(found) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    return [(r["predicted"], known[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in known]


def test_quality(spark):
    pairs = compared(spark, "op1_quality", "quality")
    assert np.mean([p == y for p, y in pairs]) >= 0.95


def test_toxicity(spark):
    pairs = compared(spark, "op10_toxicity", "toxic")
    clean = [p for p, y in pairs if not y]
    assert np.mean([p == y for p, y in pairs]) >= 0.9 and np.mean(clean) <= 0.05


def test_held_out_rows_are_not_learnt_from(spark):
    docs = spark.createDataFrame([(k, str(k)) for k in range(200)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    found = [int(r["text"]) for r in training_rows(docs, labels, "toxic", 500).collect()]
    assert set(found) == {k for k in range(200) if zlib.crc32(str(k).encode()) % 4 != 2}
    assert training_rows(docs, labels, "toxic", 10).count() == 20


def odd(spark):
    rows = [(1, "", "a"), (1, "", "a"), (2, None, "b"), (None, "word", "c"), (3, "long text " * 30_000, "d"), (4, "中文 \x00", "e")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string")


def test_odd_rows_and_too_few_labels(spark):
    docs = odd(spark)
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    for with_score, model in (
        (toxicity.with_toxicity, toxicity.fit(docs, labels)), (toxicity.with_toxicity, toxicity.fit(docs, labels.limit(0))),
        (quality.with_quality, quality.fit(docs, labels)), (quality.with_quality, quality.fit(docs.limit(0), labels)),
    ):
        found = with_score(docs, model).collect()
        assert len(found) == 6 and all(0 <= r["score"] <= 1 for r in found)
        assert with_score(docs.limit(0), model).count() == 0


def test_insults_with_gaps_and_letters_put_in():
    rng = np.random.default_rng(0)
    syllables = "ba do ki lu mo ne ra si tu ve".split()
    word = lambda: "".join(rng.choice(syllables, int(rng.integers(1, 5))))
    clean = [" ".join(word() for _ in range(60)) for _ in range(150)]
    bad = ["wretch", "crooked", "filthy"]
    toxic = [t.replace(" ", f" {bad[k // 7 % 3]} ", 1) for k, t in enumerate(clean[:90])]
    model = toxicity.train(toxic + clean[60:], [1] * 90 + [0] * 90, 0.3)
    score = lambda t: float(toxicity.scores([t], model.plain())[0])
    base = max(score(t) for t in clean[60:])
    for said in ("wretch", "Wrettch", "wre.tch", "w r e t c h", "wre tch", "cro-oked", "filxthy", "FILTHY!", "fil thy"):
        assert score(f"bado kilu {said} mone") > max(base, 0.3), said


def test_toxic_phrases_of_ordinary_words():
    """No word tells by itself; only those that stand together do."""
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice("ba do ki lu mo ne ra si tu ve".split(), 3)) for _ in range(80)] + ["wants", "nobody", "here"]
    clean = [" ".join(rng.choice(words, 60)) for _ in range(300)]
    toxic = [" ".join([*t.split()[:30], "nobody wants here", *t.split()[30:]]) for t in clean[:120]]
    model = toxicity.train(toxic + clean[120:], [1] * 120 + [0] * 180, 0.3)
    found = toxicity.scores([" ".join([*t.split()[:20], "nobody wants here", *t.split()[20:]]) for t in clean[200:]], model.plain())
    assert (found > np.quantile(toxicity.scores(clean[200:], model.plain()), 0.95)).mean() > 0.3


def test_recall_and_false_alarms_in_each_language(spark):
    """On rows that are not learnt from; a few English labels mark texts without any insult."""
    sf = "/root/testdata/sf0.1"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["toxic"] is not None]
    own = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    made = spark.createDataFrame([(i, docs[i]["text"]) for i, _ in rows], "doc_id long, text string")
    model = toxicity.fit(made, spark.createDataFrame(rows, "doc_id long, toxic int")).plain()
    for lang in ("en", "de", "fr", "es"):
        of = {label: [docs[i]["text"] or "" for i, y in rows if own(i) and y == label and docs[i]["lang"] == lang] for label in (0, 1)}
        assert (toxicity.scores(of[1], model) >= 0.3).mean() >= 0.9, lang
        assert (toxicity.scores(of[0], model) >= 0.3).mean() <= (0.05 if lang == "fr" else 0.02), lang


def test_kernel_sums_are_the_machine():
    codes, sentence, document, n_words = toxicity.places(["An idiot. Idxiot clownish!", "", "ab", "w" * 30 + " id iot"])
    assert document.tolist() == [0, 0, 2, 3] and n_words.tolist() == [2, 2, 1, 3]
    strings = [codes[sentence == k] for k in range(len(document))]
    used, table = toxicity._features(strings)
    weights = np.zeros(1 << toxicity.HASH_BITS, np.float32)
    weights[used] = np.random.default_rng(1).normal(size=len(used))
    one = toxicity.decisions(*toxicity.laid(strings), len(strings), weights, 0.5)
    assert np.allclose(one, table @ weights[used] + 0.5, atol=1e-3)


def test_a_text_is_scored_by_itself():
    """Neighbours in a batch, repeated words and signs do not change a score."""
    rng = np.random.default_rng(4)
    weights = rng.normal(size=1 << toxicity.HASH_BITS).astype(np.float32)
    weights[0] = 0
    model = (weights, -1.0, -0.5, np.array([1.0, 0.5]), 0.1)
    texts = ["One two three. Four", "", "x", "ÀÉ ß 中文 \U0001f600 ok", "a b c d e", "same same same same", "word " * 3000, "\x00 \n\n.!?"]
    alone = np.concatenate([toxicity.scores([t], model) for t in texts])
    assert np.allclose(toxicity.scores(texts, model), alone, atol=1e-6)
    assert np.allclose(toxicity.scores(["same same same", "same"], model)[0], alone[5])
    assert np.allclose(toxicity.scores(["i d i o t", "i.d.i.o.t"], model)[0], toxicity.scores(["idiot"], model)[0])


def test_repeated_ids_do_not_enlarge_the_sample(spark):
    docs = spark.range(2000).select((F.col("id") % 4).alias("doc_id"), F.col("id").cast("string").alias("text"), F.lit(1).alias("label"))
    labels = spark.createDataFrame([(k, k % 2) for k in range(4)], "doc_id long, toxic int").withColumn("id", F.lit("x"))
    assert training_rows(docs, labels, "toxic", 5).count() <= 4


def test_statistics_of_a_text():
    batch = pa.RecordBatch.from_pydict({"text": ["Ab ab\nAB cd!", "", None]})
    found = dict(zip(quality.NAMES, quality.statistics(batch, WordHasher("space"))[0]))
    assert found["share_upper"] == 3 / 12 and found["share_shout"] == 1 / 12
    assert found["distinct_words"] == 0.5 and found["top_word"] == 0.75 and round(float(np.exp(found["words"])), 6) == 5


def test_flat_trees_learn_a_corner():
    rng = np.random.default_rng(2)
    x = rng.uniform(size=(3000, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 2] < 0.3)).astype(float)
    trees = quality.train(x[:2000], y[:2000], np.ones(2000))
    assert (((quality.scores(x[2000:], *trees.plain()) > 0.5) == y[2000:]).mean()) > 0.97


def test_toxicity_is_learnt_in_a_task(spark, monkeypatch):
    """Neither the texts nor what learning takes are in the driver: its memory is what the check found too small."""

    def train(texts, labels, share, model=toxicity.Model()):
        model.bias, model.offset = float(__import__("os").getpid()), float(sum(labels) * 1000 + len(texts))
        return model

    monkeypatch.setattr(toxicity, "train", train)
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = spark.range(40).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    model = toxicity.fit(docs, labels)
    rows = training_rows(docs, labels, "toxic", 100).collect()
    assert model.offset == sum(r["label"] for r in rows) * 1000 + len(rows) and model.bias != os.getpid()


def most_held(work) -> tuple[object, int]:
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_learning_copies_no_matrix_of_all_sentences():
    """The pipeline was stopped for an executor's memory while a task learnt: several copies of what it learns from were held."""
    rng = np.random.default_rng(6)
    x = np.hstack([rng.normal(size=(20_000, 100)), np.ones((20_000, 1))])
    y = np.where(x[:, 0] + 0.3 * x[:, 1] > 0.2, 1.0, -1.0)
    w, held = most_held(lambda: toxicity.svm(x, y, np.ones(len(x))))
    assert held < x.nbytes / 2
    assert np.mean((x @ w > 0) == (y > 0)) > 0.98

    codes, sentence, _, n_words = toxicity.places(["abdom kilu mone " * 4, "lu mi " * 5 + "ne"] * 2000)
    marks = [np.frombuffer(bytes([toxicity._BEGINS, *m]), np.uint8) for m in rng.integers(1, 27, (300, 8)).tolist()]
    marks[0] = codes[:12].copy()
    used, table = toxicity._features(marks)
    found, held = most_held(lambda: toxicity._products(codes, sentence, len(n_words), used, table))
    assert held < found.nbytes + 2 * table.nbytes + 20e6
    strings = [codes[sentence == k] for k in (0, 1, len(n_words) - 1)]
    own, counts = toxicity._features([np.trim_zeros(s, "b") for s in strings])
    wide = np.zeros((2, 1 << toxicity.HASH_BITS), np.float32)
    for k, row in enumerate(counts):
        wide[0], wide[1] = 0, 0
        wide[0, own] = row
        for m in (0, 1):
            wide[1], wide[1, used] = 0, table[m]
            assert np.isclose(found[(0, 1, len(n_words) - 1)[k], m], wide[0] @ wide[1], rtol=1e-3, atol=1e-3)


def test_sentences_are_decided_as_their_pieces_lie(monkeypatch):
    monkeypatch.setattr(toxicity, "PIECE_BYTES", 40)
    texts = ["One two. Three four five.", "", "...", "a b c", "word " * 30, "idiot! You are an idiot. ok"]
    side = toxicity.Sentences(texts)
    weights = np.random.default_rng(8).normal(size=1 << toxicity.HASH_BITS).astype(np.float32)
    weights[0] = 0
    codes, sentence, document, _ = toxicity.places(texts)
    assert side.document.tolist() == document.tolist() and len(side.pieces) > 2
    assert np.allclose(side.decided(weights, -1.0), toxicity.decisions(codes, sentence, len(document), weights, -1.0), atol=1e-4)
    words = [bytes(side.word(k)) for k in range(len(side.word_at))]
    at = np.flatnonzero(codes == toxicity._BEGINS)
    assert len(words) == len(at) and side.sentence_of_word.tolist() == sentence[at].tolist()
