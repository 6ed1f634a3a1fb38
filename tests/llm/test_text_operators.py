"""Set join, line dedup, decontamination and word hashes against brute force on small tables."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bibspan.llm import set_join
from bibspan.llm.common import utf8
from bibspan.llm.decontaminate import contained_windows, hit_report
from bibspan.llm.line_dedup import aligned, without_repeated_blocks
from bibspan.llm.set_join import similar_sets
from bibspan.llm.words import WordHasher
from tests.conftest import plan, rows

DOCS = "doc_id long, text string, n long, k string, token long"
SPACE, ALPHANUMERIC = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def made(spark, texts):
    """Documents with columns named as some inside the operators."""
    return spark.createDataFrame([(i, t, 7, "x", 1) for i, t in texts], DOCS)


def some_texts():
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(400)]
    base = [" ".join(rng.choice(words, 120)) for _ in range(4)]
    texts = []
    for k in range(60):
        own = base[k % 4].split()
        for _ in range(int(rng.integers(0, 4))):
            own[int(rng.integers(120))] = str(rng.choice(words))
        texts.append((k, " ".join(own)))
    texts += [(100, ""), (101, None), (102, " \n\t"), (103, "one"), (104, "ONE"), (105, "one two"), (106, base[0].upper())]
    return texts + [(3, texts[3][1]), (3, "another text of row three"), (None, base[1]), (200, "long " * 30_000)]


def groups_by_force(texts, width, percent):
    sets = []
    for _, t in texts:
        w = re.findall(SPACE, lowered(t))
        n = min(width, len(w))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set())
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(texts):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((least.get(root(k)), i, len(sets[k])) for k, (i, _) in enumerate(texts)), key=repr)


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80)])
def test_similar_sets(spark, width, percent):
    texts = some_texts()
    found = similar_sets(made(spark, texts), width, percent)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert rows(found) == groups_by_force(texts, width, percent)


def test_similar_sets_of_nothing(spark):
    assert similar_sets(made(spark, [])).count() == 0


def test_word_hashes():
    texts = ["Ab ab,AB é", "", None, " ", "x" * 700_000 + " b c", "c"]
    for kind, pattern in (("space", SPACE), ("alphanumeric", ALPHANUMERIC)):
        hashes, starts = WordHasher(kind).words(*utf8(pa.array(texts)))
        words = [re.findall(pattern, lowered(t)) for t in texts]
        assert np.diff(starts).tolist() == [len(w) for w in words]
        flat = [w for own in words for w in own]
        names = {}
        assert all(names.setdefault(w, h) == h for w, h in zip(flat, hashes.tolist()))
        assert len(set(names.values())) == len(names)


def lines(text):
    found = []
    for unit in re.findall(r"[^\n]*?[.!?] |[^\n]*\n|[^\n]+$", text or ""):
        words = tuple(re.findall(SPACE, lowered(unit)))
        if words:
            found.append([words, unit])
        elif found:
            found[-1][1] += unit
    return found


def blocks_by_force(texts, least):
    """Texts without the lines in a block of `least` words that any earlier document has."""
    cut, done = {i: lines(t) for i, t in texts}, {}
    for i, own in cut.items():
        gone, words = set(), [w for w, _ in own]
        for other in (cut[f] for f in cut if f < i):
            for a in range(len(own)):
                for b in range(len(other)):
                    n = 0
                    while a + n < len(own) and b + n < len(other) and words[a + n] == other[b + n][0]:
                        n += 1
                    if sum(map(len, words[a : a + n])) >= least:
                        gone.update(range(a, a + n))
        done[i] = ("".join(u for k, (_, u) in enumerate(own) if k not in gone), len(gone))
    return done


def test_line_dedup(spark):
    rng = np.random.default_rng(2)
    pool = [" ".join(f"p{k}x{j}" for j in range(int(rng.integers(2, 12)))) for k in range(30)]
    texts = []
    for i in range(40):
        own = [f"own{i} line{j} goes here" for j in range(4)]
        at = int(rng.integers(0, 20))
        own[2:2] = pool[at : at + int(rng.integers(0, 8))]
        texts.append((i, "\n".join(own) if i % 2 else ". ".join(own) + "."))
    texts += [(50, None), (51, ""), (52, "\n\n"), (53, texts[1][1]), (54, (pool[0] + "\n") * 500)]
    found = without_repeated_blocks(made(spark, texts), 12, "gone")
    assert found.columns == ["doc_id", "text", "n", "k", "token", "gone"]
    want = blocks_by_force(texts, 12)
    got = {r["doc_id"]: (r["text"], r["gone"]) for r in found.collect()}
    assert got.pop(50) == (None, 0) and want.pop(50)
    assert got.pop(52) == ("\n\n", 0) and want.pop(52)
    assert got == want and got[53][0] == "" and sum(n for _, n in got.values()) > 50


def test_line_dedup_rows_without_an_order(spark):
    block = " ".join(f"w{k}" for k in range(60))
    texts = [(None, block), (1, block), (1, block), (None, block), (2, f"before it\n{block}\nafter it")]
    got = rows(without_repeated_blocks(made(spark, texts)).select("doc_id", "text"))
    want = [(1, block), (1, block), (2, "before it\nafter it"), (None, block), (None, block)]
    assert got == sorted(want, key=repr)
    assert without_repeated_blocks(made(spark, [])).count() == 0


def test_alignment():
    assert aligned(list("abcxde"), list("abydec")) == [(0, 0), (1, 1), (4, 3), (5, 4)]
    assert aligned([], [1]) == [] and aligned([1, 1, 1], [1, 1]) == [(0, 0), (1, 1)]


ITEMS = [("b", "One two three four five six seven eight nine ten eleven"), ("a", "short item"), ("c", ""), ("d", None),
         ("e", "short item"), (None, "hidden away"), ("a", "short item"), ("f", "solo")]


@pytest.mark.parametrize("item_bytes", [1 << 20, 30])
def test_contained_windows(spark, item_bytes):
    texts = [
        (1, "x one two three four five six seven eight nine ten, y"), (2, "two three four five six seven eight nine ten eleven"),
        (3, "one two three"), (4, "A SHORT-ITEM, and a short item"), (5, None), (6, ""), (7, "they are hidden away here"),
        (8, "solo"), (8, "solo"), (None, "short item"), (9, "one two three four five six seven eight nine ten eleven " * 3_000),
    ]
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    docs = made(spark, texts).withColumnRenamed("n", "n_words")
    found = contained_windows(docs, items, item_bytes=item_bytes)
    want = []
    for i, t in texts:
        words, hit, ids = re.findall(ALPHANUMERIC, lowered(t)), set(), set()
        for item, text in ITEMS:
            own = re.findall(ALPHANUMERIC, lowered(text))
            m = min(len(own), 10)
            for k in range(len(own) - m + 1) if own else ():
                for p in range(len(words) - m + 1):
                    if words[p : p + m] == own[k : k + m]:
                        hit.update(range(p, p + m))
                        ids.add(item)
        want.append((bool(hit), i, ",".join(sorted(ids - {None})), len(hit), len(ids - {None}), len(words)))
    import hashlib

    want = sorted(((a, i, hashlib.sha256(s.encode()).hexdigest(), h, n, w) for a, i, s, h, n, w in want), key=repr)
    report = hit_report(found)
    assert rows(report.select("contaminated", "doc_id", "items_sha256", "n_hit", "n_items", "n_words")) == want
    assert sorted(report.columns) == ["contaminated", "doc_id", "items_sha256", "n_hit", "n_items", "n_words"]


def test_contained_windows_of_nothing(spark):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    assert contained_windows(made(spark, []), items).count() == 0
    assert hit_report(contained_windows(made(spark, [(1, "short item")]), items.limit(0))).first()["n_hit"] == 0


def test_index_lists_of_sets_carry_numbers(spark):
    """Postings and pivots hold classes by number, not by the 128 bits that name a set."""
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(k, text if k < 3 else f"{text} end{k}") for k in range(6)], "doc_id long, text string")
    join = set_join.SetJoin(docs, 3, 90)
    tables, kept = {}, set_join.written
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(set_join, "written", lambda df, name: tables.setdefault(name, kept(df, name)))
        found = {r["doc_id"]: r["component_id"] for r in join.run().collect()}
    assert found == dict.fromkeys(range(6), 0)
    assert {dict(tables[t].dtypes)["k"] for t in ("postings", "listed", "list-members")} == {"bigint"}


def test_index_entries_are_matched_without_a_filter_of_fixed_size(spark):
    """Such a filter fills up, and what it lets through in vain grows with the square of the tables."""
    words = [f"w{k}" for k in range(60)]
    docs = spark.createDataFrame([(k, " ".join([*words, f"end{k}"])) for k in range(6)], "doc_id long, text string")
    plans, kept = {}, set_join.written

    def seen(df, name):
        plans.setdefault(name, plan(df))
        return kept(df, name)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(set_join, "written", seen)
        join = set_join.SetJoin(docs, 3, 90)
        classes = join.classes()
        firsts = classes.select(F.col("k").alias("key"), F.col("doc_id").alias("first"), F.col("doc_id").alias("k"))
        found = join.postings(classes, firsts).collect()
    assert "MapInArrow" in plans["sets"] and "MapInArrow" not in plans["postings"]
    ordered = {r["doc_id"]: r["prefix"] for r in classes.collect()}
    often = Counter(t for own in ordered.values() for t in own)
    want = {(t, k, p) for k, own in ordered.items() for p, t in enumerate(own) if often[t] > 1}
    assert want and len(found) == len(want) and {(r["token"], r["k"], r["pos"]) for r in found} == want
    assert {r["n"] for r in found} == {59}


def test_batches_for_python_are_small_whatever_the_texts(spark):
    """Ten thousand long texts would otherwise be one batch, held twice by every task."""
    docs = spark.range(0, 4000, 1, 1).selectExpr("id as doc_id", "repeat('word ', 1000) as text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "bytes": [batch.nbytes]})

    found = docs.mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r["rows"] for r in found) == 4000
    assert max(r["bytes"] for r in found) < 5 << 20
