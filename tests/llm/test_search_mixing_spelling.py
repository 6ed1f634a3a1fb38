"""Ranked search, source mixing and spelling variants against brute force, and on rows of all kinds."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from bibspan.llm import queries, search
from bibspan.llm.mixing import mixed, numbered_sources, counted_rows, taken_words, with_targets
from bibspan.llm.search import ranked_documents
from bibspan.llm.spelling import edge_nodes, near_words, pairs_of_nodes, roots, spelling_variants, trie_nodes
from tests.conftest import SF_DIR, plan

CLASHING = ("number", "n", "item", "rank", "score", "copies", "place", "h1", "word", "form", "_id", "span", "size", "taken", "id")


def documents(spark, rows):
    """doc_id, text and source, and columns named like those the operators use inside."""
    made = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return made.withColumns({c: F.lit("x") for c in CLASHING})


def ranked_by_force(docs, items):
    terms = [Counter(re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lowered(t or ""))) for _, t in docs]
    n = [sum(c.values()) for c in terms]
    n_docs, n_terms = sum(x > 0 for x in n), sum(n)
    df = Counter(t for c in terms for t in c)
    found = []
    for item, text in items:
        scores = []
        asked = re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lowered(text or ""))
        for (doc_id, _), own, size in zip(docs, terms, n):
            score = 0
            for t in asked:
                if own[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (1_000_000_000 * own[t] // (1000 * own[t] + 8 * (25 + 75 * size * n_docs // n_terms)))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        found += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scores)[:10])]
    return sorted(found, key=repr)


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def odd_texts(rng, n=120):
    words = ["".join(rng.choice(list("abcdeÉé9"), int(rng.integers(1, 4)))) for _ in range(60)]
    rows = [(k, " ".join(rng.choice(words, int(rng.integers(1, 60)))) + rng.choice([".", "", " X-Y"])) for k in range(n)]
    rows += [(500 + k, rows[3][1]) for k in range(30)] + [(None, rows[4][1])] * 30 + [(9, rows[9][1])] * 3 + [(9, "a b c")]
    return rows + [(600, None), (601, ""), (602, "-- ..."), (603, " ".join(["abc"] * 3000 + words))]


@pytest.mark.parametrize("item_bytes", [search.ITEM_BYTES, 200])
def test_ranked_documents(spark, item_bytes):
    rng = np.random.default_rng(4)
    docs = odd_texts(rng)
    items = [(k, " ".join(t.split()[:8])) for k, (_, t) in enumerate(docs[:12])] + [(90, "a a a B"), (91, ""), (92, None), (93, "none such zzzz")]
    made = documents(spark, [(i, t, "s") for i, t in docs])
    asked = spark.createDataFrame(items + items[:2], "item_id long, text string").withColumn("rank", F.lit(1)).withColumn("item", F.lit(2))
    found = ranked_documents(made, asked, item_bytes)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=repr) == ranked_by_force(docs, items)
    assert ranked_documents(made.limit(0), asked).count() == 0 and ranked_documents(made, asked.limit(0)).count() == 0


def test_bounds_are_never_below_the_score(spark, monkeypatch):
    """Also with so few coordinates that nearly all terms share theirs."""
    monkeypatch.setattr(search, "COORDINATE_BITS", 4)
    rng = np.random.default_rng(5)
    docs = odd_texts(rng, 60)
    terms = search.WordHasher("alphanumeric")
    import pyarrow as pa

    data, offsets = search.utf8(pa.array([t for _, t in docs], pa.string()))
    hashes, starts = terms.words(data, offsets)
    document = np.repeat(np.arange(len(docs)), np.diff(starts))
    place, times, begin = search.sketches(hashes, document, len(docs))
    for d in range(len(docs)):
        own = hashes[starts[d] : starts[d + 1]]
        kept = dict(zip(place[begin[d] : begin[d + 1]].tolist(), times[begin[d] : begin[d + 1]].tolist()))
        for term, count in zip(*np.unique(own, return_counts=True)):
            assert kept[int(search.coordinates(np.array([term]))[0])] >= min(count, search.MOST_TIMES)


def mix_rows(rng):
    rows = [(k, " ".join("w" for _ in range(int(rng.integers(0, 90)))), rng.choice(["a", "b", "c", "hot", "hot", "hot"])) for k in range(300)]
    rows += [(k, "one two three", None) for k in range(1000, 1005)] + [(None, "x y z", "copies")] * 2500
    return rows + [(2000, None, "d"), (2001, "", "d"), (2002, "word " * 20_000, "long"), (7, "p q", "a"), (7, "p q", "a"), (7, "r s t", "b")]


def test_mixing(spark):
    rows = mix_rows(np.random.default_rng(6))
    docs = documents(spark, rows)
    mix = mixed(docs, block=64)
    found = [r.asDict() for r in taken_words(mix).collect()]
    assert len(found) == len(rows) and list(found[0]) == ["doc_id", "size", "source_size", "target", "taken"]
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    names = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        weight = sum(weights[s] for s in names if s not in capped)
        new = {s for s in names if s not in capped and weights[s] * left / weight > 3 * sizes[s]}
        if not new:
            break
        capped |= new
    targets = {s: 3.0 * sizes[s] if s in capped else weights[s] * left / weight for s in names}
    assert sorted((r["source"] or "", r["target"]) for r in mix.sources.collect()) == sorted((s or "", t) for s, t in targets.items())
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in found)
    assert sum(r["taken"] for r in found) == sum(r["words"] for r in mix.sources.select("words").collect())
    by_target = defaultdict(int)
    for r in found:
        by_target[r["source_size"], r["target"]] += r["taken"]
    assert all(abs(taken - target) <= 0.5 for (_, target), taken in by_target.items())
    again = mixed(docs.repartition(5, "text"), block=64)
    assert sorted(map(tuple, again.schedule.collect()), key=repr) == sorted(map(tuple, mix.schedule.collect()), key=repr)


def test_the_schedule_is_even(spark):
    """Every slot takes one block, wholly but for a source's last, and any stretch has the shares of the whole."""
    rows = [(k, "w " * 40, s) for k, s in enumerate(["a"] * 500 + ["b"] * 300 + ["c"] * 200)]
    mix = mixed(documents(spark, rows), block=32)
    slots = {}
    for r in mix.schedule.collect():
        own = slots.setdefault(r["slot"], [r["number"], r["block"], 0])
        assert own[:2] == [r["number"], r["block"]]
        own[2] += r["words"]
    sources = {r["number"]: r for r in mix.sources.collect()}
    for number, r in sources.items():
        blocks = sorted((b, w) for n, b, w in slots.values() if n == number)
        assert [b for b, _ in blocks] == list(range(r["blocks"])) and all(w == 32 for _, w in blocks[:-1])
    order = [slots[k][0] for k in sorted(slots)]
    for number, r in sources.items():
        share = r["blocks"] / len(order)
        for at in range(0, len(order) - 200, 100):
            assert abs(order[at : at + 200].count(number) - 200 * share) <= 16


def test_mixing_of_nothing_runs_no_python(spark):
    docs = documents(spark, [(1, "a b", "s")])
    assert taken_words(mixed(docs.limit(0))).count() == 0
    only_empty = taken_words(mixed(documents(spark, [(1, "", "s"), (2, None, None)]))).collect()
    assert [(r["size"], r["taken"], r["target"]) for r in only_empty] == [(0, 0, 0.0)] * 2
    text = plan(taken_words(mixed(docs)))
    assert "Python" not in text and "Arrow" not in text and "Cartesian" not in text and "NestedLoop" not in text


def test_targets_equal_in_any_order_of_rows(spark):
    docs = documents(spark, mix_rows(np.random.default_rng(8)))
    one = with_targets(numbered_sources(counted_rows(docs)))
    two = with_targets(numbered_sources(counted_rows(docs.orderBy(F.desc("doc_id")))))
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def variants_by_force(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    words = sorted(counts)
    near = {w: [] for w in words}
    for w in words:
        for v in words:
            if w != v and abs(len(w) - len(v)) <= 1 and one_apart(w, v):
                near[w].append(v)
    forms = {}
    for w in words:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best and counts[best] >= 10 * counts[w] else None
    found = []
    for w in words:
        root = w
        while forms[root]:
            root = forms[root]
        found.append((w, forms[w], root, counts[w], len(near[w]), counts.get(forms[w])))
    return found


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return any(a[:k] + a[k + 1 :] == b for k in range(len(a)))


def spelled(rng):
    """A few roots, each with ever rarer variants of variants, some with equal letters in a row."""
    letters = list("abéß÷é")
    docs = []
    for k in range(40):
        word = "".join(rng.choice(letters, int(rng.integers(6, 10))))
        line, often = [], 300
        while often >= 2:
            line += [word] * often
            at = int(rng.integers(0, len(word)))
            word = [word[:at] + word[at + 1 :], word[:at] + word[at] + word[at:], word[:at] + "z" + word[at + 1 :]][int(rng.integers(0, 3))]
            often //= 11 if rng.random() < 0.7 else 3
        docs += [(k * 7 + j, " ".join(line[j::7])) for j in range(7)]
    return docs + [(None, "Aaaaaaa aaaaaaaa AAAAAAAA aaaaaaa short"), (1, None), (2, ""), (3, "x" * 5000 + " " + "x" * 5000), (3, "x" * 4999 + "," + "x" * 4999)]


def test_spelling_variants(spark):
    docs = spelled(np.random.default_rng(9))
    found = spelling_variants(documents(spark, [(i, t, "s") for i, t in docs]))
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got, want = sorted(map(tuple, found.collect())), variants_by_force(docs)
    assert [g for g in got] == want
    assert any(f and f != r for _, f, r, *_ in want) and any(n > 2 for *_, n, _ in want)
    assert spelling_variants(documents(spark, [(1, None, "s")])).count() == 0


def test_spelling_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    got = sorted(map(tuple, queries.QUERIES["op13_spelling_variants"](spark, SF_DIR).collect()))
    assert len(got) > 1000 and got == variants_by_force(docs)


def test_trie_nodes_are_the_same_in_any_number_of_ranges(spark):
    """Equal beginnings have equal nodes and different ones different nodes, also over edges of ranges."""
    rng = np.random.default_rng(10)
    words = sorted({"".join(rng.choice(list("ab"), int(rng.integers(7, 12)))) for _ in range(600)})
    made = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    for n in ("1", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            rows = trie_nodes(made, F.col("word"), "t").collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        nodes = {}
        for r in rows:
            assert len(r["nodes"]) == len(r["word"]) + 1
            for k, node in enumerate(r["nodes"]):
                assert nodes.setdefault(node, r["word"][:k]) == r["word"][:k]
        assert len(nodes) == len({w[:k] for w in words for k in range(len(w) + 1)})
        assert [r["word"] for r in sorted(rows, key=lambda r: r["id"])] == words
    assert edge_nodes(["ab", "abc", "b"]) == [[0, 1, 2], [0, 1, 2, 3], [0, 4]]


def test_roots_of_long_ways(spark):
    forms = spark.createDataFrame([(k, k + 1) for k in range(13)], "id long, form long")
    assert sorted(map(tuple, roots(forms).collect())) == [(k, 13) for k in range(13)]


def test_near_words_of_one_pair(spark):
    words = spark.createDataFrame([("aaaaaaa", 5), ("aaaaaaaa", 2), ("aaaabaa", 5)], "word string, n long")
    numbered = trie_nodes(words, F.col("word"), "t")
    names = {r["id"]: r["word"] for r in numbered.collect()}
    found = {names[r["id"]]: (r["n_near"], r["form_n"], names[r["form"]]) for r in near_words(pairs_of_nodes(numbered)).collect()}
    assert found == {"aaaaaaa": (2, 5, "aaaabaa"), "aaaaaaaa": (1, 5, "aaaaaaa"), "aaaabaa": (1, 5, "aaaaaaa")}
