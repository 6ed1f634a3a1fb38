"""Operators on small tables, and properties of the datasets."""

from collections import defaultdict

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from bibspan.operators import (
    dedup,
    groups,
    items as item_ops,
    linkage,
    lookup,
    matching,
    membership,
    sizing,
)
from bibspan.plans import profiles, questions
from tests.conftest import plan, rows

PIDS = "iris_id bigint, iris_type int, id string"


def test_preferred_pids_equal_ranking_all_of_them(data):
    ranked = dedup.one_pid_per_item(item_ops.extract_pids(data.items))
    direct = dedup.one_pid_per_item(item_ops.preferred_pids(data.items))
    assert rows(ranked) == rows(direct)


def test_one_pid_per_item(spark):
    pids = spark.createDataFrame(
        [(1, 35, "isbn:2"), (1, 35, "pmid:12"), (1, 35, "doi:b"), (1, 35, "doi:a"), (2, 41, "isbn:1")], PIDS
    )
    assert rows(dedup.one_pid_per_item(pids)) == rows(
        spark.createDataFrame([(1, 35, "doi:a"), (2, 41, "isbn:1")], PIDS)
    )


def test_one_item_per_pid(spark):
    pids = spark.createDataFrame(
        [
            (1, 57, "doi:a"), (2, 50, "doi:a"), (3, 41, "doi:a"),
            (4, 50, "pmid:1"), (5, 35, "pmid:1"),
            (6, 35, "isbn:1"), (7, 49, "isbn:1"),
            (9, 99, "isbn:2"), (8, None, "isbn:2"),
        ],
        PIDS,
    )
    kept = dedup.one_item_per_pid(pids)
    assert sorted(r["iris_id"] for r in kept.collect()) == [2, 5, 7, 8]
    first = dedup.unique_keep_first(pids)
    assert sorted(r["iris_id"] for r in first.collect()) == [1, 4, 6, 8]


def test_one_record_per_pid(spark):
    matches = spark.createDataFrame(
        [
            ("doi:a", "x", "book chapter", "omid:1", 1, 42),
            ("doi:a", "y", "journal article", "omid:0", 1, 42),
            ("doi:b", "x", "", "omid:3", 2, 35),
            ("doi:b", "y", None, "omid:2", 2, 35),
        ],
        "id string, title string, type string, omid string, iris_id bigint, iris_type int",
    )
    kept = {r["id"]: r["omid"] for r in dedup.one_record_per_pid(matches).collect()}
    assert kept == {"doi:a": "omid:1", "doi:b": "omid:2"}


def test_strict_choice(spark):
    matches = spark.createDataFrame(
        [
            ("doi:blank", "", "omid:1", 1, 50), ("doi:blank", "book", "omid:2", 1, 50),
            ("doi:fit", "book", "omid:3", 2, 35), ("doi:fit", "journal article", "omid:4", 2, 35),
            ("doi:none", "book", "omid:5", 3, 50), ("doi:none", "report", "omid:6", 3, 50),
            ("doi:same", "book", "omid:8", 4, 50), ("doi:same", "book", "omid:7", 4, 50),
            ("doi:alone", "", "omid:9", 5, 50),
        ],
        "id string, type string, omid string, iris_id bigint, iris_type int",
    )
    kept = {r["id"]: r["omid"] for r in dedup.one_record_per_pid_strict(matches).collect()}
    assert kept == {
        "doi:blank": "omid:2", "doi:fit": "omid:4", "doi:same": "omid:7", "doi:alone": "omid:9",
    }


def test_rejected_and_accepted_make_up_all(data):
    for column in ("IDE_DOI", "IDE_PMID", "IDE_ISBN"):
        raw = item_ops.raw_identifiers(data.items, column)
        rejected = item_ops.rejected_identifiers(data.items, column)
        accepted = item_ops.normalized_identifiers(data.items, column)
        assert rejected.count() + accepted.count() == raw.count()


def test_rejected_keeps_items_with_another_valid_value_out(spark):
    items = spark.createDataFrame(
        [(1, "10.1000/a", 35), (1, "n/a", 35), (2, "n/a", 35)],
        "ITEM_ID bigint, IDE_DOI string, OWNING_COLLECTION int",
    )
    rejected = item_ops.rejected_identifiers(items, "IDE_DOI")
    assert [r["ITEM_ID"] for r in rejected.collect()] == [2]


def test_pid_yield_conserves(data):
    for r in item_ops.pid_yield(data.items).collect():
        assert r["raw"] == r["kept"] + r["removed"]


def test_empty_identifier_counts_as_present(spark):
    items = spark.createDataFrame(
        [(1, "", None, None, 35, "x"), (2, None, None, None, 35, "x")],
        "ITEM_ID bigint, IDE_DOI string, IDE_ISBN string, IDE_PMID string, OWNING_COLLECTION int, "
        "OWNING_COLLECTION_DES string",
    )
    assert [r["ITEM_ID"] for r in item_ops.with_pid(items).collect()] == [1]
    assert [r["ITEM_ID"] for r in item_ops.without_pid(items).collect()] == [2]


def test_modes_split_the_items(data):
    n = data.items.count()
    assert item_ops.with_pid(data.items).count() + item_ops.without_pid(data.items).count() == n


def test_ids_are_unique_and_known(data):
    pids = data.pids
    assert pids.where("id is null").count() == 0
    assert pids.count() == pids.select("id").distinct().count() == pids.select("iris_id").distinct().count()
    iim = data.in_meta
    assert iim.count() == iim.select("id").distinct().count()


def test_matched_and_unmatched_make_up_the_pids(data):
    matched = data.in_meta.select("iris_id")
    assert matched.intersect(data.not_in_meta.select("iris_id")).count() == 0
    assert matched.count() + data.not_in_meta.count() == data.pids.count()


def test_citation_identity(data):
    counts = questions.citation_questions(data.citations, data.in_meta).first()
    whole = questions.citation_questions(data.inputs["index"], data.in_meta).first()
    assert counts == whole
    assert counts["total"] == data.citations.count()
    assert counts["total"] == counts["citing"] + counts["cited"] + counts["both"]
    assert counts["both"] > 0


def test_unknown_ends_count_nowhere(spark):
    index = spark.createDataFrame(
        [("1", "a", None), ("2", None, "a"), ("3", None, None), ("4", "a", "x"), ("4", "a", "x")],
        "id string, citing string, cited string",
    )
    members = spark.createDataFrame([("a",), ("a",), (None,)], "omid string")
    counts = questions.citation_questions(index, members).first().asDict()
    assert counts == {"total": 4, "citing": 0, "cited": 2, "both": 0}
    kept = membership.filter_citations(index, membership.members(members))
    assert sorted(r["id"] for r in kept.collect()) == ["1", "2", "4", "4"]


def test_large_sides_give_the_same_results(data, no_auto_broadcast):
    """The shuffled variants of every measured join agree with the broadcast ones."""
    meta, pids = data.inputs["meta"], data.pids
    assert rows(matching.match_meta(meta, pids, limit=0)) == rows(matching.match_meta(meta, pids))
    assert rows(matching.in_meta(meta, pids, data.labels, limit=0)) == rows(data.in_meta)
    flags = membership.end_flags(data.inputs["index"], data.omids, limit=0)
    assert rows(flags) == rows(membership.end_flags(data.inputs["index"], data.omids))
    titles = data.inputs["master"].select("ITEM_ID", "TITLE")
    assert rows(linkage.title_match(titles, data.parsed_meta, limit=0)) == rows(
        linkage.title_match(titles, data.parsed_meta)
    )
    assert "Broadcast" not in plan(matching.match_meta(meta, pids, limit=0))


def test_hot_id_in_the_dump(spark, no_auto_broadcast):
    """A third of all records carry one id; its best record still wins on the shuffled path."""
    many = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("key"),
        F.col("id").alias("n"),
    )
    meta = many.select(
        F.concat(F.lit("omid:br/"), F.lpad(F.col("n").cast("string"), 6, "0"), F.lit(" doi:10.1/"), "key").alias("id"),
        F.lit("t").alias("title"),
        F.when(F.col("n") == 15_000, "journal article").otherwise("book").alias("type"),
    )
    pids = spark.createDataFrame([(1, 35, "doi:10.1/hot"), (2, 35, "doi:10.1/1")], PIDS)
    labels = spark.createDataFrame([(35, "x")], "OWNING_COLLECTION int, OWNING_COLLECTION_DES string")
    for limit in (0, sizing.BROADCAST_BYTES):
        found = matching.in_meta(meta, pids, labels, limit=limit)
        assert {r["id"]: r["omid"] for r in found.collect()} == {
            "doi:10.1/hot": "omid:br/015000", "doi:10.1/1": "omid:br/000001",
        }
        assert matching.match_meta(meta, pids, limit=limit).count() == 10_001


def test_measured_broadcast(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "n bigint, t string")
    size = sizing.measured_bytes(df)
    assert 0 < size < 200
    other = spark.range(1_000_000).withColumnRenamed("id", "n")
    assert "BroadcastHashJoin" in plan(other.join(sizing.broadcast_if_small(df, size), "n"))
    assert sizing.broadcast_if_small(df, size - 1) is df
    assert sizing.measured_bytes(df.where("n > 5")) == 0


def test_unknown_type_code_is_an_error(spark):
    labels = spark.createDataFrame([(35, "article"), (36, None)], "OWNING_COLLECTION int, OWNING_COLLECTION_DES string")
    known = spark.createDataFrame([(1, 35), (2, None), (3, 36)], "n int, code int")
    found = lookup.label_type_codes(known, labels, "code")
    assert rows(found) == [("article", 1), (None, 2), (None, 3)]
    with pytest.raises(PySparkException, match="no label for type code 99"):
        lookup.label_type_codes(spark.createDataFrame([(4, 99)], "n int, code int"), labels, "code").collect()


def test_type_mapping_never_matches_null(spark):
    iim = spark.createDataFrame(
        [(None, ""), ("3.02 Curatela", "book"), ("3.02 Curatela", "report"), (None, None)],
        "iris_type string, meta_type string",
    )
    mapping = lookup.type_mapping(spark)
    assert lookup.matching_types(iim, mapping).count() == 1
    assert lookup.mismatching_types(iim, mapping).count() == 3
    named = profiles.mismatch_breakdown(lookup.mismatching_types(iim, mapping))
    assert {r["meta_type"] for r in named.collect()} == {"", "report", "No type"}


def test_counts_with_nulls(spark):
    df = spark.createDataFrame(
        [("a", "x"), ("a", None), ("b", "x"), ("b", "x"), (None, "y"), (None, "y"), ("c", "z")],
        "k string, v string",
    )
    assert groups.duplicate_rows(df, "k").count() == 6
    distinct = {r["k"]: (r["n_rows"], r["n_values"]) for r in groups.distinct_values(df, "k", "v").collect()}
    assert distinct == {"a": (2, 2), "b": (2, 1), None: (2, 1), "c": (1, 1)}
    ambiguous = groups.ambiguous_keys(df, "k", "v").collect()
    assert [(r["k"], r["n_rows"], r["values"]) for r in ambiguous] == [("a", 2, [None, "x"])]
    assert rows(groups.group_size_distribution(df, "k")) == [(3, 2)]
    assert [tuple(r) for r in groups.top_keys(df, "k", 2).collect()] == [("a", 2), ("b", 2)]
    share = profiles.no_id_type_share(df.withColumnRenamed("k", "OWNING_COLLECTION_DES"))
    assert {r[0]: (r[1], r[2]) for r in share.collect()}[None] == (0, 0.0)


def test_side_by_side_pads_the_shorter(spark):
    left = spark.createDataFrame([("a", 3), ("b", 1)], "meta_type string, len bigint")
    right = spark.createDataFrame([("x", 5)], "iris_type string, len bigint")
    found = profiles.type_ranking_side_by_side(left, right).orderBy("position").collect()
    assert [tuple(r) for r in found] == [(1, "a", 3, "x", 5), (2, "b", 1, None, None)]


def test_year_reports(spark):
    meta = spark.createDataFrame(
        [("2020-01",), ("9999",), (None,), ("1950",), ("1951-02",), ("none",)], "pub_date string"
    )
    years = profiles.meta_years(meta)
    assert profiles.year_anomalies(years).first().asDict() == {"no_year": 2, "future_year": 1}
    assert [tuple(r) for r in profiles.chart_years(years).collect()] == [(1951, 1), (2020, 1)]


def test_best_of_two(spark):
    scored = spark.createDataFrame(
        [(1, "b", 90.0), (1, "a", 90.0), (1, "c", 10.0), (2, "a", 85.0), (3, "a", 86.0), (3, "b", 85.0)],
        "item_id bigint, doc_id string, score double",
    )
    found = {r["item_id"]: (r["doc_id"], r["ambiguous_match"]) for r in linkage.best_of_two(scored, F.lit(85)).collect()}
    assert found == {1: ("a", True), 3: ("a", False)}


def brute_force_best(queries, corpus, percent):
    """Best match by scoring every pair, in plain Python."""
    import math
    import re

    def words(text):
        return {w for w in re.split(r"[^\w]+|_", text.lower()) if w}

    docs = {k: words(t) for k, t in corpus.items() if words(t)}
    df = defaultdict(int)
    for ws in docs.values():
        for w in ws:
            df[w] += 1
    weight = lambda w: int(math.floor(1e6 * math.log((len(docs) + 1) / (df[w] + 1)) + 0.5))
    best = {}
    for q, text in queries.items():
        total = sum(weight(w) for w in words(text))
        scores = [(-sum(weight(w) for w in words(text) & ws), d) for d, ws in docs.items()]
        scores = sorted(s for s in scores if -s[0] * 100 > total * percent)
        if scores:
            tie = len(scores) > 1 and scores[0][0] == scores[1][0]
            best[q] = (scores[0][1], -scores[0][0], total, tie)
    return best


@pytest.mark.parametrize("percent", [0, 50, 85])
def test_best_match_is_exact(spark, percent):
    """Random texts with hot words, copies, unknown words and empty texts."""
    import random

    rng = random.Random(percent)
    vocabulary = ["the", "of", "a"] * 12 + [f"w{i}" for i in range(40)]
    text = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 7)))
    corpus = {i: text() for i in range(150)}
    corpus.update({i: corpus[i % 5] for i in range(150, 220)})
    corpus[220] = " .. "
    queries = {i: text() for i in range(80)}
    queries.update({80: "the", 81: "the of a", 82: "unknown", 83: "w1 unknown", 84: "", 85: corpus[0]})
    q = spark.createDataFrame(list(queries.items()), "item_id bigint, text string")
    c = spark.createDataFrame(list(corpus.items()), "doc_id bigint, text string")
    found = {
        r["item_id"]: (r["doc_id"], r["score"], r["total"], r["ambiguous_match"])
        for r in linkage.best_match(q, c, percent).collect()
    }
    assert found == brute_force_best(queries, corpus, percent)


def test_best_match_feeds_the_reports(spark):
    corpus = spark.createDataFrame(
        [("omid:1", "a rare title", "10.1/A", None), ("omid:2", "other words here", "10.1/b", "1234-5678")],
        "doc_id string, title string, doi string, issn string",
    )
    items = spark.createDataFrame([(1, "A rare title!"), (2, "nothing alike")], "ITEM_ID bigint, TITLE string")
    best = linkage.best_match(
        items.select(F.col("ITEM_ID").alias("item_id"), F.col("TITLE").alias("text")),
        corpus.select("doc_id", F.col("title").alias("text")),
    )
    results = linkage.match_results(best, corpus)
    assert results.columns == ["item_id", "matched_title", "doi", "issn", "ambiguous_match", "score"]
    assert [r["item_id"] for r in results.collect()] == [1]
    assert results.first()["score"] == 100.0
    assert [r["TITLE"] for r in linkage.with_items(results, items).collect()] == ["A rare title!"]
    assert [r["id"] for r in matching.reconciled_ids(results).collect()] == ["doi:10.1/a"]
    assert [r["ITEM_ID"] for r in linkage.unprocessed(items, results).collect()] == [2]


def test_title_match_needs_three_words_doi_and_type(spark):
    items = spark.createDataFrame(
        [(1, 'A "good" title'), (2, "two words"), (3, None), (4, "a line\nbreak title")], "ITEM_ID bigint, TITLE string"
    )
    parsed = spark.createDataFrame(
        [
            ("doi:1", "A 'good' title", "book", "omid:1"), ("doi:2", "A 'good' title", "book", "omid:2"),
            ("pmid:3", "A 'good' title", "book", "omid:3"), ("doi:4", "A 'good' title", "", "omid:4"),
            ("doi:5", "A 'good' title", None, "omid:5"), ("doi:6", "two words", "book", "omid:6"),
            ("doi:7", "a linebreak title", "book", "omid:7"),
        ],
        "id string, title string, type string, omid string",
    )
    found = linkage.title_match(items, parsed)
    assert sorted((r["iris_id"], r["omid"]) for r in found.collect()) == [(1, "omid:1"), (1, "omid:2"), (4, "omid:7")]


def test_ties_do_not_depend_on_order(spark):
    """Records that share id and omid, in any order and for sides of any size: the same one stays."""
    from bibspan.operators import matching

    meta = [("omid:br/1 doi:10.1/a", f"t{k}", "book" if k % 2 else "", f"20{k:02d}") for k in range(8)]
    meta += [(f"omid:br/{k % 2} doi:10.1/b", f"s{k}", "journal article", None) for k in range(6)]
    pids = spark.createDataFrame([(1, 35, "doi:10.1/a"), (2, 35, "doi:10.1/b")], "iris_id long, iris_type int, id string")
    labels = spark.createDataFrame([(35, "1.01 Articolo in rivista")], "OWNING_COLLECTION int, OWNING_COLLECTION_DES string")
    found, strict = set(), set()
    for seed in range(4):
        shuffled = sorted(meta, key=lambda r: hash((seed, r)))
        records = spark.createDataFrame(shuffled, "id string, title string, type string, pub_date string").repartition(3)
        for limit in (0, 1 << 20):
            found.add(tuple(rows(matching.in_meta(records, pids, labels, limit))))
        strict.add(tuple(rows(dedup.one_record_per_pid_strict(matching.match_meta(records, pids)))))
    assert len(found) == 1 and len(found.pop()) == 2 and len(strict) == 1


def test_best_match_of_long_texts(spark):
    """Scores of texts of many thousand words are the sums of the weights of shared words."""
    words = [f"w{k}" for k in range(20_000)]
    queries = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:300]))], "item_id long, text string")
    corpus = [(k, " ".join(words[k:])) for k in range(4)] + [(9, "another text")]
    found = linkage.best_match(queries, spark.createDataFrame(corpus, "doc_id long, text string")).collect()
    assert {r["item_id"]: (r["doc_id"], r["score"] == r["total"], r["ambiguous_match"]) for r in found} == {
        1: (0, True, False), 2: (0, True, False),
    }
