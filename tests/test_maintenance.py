"""Prefiltered membership, title classes, bounded matching, updates, published tables, archive filters and damaged rows."""

import os

import pytest
from pyspark.sql import functions as F

from bibspan import schemas
from bibspan.operators import items as item_ops, linkage, matching, membership, prefilter
from bibspan.operators.sizing import written
from bibspan.plans import datasets, questions, reconciliation, updates
from bibspan.sources import sinks, tables
from bibspan.streaming import resume
from tests.conftest import plan, rows
from tests.test_sources import make_tar, make_zip


# Membership


def test_filter_has_no_false_negatives(spark):
    keys = written(spark.range(5000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("omid")), "keys")
    found = prefilter.key_filter(keys, "omid")
    probes = spark.range(100_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("c")).union(spark.createDataFrame([(None,)], "c string"))
    passed = {r["c"] for r in prefilter.possible_members(probes, ["c"], found).collect()}
    assert None not in passed and {f"k{n}" for n in range(5000)} <= passed
    assert len(passed) - 5000 < 0.02 * 95_000
    # However little room it has, it lets all members pass.
    small = prefilter.key_filter(keys, "omid", most_bytes=10 * prefilter.BLOCK_BYTES)
    assert small.blocks == 10
    assert {f"k{n}" for n in range(5000)} <= {r["c"] for r in prefilter.possible_members(probes, ["c"], small).collect()}


def test_filter_of_nothing(spark):
    none = written(spark.createDataFrame([], "omid string"), "none")
    index = spark.createDataFrame([("1", "a", "b")], schemas.INDEX)
    assert membership.filter_citations(index, none, limit=0).count() == 0


def test_only_citations_that_pass_are_shuffled(data, no_auto_broadcast):
    index, omids = data.inputs["index"], data.omids
    few = written(omids.orderBy("omid").limit(20), "few-members")
    likely, found = membership.likely_citations(index, few), membership.filter_citations(index, few, limit=0)
    n, passed, exact = index.count(), likely.count(), found.count()
    assert 0 < exact <= passed < exact + 0.03 * n
    assert rows(found) == rows(membership.filter_citations(index, few))
    assert "hashpartitioning" not in plan(likely)
    text = plan(found)
    assert text.index("BroadcastHashJoin") > text.index("SortMergeJoin") and text.count("BroadcastHashJoin") == 2
    assert rows(membership.filter_citations(index, omids, limit=0)) == rows(data.citations)


def test_questions_take_the_written_members(data):
    for question in (questions.question_4, questions.question_5, questions.citation_questions):
        assert rows(question(data.citations, data.in_meta)) == rows(question(data.citations, omids=data.omids))


# Titles and best matches


def test_a_title_on_many_items_and_records_costs_their_sum(spark):
    n = 10_000
    items = spark.range(n).select(F.col("id").alias("ITEM_ID"), F.lit("a title of all").alias("TITLE"))
    parsed = spark.range(n).select(
        F.concat(F.lit("doi:"), "id").alias("id"), F.lit("a title of all").alias("title"), F.lit("book").alias("type"),
        F.concat(F.lit("omid:"), "id").alias("omid"),
    )
    found = linkage.title_classes(items, parsed)
    assert found.classes.collect() == [("a title of all", n, n)]
    assert found.items.count() + found.records.count() == 2 * n


@pytest.mark.parametrize("limit", [0, 1 << 26])
def test_classes_expand_to_the_matches(data, limit, no_auto_broadcast):
    titles = data.inputs["master"].select("ITEM_ID", "TITLE")
    found = linkage.title_classes(titles, data.parsed_meta, limit)
    assert rows(found.expanded(limit)) == rows(linkage.title_match(titles, data.parsed_meta))
    assert found.classes.agg(F.sum(F.col("n_items") * F.col("n_records"))).first()[0] == found.expanded(limit).count()


def test_few_pairs_of_common_words_are_scored(spark, monkeypatch):
    """A query of words that very many documents have in part: only those that can win are scored."""
    words = [f"w{k}" for k in range(12)]
    made = spark.range(4000).select(
        "id", F.array_join(F.filter(F.array(*[F.when(F.pmod(F.xxhash64("id", F.lit(w)), F.lit(8)) > 0, F.lit(w)) for w in words]), lambda w: w.isNotNull()), " ").alias("text")
    )
    corpus = made.select(F.col("id").alias("doc_id"), F.concat(F.col("text"), F.lit(" own"), F.col("id").cast("string")).alias("text"))
    queries = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    scored, original = [], linkage._scored

    def counting(pairs, *rest):
        pairs = written(pairs, "counted-pairs")
        scored.append(pairs.count())
        return original(pairs, *rest)

    monkeypatch.setattr(linkage, "_scored", counting)
    best = linkage.best_match(queries, corpus, 50).collect()
    n_whole = corpus.where(" and ".join(f"text like '%{w} %'" for w in words)).count()
    assert len(best) == 1 and best[0]["score"] == best[0]["total"] and n_whole > 1 and best[0]["ambiguous_match"]
    # About 4,000 documents have some word that is looked up, 2,400 could be above the threshold.
    assert sum(scored) < 2000


def test_pairs_that_share_only_the_rarest_word_are_not_scored(spark, monkeypatch):
    """Every number is in ten documents, but only one of them has the query's name as well."""
    corpus = spark.createDataFrame([(10 * n + c, f"n{n} c{c}") for n in range(40) for c in range(10)], "doc_id long, text string")
    scored, original = [], linkage._scored

    def counting(pairs, *rest):
        scored.append(pairs.count())
        return original(pairs, *rest)

    monkeypatch.setattr(linkage, "_scored", counting)
    best = linkage.best_match(corpus.withColumnRenamed("doc_id", "item_id"), corpus, 50).collect()
    assert sorted((r["item_id"], r["doc_id"]) for r in best) == [(k, k) for k in range(400)]
    assert not any(r["ambiguous_match"] for r in best)
    assert scored[0] <= 400 * linkage.SEEDS and scored[1] < 400


def test_authors_tell_works_of_one_title_apart(spark):
    works = [
        (f"omid:{k}", "Collected essays on history", [("M", "Rossi"), (None, name)], f"10.1/{k}", None)
        for k, name in enumerate(["Verdi", "Bianchi", "Neri"])
    ]
    works += [("omid:9", "Another book", [], "10.1/9", None), ("omid:8", "No doi", [("A", "B")], None, None), ("omid:7", None, None, "10.1/7", None)]
    publications = spark.createDataFrame(works, "doc_id string, title string, authors array<struct<given:string, family:string>>, doi string, issn string")
    items = spark.createDataFrame(
        [(1, "Collected essays on history", "rossi, m; bianchi"), (2, "Collected essays on history", None), (3, None, "x"), (4, "Another book", None)],
        "ITEM_ID long, TITLE string, DES_ALLPEOPLE string",
    )
    found = {r["item_id"]: r for r in reconciliation.best_matches(items, publications).collect()}
    assert found[1]["doi"] == "10.1/1" and not found[1]["ambiguous_match"]
    assert found[2]["ambiguous_match"] and found[4]["doi"] == "10.1/9" and set(found) == {1, 2, 4}


# Updates and published tables


@pytest.mark.parametrize("seed", [1, 2])
def test_build_and_update_equal_a_full_build(spark, data, tmp_path, seed):
    """New shards of metadata and citations, in any division, give what a build of everything gives."""
    old_side = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(5)) > 0
    inputs = {**{n: data.inputs[n] for n in ("master", "identifier", "description", "publisher", "language")}}
    meta, index = data.inputs["meta"], data.inputs["index"]
    out = str(tmp_path / "out")
    datasets.build(spark, inputs | {"meta": meta.where(old_side), "index": index.where(old_side)}, out, ("in_meta", "not_in_meta", "citations"))
    made = datasets.update(spark, out, meta.where(~old_side), index.where(~old_side), index.where(old_side))
    assert rows(made["in_meta"]) == rows(data.in_meta) and rows(made["not_in_meta"]) == rows(data.not_in_meta)
    assert rows(made["citations"]) == rows(data.citations)
    assert rows(tables.read_parquet(spark, f"{out}/citations")) == rows(data.citations)


def test_an_update_touches_only_its_ids(spark, data):
    one = data.in_meta.orderBy("id").first()["id"]
    shard = spark.createDataFrame([(f"omid:a {one}", "new", "journal article", "2020")], schemas.META)
    text = plan(updates.updated_in_meta(data.in_meta, shard, data.pids, data.labels))
    assert "orders.parquet" not in text
    with pytest.raises(ValueError, match="old citations"):
        before = written(spark.createDataFrame([], "omid string"), "none")
        updates.updated_citations(data.citations, data.inputs["index"].limit(0), before, data.omids)


def test_a_build_reads_each_input_once(spark, data, tmp_path):
    read = {}

    def counted(name):
        total = spark.sparkContext.accumulator(0)
        read[name] = total, data.inputs[name].count()

        def pass_on(batches):
            for batch in batches:
                total.add(batch.num_rows)
                yield batch

        return data.inputs[name].mapInArrow(pass_on, data.inputs[name].schema)

    names = ("master", "identifier", "description", "publisher", "language", "meta")
    datasets.build(spark, {n: counted(n) for n in names}, str(tmp_path / "out"), ("in_meta", "not_in_meta", "no_id", "title_matches"))
    assert {n: total.value for n, (total, _) in read.items()} == {n: count for n, (_, count) in read.items()}


def test_published_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.publish(spark.range(3).toDF("n"), path)
    reader = tables.read_parquet(spark, path)
    # A table may be made from its own last version, and a reader that has begun goes on with the old one.
    sinks.publish(reader.select((F.col("n") + 10).alias("n")), path)
    assert sorted(r["n"] for r in reader.collect()) == [0, 1, 2]
    assert sorted(r["n"] for r in tables.read_parquet(spark, path).collect()) == [10, 11, 12]
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        sinks.publish(spark.range(3).select((F.lit(1) / (F.col("id") - 1)).alias("n")), path)
    assert sorted(r["n"] for r in tables.read_parquet(spark, path).collect()) == [10, 11, 12]
    for _ in range(3):
        sinks.publish(spark.range(1).toDF("n"), path)
    assert len([d for d in os.listdir(path) if d.startswith("v-")]) == sinks.KEPT_VERSIONS


def test_many_small_files_are_merged(spark, tmp_path):
    version = sinks.publish(spark.range(0, 1000, 1, 50), str(tmp_path / "t"))
    assert len([f for f in os.listdir(version) if f.endswith(".parquet")]) < 10


# Resumed matching


def test_a_batch_looks_only_at_its_own_ids(spark, tmp_path, monkeypatch):
    """Saved results are consulted by the first batch after a start only; state does the rest, also for items without result."""
    schema = "ITEM_ID bigint, TITLE string"
    source, out, seen, looked = str(tmp_path / "items"), str(tmp_path / "results"), [], []

    def match(items):
        ids = [r["ITEM_ID"] for r in items.collect()]
        seen.append(sorted(ids))
        return spark.createDataFrame([(i,) for i in ids if i % 2], "item_id bigint")

    original = resume.unprocessed
    monkeypatch.setattr(resume, "unprocessed", lambda items, saved: looked.append(1) or original(items, saved))

    def run():
        items = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        resume.match_new_items(items, match, out, str(tmp_path / "checkpoint")).awaitTermination(120)

    for k, ids in enumerate([(1, 2), (2, 3)]):
        spark.createDataFrame([(i, "t") for i in ids], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    assert sorted(sum(seen, [])) == [1, 2, 3] and not looked
    spark.createDataFrame([(1, "t"), (2, "t"), (4, "t"), (5, "t")], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    assert sorted(sum(seen, [])) == [1, 2, 3, 4, 5] and len(looked) == 1
    assert sorted(r["item_id"] for r in spark.read.parquet(out).collect()) == [1, 3, 5]


def test_a_batch_that_was_appended_but_not_recorded_is_not_appended_again(spark, tmp_path):
    import shutil

    schema = "ITEM_ID bigint, TITLE string"
    source, out, checkpoint = (str(tmp_path / n) for n in ("items", "results", "checkpoint"))
    match = lambda items: items.select(F.col("ITEM_ID").alias("item_id"))

    def run():
        resume.match_new_items(spark.readStream.schema(schema).parquet(source), match, out, checkpoint).awaitTermination(120)

    spark.createDataFrame([(1, "t")], schema).write.parquet(source)
    run()
    spark.createDataFrame([(2, "t")], schema).write.mode("append").parquet(source)
    run()
    os.remove(f"{checkpoint}/commits/1")
    shutil.rmtree(f"{checkpoint}/commits/.1.crc", ignore_errors=True)
    if os.path.exists(f"{checkpoint}/commits/.1.crc"):
        os.remove(f"{checkpoint}/commits/.1.crc")
    run()
    assert sorted(r["item_id"] for r in spark.read.parquet(out).collect()) == [1, 2]


# Archives


DAMAGED = (
    b'id,title,type,pub_date\n'
    b'a,short\n'
    b'b,"long, ""quoted""\nline",book,2001,extra,more\n'
    b'c,bad \xff byte,book,1999\n'
    b'd,"",,2000\n'
    b'\n'
    b'e,fine,book,1999\n'
    b'f,"",\n'
)


def test_damaged_rows_are_read_alike_from_folder_and_archive(spark, tmp_path):
    os.mkdir(tmp_path / "plain")
    (tmp_path / "plain" / "1.csv").write_bytes(DAMAGED)
    make_zip(tmp_path / "m.zip", {"1.csv": DAMAGED})
    make_tar(tmp_path / "m.tar", {"1.csv": DAMAGED}, "w")
    make_tar(tmp_path / "m.tar.gz", {"1.csv": DAMAGED}, "w:gz")
    plain = rows(tables.read_csv(spark, str(tmp_path / "plain"), schemas.META))
    assert len(plain) == 6
    for name in ("m.zip", "m.tar", "m.tar.gz"):
        assert rows(tables.read_archive(spark, str(tmp_path / name), schemas.META)) == plain, name


def test_rows_longer_than_a_block(spark, tmp_path):
    long = "x" * (20 << 20)
    text = "id,title\n" + "".join(f"{k},t{k}\n" for k in range(5)) + f"5,{long}\n6,end,too,many\n7,last\n"
    make_zip(tmp_path / "m.zip", {"1.csv": text.encode()})
    found = tables.read_archive(spark, str(tmp_path / "m.zip"), "id string, title string")
    assert sorted((r["id"], r["n"]) for r in found.select("id", F.length("title").alias("n")).collect()) == [
        ("0", 2), ("1", 2), ("2", 2), ("3", 2), ("4", 2), ("5", 20 << 20), ("6", 3), ("7", 4),
    ]


@pytest.mark.filterwarnings("ignore:Duplicate name")
def test_members_of_equal_name_are_told_apart(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "m.zip", "w") as z:
        z.writestr("1.csv", "id\nfirst\n")
        z.writestr("1.csv", "id\nsecond\n")
    found = tables.read_archive(spark, str(tmp_path / "m.zip"), "id string")
    assert sorted(r["id"] for r in found.collect()) == ["first", "second"]


ROWS_OF_ALL_KINDS = "id,title,type,pub_date\n" + "".join(
    f"doi:{k},t{k % 3},{'book' if k % 2 else ''},{1990 + k}\n" for k in range(40)
) + 'x,,,\ny,"","",\n'


@pytest.mark.parametrize("keep, condition", [
    ((("type", "=", "book"),), "type = 'book'"), ((("id", "in", ["doi:3", "x"]),), "id in ('doi:3', 'x')"),
    ((("title", "is null"),), "title is null"), ((("title", "is not null"), ("pub_date", ">", "2000")), "title is not null and pub_date > '2000'"),
    ((("id", "starts with", "doi:1"), ("pub_date", "ends with", "9")), "id like 'doi:1%' and pub_date like '%9'"),
    ((("title", "<=>", "t1"), ("id", "contains", ":2")), "title <=> 't1' and contains(id, ':2')"), ((("pub_date", "<=", "1995"),), "pub_date <= '1995'"),
])
def test_rows_and_columns_are_cut_in_the_archive_reader(spark, tmp_path, keep, condition):
    make_zip(tmp_path / "m.zip", {"1.csv": ROWS_OF_ALL_KINDS.encode()})
    whole = tables.read_meta(spark, str(tmp_path / "m.zip"))
    whole.write.parquet(str(tmp_path / "m"))
    for path in ("m.zip", "m"):
        cut = tables.read_meta(spark, str(tmp_path / path), keep=keep)
        assert rows(cut) == rows(whole.where(condition))
    narrow = tables.read_meta(spark, str(tmp_path / "m.zip"), columns=("pub_date",))
    assert narrow.columns == ["pub_date"] and rows(narrow) == rows(whole.select("pub_date"))


def test_rejected_isbns_exist(data):
    assert item_ops.rejected_identifiers(data.items, "IDE_ISBN").count() > 0


def test_parsed_records_give_the_same_matches(data):
    for limit in (0, 1 << 26):
        assert rows(matching.in_parsed_meta(data.parsed_meta, data.pids, data.labels, limit)) == rows(data.in_meta)


def _many_to_many(spark, n):
    """As many items as records of one title, out of one task each."""
    items = spark.range(0, n, 1, 1).select(F.col("id").alias("ITEM_ID"), F.lit("a title of all").alias("TITLE"))
    meta = spark.range(0, n, 1, 1).select(
        F.concat(F.lit("omid:br/0"), "id", F.lit(" doi:10.1/"), "id").alias("id"), F.lit("a title of all").alias("title"),
        F.lit("book").alias("type"), F.lit("2020").alias("pub_date"),
    )
    return items, meta


@pytest.mark.parametrize("limit", [0, 1 << 26])
def test_pairs_of_one_title_in_lists(spark, limit, no_auto_broadcast):
    """More items than one list holds, an item without id, and repeated rows: every pair, as often as it is."""
    items = spark.sql("select if(id = 7, null, id div 2) as ITEM_ID, 'a title of all' as TITLE from range(3000)")
    parsed = spark.sql("select 'doi:1' as id, 'a title of all' as title, 'book' as type, 'omid:' || (id div 2) as omid from range(4)")
    found = linkage.title_match(items, parsed, limit)
    assert found.columns == ["title", "omid", "id", "type", "iris_id"]
    joined = items.selectExpr("TITLE as title", "ITEM_ID as iris_id").join(parsed, "title").select(*found.columns)
    assert found.count() == 12_000 and not found.exceptAll(joined).count()


def test_pairs_are_made_by_many_tasks(spark):
    items, meta = _many_to_many(spark, 2000)
    found = linkage.title_match(items, matching.parse_meta(meta))
    assert found.rdd.getNumPartitions() >= min(8, spark.sparkContext.defaultParallelism)


def _pairs_by_task(found):
    return [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]


@pytest.mark.parametrize("limit", [0, 1 << 26])
def test_a_hot_title_is_made_by_many_tasks(spark, limit, no_auto_broadcast):
    """Many items and many records of one title, or one record on very many items: no task makes all pairs."""
    items, meta = _many_to_many(spark, 2000)
    made = _pairs_by_task(linkage.title_match(items, matching.parse_meta(meta), limit))
    assert sum(made) == 4_000_000 and len(made) > 2 and max(made) < 3_000_000
    items = spark.range(0, 500_000, 1, 1).selectExpr("id as ITEM_ID", "'a title of all' as TITLE")
    made = _pairs_by_task(linkage.title_match(items, matching.parse_meta(meta.limit(1)), limit))
    assert sum(made) == 500_000 and len(made) > 1 and max(made) < 450_000


@pytest.mark.parametrize("limit", [0, 1 << 26])
def test_lists_and_chunks_of_a_title_give_every_pair_once(spark, limit, monkeypatch, no_auto_broadcast):
    """Titles in many lists and chunks, with repeated and null items and records, next to small ones."""
    monkeypatch.setattr(linkage, "ITEMS_AT_ONCE", 8)
    monkeypatch.setattr(linkage, "LEAST_PAIRS", 50)
    monkeypatch.setattr(linkage, "PAIRS_AT_ONCE", 100)
    title = "case when id % 7 < 5 then 'a title of all' else 'a title of ' || id % 7 || ' and ' || id % 11 end"
    items = spark.range(120).selectExpr("if(id % 10 = 3, null, id div 2) as ITEM_ID", f"{title} as TITLE")
    parsed = spark.range(90).selectExpr(
        "'doi:' || id div 3 as id", f"{title} as title", "'book' as type", "if(id % 9 = 4, null, 'omid:' || id div 3) as omid"
    )
    found = linkage.title_match(items, parsed, limit)
    joined = items.selectExpr("TITLE as title", "ITEM_ID as iris_id").join(parsed, "title").select(*found.columns)
    assert found.dtypes == joined.dtypes and rows(found) == rows(joined)


def test_resumed_matches_are_saved_without_their_pairs(spark, monkeypatch):
    from bibspan.fixtures import queries

    items, meta = _many_to_many(spark, 200)
    d = datasets.Datasets(spark, {"meta": meta})
    d._made["untraced_titles"] = items
    d._made["clean_no_id"] = items.union(spark.sql("select 999L, 'one without a match'"))
    saved, append = [], queries.sinks.append_results
    monkeypatch.setattr(queries.sinks, "append_results", lambda df, path: (saved.append(df.count()), append(df, path)))
    assert queries.PLANS["resume_unprocessed"](d).collect() == [(999, "one without a match")]
    assert sum(saved) == 400


def test_an_update_filters_old_and_new_citations_in_one_pass(spark, monkeypatch, no_auto_broadcast):
    def members(*names):
        return written(spark.createDataFrame([(n,) for n in names], "omid string"), "members")

    columns = "id string, citing string, cited string"
    kept = spark.createDataFrame([("1", "a", "x"), ("2", "gone", "y"), ("2", "gone", "y")], columns)
    new = spark.createDataFrame([("3", "z", "a"), ("3", "z", "a"), ("4", "z", None), ("5", "b", "z")], columns)
    old = spark.createDataFrame([("1", "a", "x"), ("6", "b", "x"), ("7", "x", "y")], columns)
    made, rewritten, make, write = [], [], membership.key_filter, membership.written
    monkeypatch.setattr(membership, "key_filter", lambda *a: (made.append(a), make(*a))[1])
    monkeypatch.setattr(membership, "written", lambda *a: (rewritten.append(a), write(*a))[1])
    found = updates.updated_citations(kept, new, members("a", "gone"), members("a", "b"), old, limit=0)
    assert sorted(r["id"] for r in found.collect()) == ["1", "3", "3", "5", "6"]
    # One filter of the members and one of those added; none of the written members is written again.
    assert len(made) == 2 and not rewritten
