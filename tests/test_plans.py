"""The physical plans are the ones the operators promise."""

from bibspan.operators import dedup, groups, items as item_ops, matching, membership
from bibspan.plans import profiles, questions
from tests.conftest import plan


def test_rankings_are_cut_before_the_shuffle(data):
    pids = item_ops.preferred_pids(data.items)
    per_item = plan(dedup.one_pid_per_item(pids))
    assert per_item.count("WindowGroupLimit") == 2
    both = plan(dedup.one_item_per_pid(dedup.one_pid_per_item(pids)))
    assert both.count("WindowGroupLimit") == 4
    assert "WindowGroupLimit" in plan(matching.in_meta(data.inputs["meta"], data.pids, data.labels))


def test_matching_does_not_shuffle_the_dump(data):
    text = plan(matching.match_meta(data.inputs["meta"], data.pids))
    assert "BroadcastHashJoin" in text
    assert "hashpartitioning" not in text and "SortMergeJoin" not in text


def test_citations_are_scanned_once_and_not_shuffled(data):
    omids = data.omids
    text = plan(membership.filter_citations(data.inputs["index"], omids))
    assert text.count("BroadcastHashJoin") == 2
    assert "hashpartitioning" not in text
    counts = plan(questions.citation_questions(data.inputs["index"], omids))
    assert counts.count("lineitem.parquet") == 1
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in counts


def test_columns_and_filters_reach_the_scan(data, spark, sf_dir):
    years = plan(profiles.meta_years(data.inputs["meta"]))
    assert "o_custkey" not in years and "o_orderpriority" not in years
    iim = data.in_meta
    scan = plan(iim.where(iim["meta_type"] == "book chapter").select("omid"))
    assert "PushedFilters: [IsNotNull(meta_type), EqualTo(meta_type,book chapter)]" in scan
    assert "ReadSchema: struct<meta_type:string,omid:string>" in scan


def test_identifiers_are_computed_once(data):
    text = plan(matching.parse_meta(data.inputs["meta"]))
    assert text.count("(?U)((?:doi)") == 1
    assert plan(item_ops.preferred_pids(data.items)).count("(?U)(10") == 1


def test_no_python_in_the_plans(data):
    for df in (data.items, item_ops.extract_pids(data.items), groups.duplicate_rows(data.pids, "id")):
        text = plan(df)
        assert "EvalPython" not in text and "InPandas" not in text and "InArrow" not in text


def test_duplicate_rows_do_not_window_over_raw_rows(data):
    text = plan(groups.duplicate_rows(data.pids, "id", limit=0))
    assert "Window" not in text and "LeftSemi" in text


def test_share_reuses_the_counts(data):
    share = profiles.no_id_country_share(data.clean_no_id)
    share.collect()
    assert "ReusedExchange" in plan(share)
