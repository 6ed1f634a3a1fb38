"""Every query of the engine over the derived tables, with the SQL that gives the same rows."""

import inspect

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibspan import fixed_values as fixed
from bibspan import schemas
from bibspan.fixtures import archives
from bibspan.fixtures.sql import statement
from bibspan.fixtures.views import LABELS, Inputs
from bibspan.functions import records
from bibspan.operators import dedup, groups, items as item_ops, linkage, lookup, matching, membership
from bibspan.operators.sizing import written
from bibspan.plans import profiles, questions, reconciliation, updates
from bibspan.plans.datasets import Datasets
from bibspan.session import configured, fresh_folder
from bibspan.sources import sinks, tables

PLANS = {}
QUERIES = {}
ORACLES = {}


def query(sql: str):
    """Register a function of the datasets as a query, with its SQL counterpart."""

    def register(plan):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark = configured(spark)
            return plan(Datasets(spark, Inputs(spark, sf_dir)))

        run.__name__ = plan.__name__
        run.__doc__ = inspect.getdoc(plan)
        PLANS[plan.__name__] = plan
        QUERIES[plan.__name__] = run
        ORACLES[plan.__name__] = statement(sql)
        return plan

    return register


# Sources and sinks


@query("select ITEM_ID, IDE_DOI, IDE_ISBN, IDE_PMID from fx_identifier")
def scan_csv_items(d):
    folder = fresh_folder(d.spark, "repository")
    sinks.write_csv(d.inputs["identifier"], f"{folder}/{fixed.IDENTIFIER_FILE}")
    return tables.repository_table(d.spark, folder, "identifier")


@query("select * from fx_master")
def scan_zip_member(d):
    folder = fresh_folder(d.spark, "repository-zip")
    archives.pack(d.inputs["master"], folder, "zip", "{n}/" + fixed.MASTER_FILE)
    return tables.read_archive(d.spark, folder, schemas.ITEM_MASTER, member=fixed.MASTER_FILE)


@query("select * from fx_meta")
def scan_zip_shards(d):
    folder = archives.pack(d.inputs["meta"], fresh_folder(d.spark, "meta-zip"), "zip")
    return tables.read_archive(d.spark, folder, schemas.META)


@query("select * from fx_meta")
def scan_tar_shards(d):
    folder = archives.pack(d.inputs["meta"], fresh_folder(d.spark, "meta-tar"), "tar")
    return tables.read_archive(d.spark, folder, schemas.META)


@query("select * from fx_index")
def scan_nested_archives(d):
    folder = archives.pack(d.inputs["index"], fresh_folder(d.spark, "index"), "zip")
    return tables.read_index(d.spark, folder)


@query("select * from fx_meta")
def scan_parquet(d):
    folder = fresh_folder(d.spark, "meta-parquet")
    sinks.write_parquet(d.inputs["meta"], folder)
    return tables.read_meta(d.spark, folder)


@query("select id, title, meta_type, pub_date, omid, iris_id, iris_type from iim")
def sink_parquet_roundtrip(d):
    folder = fresh_folder(d.spark, "in-meta")
    sinks.write_parquet(d.in_meta, folder)
    return tables.read_parquet(d.spark, folder)


@query("select year, count(*) as count from meta_years group by year")
def sink_csv_histogram(d):
    folder = fresh_folder(d.spark, "years")
    sinks.write_csv(profiles.meta_years(d.inputs["meta"]), folder)
    return tables.read_csv(d.spark, folder, "year string, count bigint")


@query("""select ITEM_ID, TITLE from clean_no_id
    where ITEM_ID not in (select iris_id from title_matches)""")
def resume_unprocessed(d):
    """Matches are saved by title, items and records each once: all pairs, without the room of all pairs."""
    folder = fresh_folder(d.spark, "results")
    found = d.classes_of_titles
    sinks.append_results(found.items.select(F.col("iris_id").alias("item_id"), "title"), f"{folder}/items")
    sinks.append_results(found.records.select("title", "omid", "id"), f"{folder}/records")
    saved = tables.read_parquet(d.spark, f"{folder}/items")
    return linkage.unprocessed(d.clean_no_id.select("ITEM_ID", "TITLE"), saved)


# Items and predicates


@query("select * from items")
def items_joined(d):
    return d.items


@query("""select ITEM_ID, IDE_DOI, IDE_ISBN, IDE_PMID, OWNING_COLLECTION from items
    where IDE_DOI is not null or IDE_ISBN is not null or IDE_PMID is not null""")
def items_with_pid(d):
    return item_ops.with_pid(d.items)


@query("select * from items where IDE_DOI is null and IDE_ISBN is null and IDE_PMID is null")
def items_without_pid(d):
    return item_ops.without_pid(d.items)


@query("select iris_id, iris_type, id from all_pids where id like 'isbn:%'")
def pids_by_prefix(d):
    return item_ops.extract_pids(d.items).where(F.col("id").startswith("isbn:"))


@query("""select ITEM_ID, IDE_ISBN as value from items where regexp_matches(IDE_ISBN, '[A-Z]')
    union all select ITEM_ID, DES_ALLPEOPLE from fx_description where contains(DES_ALLPEOPLE, 'ROSSI')""")
def rows_matching_pattern(d):
    isbns = item_ops.rows_matching(d.items, "IDE_ISBN", "[A-Z]", regex=True)
    people = item_ops.rows_matching(d.inputs["description"], "DES_ALLPEOPLE", "ROSSI")
    return isbns.select("ITEM_ID", F.col("IDE_ISBN").alias("value")).unionByName(
        people.select("ITEM_ID", F.col("DES_ALLPEOPLE").alias("value"))
    )


@query("select * from fx_master where OWNING_COLLECTION is null")
def null_type_items(d):
    return item_ops.without_type(d.inputs["master"])


# Identifier normalisation


@query("select iris_id, iris_type, id from dois")
def norm_doi(d):
    return item_ops.normalized_identifiers(d.items, "IDE_DOI")


@query("select iris_id, iris_type, id from pmids")
def norm_pmid(d):
    return item_ops.normalized_identifiers(d.items, "IDE_PMID")


@query("select iris_id, iris_type, id from isbns")
def norm_isbn(d):
    return item_ops.normalized_identifiers(d.items, "IDE_ISBN")


@query("select iris_id, iris_type, id from all_pids")
def pids_all(d):
    return item_ops.extract_pids(d.items)


@query("""select scheme, count(*) as raw, count(*) filter (ok) as kept, count(*) filter (not ok) as removed
    from (select 'doi' as scheme, ITEM_ID in (select iris_id from dois) as ok from items where IDE_DOI is not null
        union all select 'pmid', ITEM_ID in (select iris_id from pmids) from items where IDE_PMID is not null
        union all select 'isbn', ITEM_ID in (select iris_id from isbns) from items where IDE_ISBN is not null) t
    group by scheme""")
def pid_yield(d):
    return item_ops.pid_yield(d.items)


def _rejected(scheme, column):
    return f"""select ITEM_ID, {column}, OWNING_COLLECTION from items
        where {column} is not null and ITEM_ID not in (select iris_id from {scheme})"""


@query(_rejected("dois", "IDE_DOI"))
def rejected_dois(d):
    return item_ops.rejected_identifiers(d.items, "IDE_DOI")


@query(_rejected("pmids", "IDE_PMID"))
def rejected_pmids(d):
    return item_ops.rejected_identifiers(d.items, "IDE_PMID")


@query(_rejected("isbns", "IDE_ISBN"))
def rejected_isbns(d):
    return item_ops.rejected_identifiers(d.items, "IDE_ISBN")


@query("select id, title, type, pub_date, omid from parsed")
def meta_parse_ids(d):
    return d.parsed_meta


@query(f"""select '{fixed.ENTITY_ADDRESS}br/06' || o_orderkey as address, 'omid:br/06' || o_orderkey as omid
    from orders""")
def iri_to_omid(d):
    address = F.concat(F.lit(fixed.ENTITY_ADDRESS + "br/06"), F.col("o_orderkey").cast("string"))
    addresses = d.inputs.table("orders").select(address.alias("address"))
    return addresses.withColumn("omid", records.entity_omid(F.col("address")))


@query("""select c_custkey, case when c_acctbal < 0 then '' when c_nationkey > 12 then ' ' || c_name || ', '
        else c_mktsegment || ' ' || c_name || ', ' end || n_name || ' Group' as authors
    from customer join nation on c_nationkey = n_nationkey""")
def format_authors(d):
    people = d.inputs.table("customer").join(
        d.inputs.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    first = F.struct(
        F.when(F.col("c_nationkey") <= 12, F.col("c_mktsegment")).alias("given"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("family"),
    )
    second = F.struct(F.col("n_name").alias("given"), F.lit("Group").alias("family"))
    return people.select(
        "c_custkey", records.author_line(F.array(first, second)).alias("authors")
    )


# Deduplication


def _per_item(d):
    return dedup.one_pid_per_item(item_ops.extract_pids(d.items))


@query("select iris_id, iris_type, id from per_item")
def pids_one_per_item(d):
    return _per_item(d)


@query("select iris_id, iris_type, id from pids")
def pids_dedup(d):
    return d.pids


@query("""select iris_id, iris_type, id from (select *, row_number() over (partition by id order by iris_id) as rn
    from per_item) where rn = 1""")
def unique_keep_first(d):
    return dedup.unique_keep_first(_per_item(d))


@query("select iris_id, iris_type, id from per_item qualify count(*) over (partition by id) > 1")
def duplicate_rows(d):
    return groups.duplicate_rows(written(_per_item(d), "per-item"), "id")


@query("""select n_rows, count(*) as n_keys from (select count(*) as n_rows from per_item group by id)
    where n_rows > 1 group by n_rows""")
def dup_size_distribution(d):
    return groups.group_size_distribution(_per_item(d), "id")


@query("""select regexp_extract(id, '^(doi|pmid|isbn)') as id_type, count(*) as n_ids, cast(sum(n) as bigint) as n_rows
    from (select id, count(*) as n from per_item group by id having count(*) > 1) group by 1""")
def dup_pids_by_scheme(d):
    return groups.duplicates_by_scheme(_per_item(d))


@query("""select n_rows, count(*) as n_keys from (select count(*) as n_rows from all_pids group by iris_id)
    where n_rows > 1 group by n_rows""")
def ids_per_item_distribution(d):
    return groups.group_size_distribution(item_ops.extract_pids(d.items), "iris_id")


@query("""select iris_type, count(*) as len from (select * from per_item where id like 'pmid:%'
    qualify count(*) over (partition by id) > 1) group by iris_type""")
def dup_pmids_by_type(d):
    pmids = _per_item(d).where(F.col("id").startswith("pmid:"))
    return groups.ranked_counts(groups.duplicate_rows(written(pmids, "pmids"), "id"), "iris_type")


@query("""select id, cast(sum(n) as bigint) as n_rows,
        string_agg(coalesce(cast(iris_type as varchar), 'null'), ',' order by iris_type nulls first) as "values"
    from (select id, iris_type, count(*) as n from per_item group by all) group by id having count(*) > 1""")
def ambiguous_type_ids(d):
    found = groups.ambiguous_keys(_per_item(d), "id", "iris_type")
    texts = F.transform("values", lambda v: F.coalesce(v.cast("string"), F.lit("null")))
    return found.select("id", "n_rows", F.array_join(texts, ",").alias("values"))


@query("""select id, count(*) as n_rows from per_item group by id having count(*) > 1
    order by n_rows desc, id limit 6""")
def topk_duplicates(d):
    return groups.top_keys(_per_item(d), "id", 6)


@query("select substr(id, 1, 4) as id, count(id) as count, count(*) as len from all_pids group by 1")
def pids_by_scheme(d):
    return profiles.ids_by_scheme(item_ops.extract_pids(d.items))


# Matching and datasets


@query("select id, title, type, pub_date, omid, iris_id, iris_type from matches")
def meta_match(d):
    return matching.match_meta(d.inputs["meta"], d.pids)


@query("select id, title, meta_type, pub_date, omid, iris_id, iris_type from iim")
def dataset_in_meta(d):
    return d.in_meta


@query("""select iris_id, iris_type, id from pids where iris_id not in (select iris_id from iim)""")
def dataset_not_in_meta(d):
    return matching.not_in_meta(d.pids, d.in_meta)


@query("select * from no_id")
def dataset_no_id(d):
    return d.no_id


@query("""with per_type as (select * from matches
        qualify row_number() over (partition by id, type order by omid) = 1),
    filled as (select * from (select *, count(*) over (partition by id) as n from per_type)
        where n = 1 or type is null or type <> ''),
    fitting as (select * from (select * exclude (n), count(*) over (partition by id) as n from filled)
        where n = 1 or preference is not null)
    select id, title, type, pub_date, omid, iris_id, iris_type from fitting
    qualify row_number() over (partition by id order by omid) = 1""")
def meta_dedup_strict(d):
    return dedup.one_record_per_pid_strict(matching.match_meta(d.inputs["meta"], d.pids))


@query("""select iris_id, count(*) as n_rows, count(distinct coalesce(type, '<null>')) as n_values
    from matches group by iris_id having count(distinct coalesce(type, '<null>')) <> 1""")
def type_conflicts(d):
    matches = matching.match_meta(d.inputs["meta"], d.pids)
    return groups.distinct_values(matches, "iris_id", "type").where("n_values <> 1")


@query("select id, citing, cited from iii")
def citations_filter(d):
    return membership.filter_citations(d.inputs["index"], d.omids)


@query("select title, omid, id, type, iris_id from title_matches")
def title_match(d):
    return d.title_matches


@query("""select title, (select count(*) from (select distinct ITEM_ID as i, title as t from titled) where t = m.title) as n_items,
        count(distinct omid) as n_records
    from title_matches m group by title""".replace("titled", r"""(select ITEM_ID,
        replace(replace(replace(TITLE, chr(13), ' '), chr(10), ''), '"', '''') as title from fx_master
        where ITEM_ID in (select ITEM_ID from items where coalesce(IDE_DOI, IDE_ISBN, IDE_PMID) is null))"""))
def title_classes(d):
    return d.title_classes


@query("select title, omid, id, type, iris_id from title_matches")
def title_classes_expanded(d):
    return linkage.title_classes(d.untraced_titles, d.parsed_meta, limit=0).expanded(limit=0)


@query("select id, citing, cited from iii")
def citations_prefiltered(d):
    """The citations again, as they are found where the members are too many to be broadcast."""
    return membership.filter_citations(d.inputs["index"], d.omids, limit=0)


def _halves(df, column):
    odd = F.crc32(F.col(column)) % 2 == 1
    return df.where(odd), df.where(~odd)


@query("select id, title, meta_type, pub_date, omid, iris_id, iris_type from iim")
def in_meta_updated(d):
    """Built from half of the metadata, then brought up to date with the other half."""
    old, new = _halves(d.inputs["meta"], "id")
    built = written(matching.in_meta(old, d.pids, d.labels), "in-meta-of-half")
    return updates.updated_in_meta(built, new, d.pids, d.labels)


@query("select id, citing, cited from iii")
def citations_updated(d):
    """Built from half of the metadata and of the citations, then brought up to date with the other halves."""
    old, new = _halves(d.inputs["meta"], "id")
    old_index, new_index = _halves(d.inputs["index"], "id")
    built = written(matching.in_meta(old, d.pids, d.labels), "in-meta-of-half")
    before = written(membership.members(built), "members-before")
    kept = written(membership.filter_citations(old_index, before), "citations-of-half")
    after = written(membership.members(updates.updated_in_meta(built, new, d.pids, d.labels)), "members-after")
    return updates.updated_citations(kept, new_index, before, after, old_index)


@query("""select meta_type, count(*) as len from (select type as meta_type from fx_meta
    where type = 'book chapter' and pub_date like '199%') group by 1""")
def archive_rows_filtered(d):
    """Records of one type and decade out of an archive: rows and columns are cut in its reader."""
    folder = archives.pack(d.inputs["meta"], fresh_folder(d.spark, "meta-filtered"), "zip")
    conditions = (("type", "=", "book chapter"), ("pub_date", "starts with", "199"))
    found = tables.read_meta(d.spark, folder, columns=("type", "pub_date"), keep=conditions)
    return groups.count_by(found, F.col("type").alias("meta_type"), name="len")


# Questions


@query("""select count(*) as len, count(*) filter (id like '%doi%') as doi,
    count(*) filter (id like '%pmid%') as pmid, count(*) filter (id like '%isbn%') as isbn from iim""")
def rq1_coverage(d):
    return questions.question_1(d.in_meta)


@query("select iris_type, count(*) as len from iim group by iris_type")
def rq2_types(d):
    return questions.question_2(d.in_meta)


@query("""select case when meta_type = '' then 'no type' else meta_type end as meta_type, count(*) as len
    from iim group by meta_type""")
def rq2_meta_types(d):
    return questions.question_2_meta_types(d.in_meta)


@query("""select case when coalesce(iris_type, '') = '' then 'not specified' else iris_type end as iris_type,
    count(*) as len from iim group by 1""")
def rq2_types_named(d):
    return questions.named_types(questions.question_2(d.in_meta))


@query("select count(*) as len from iii")
def rq3_citations(d):
    return questions.question_3(membership.filter_citations(d.inputs["index"], d.omids))


_IN = "in (select omid from omids)"


@query(f"""select count(*) filter (citing is not null and not citing {_IN}) as citing,
    count(*) filter (cited is not null and not cited {_IN}) as cited from iii""")
def rq4_external(d):
    return questions.question_4(d.inputs["index"], omids=d.omids)


@query(f"select count(*) filter (citing {_IN} and cited {_IN}) as len from iii")
def rq5_internal(d):
    return questions.question_5(d.inputs["index"], omids=d.omids)


@query(f"""select count(*) as total, count(*) filter (citing is not null and not citing {_IN}) as citing,
    count(*) filter (cited is not null and not cited {_IN}) as cited,
    count(*) filter (citing {_IN} and cited {_IN}) as "both" from iii""")
def citation_questions(d):
    return questions.citation_questions(d.inputs["index"], omids=d.omids)


@query(f"""select total, round(citing * 100 / total, 2) as pct_citing_outside,
        round(cited * 100 / total, 2) as pct_cited_outside, round("both" * 100 / total, 2) as pct_both
    from (select count(*) as total, count(*) filter (citing is not null and not citing {_IN}) as citing,
        count(*) filter (cited is not null and not cited {_IN}) as cited,
        count(*) filter (citing {_IN} and cited {_IN}) as "both" from iii)""")
def citation_share(d):
    return questions.citation_shares(d.inputs["index"], omids=d.omids)


# Types


@query("select OWNING_COLLECTION, OWNING_COLLECTION_DES from labels")
def type_code_dictionary(d):
    return lookup.type_labels(d.items)


@query("""select l.OWNING_COLLECTION_DES as iris_type, count(*) as len from pids p
    left join labels l on p.iris_type = l.OWNING_COLLECTION group by 1""")
def type_label_lookup(d):
    return lookup.label_type_codes(groups.count_by(d.pids, "iris_type"), d.labels, "iris_type")


@query("""select 'meta_type' as kind, meta_type as value from iim group by meta_type
    union all select 'iris_type', iris_type from iim group by iris_type""")
def distinct_types(d):
    kinds = [
        d.in_meta.select(F.lit(name).alias("kind"), F.col(name).alias("value")).distinct()
        for name in ("meta_type", "iris_type")
    ]
    return kinds[0].unionByName(kinds[1])


@query("""select a.iris_type, in_repository, coalesce(found, 0) as found, in_repository - coalesce(found, 0) as not_found,
        round(coalesce(found, 0) * 100 / in_repository, 2) as pct_found
    from (select l.OWNING_COLLECTION_DES as iris_type, count(*) as in_repository from pids p
            left join labels l on p.iris_type = l.OWNING_COLLECTION group by 1) a
        left join (select iris_type, count(*) as found from iim group by 1) b on a.iris_type = b.iris_type""")
def coverage_by_type(d):
    return profiles.coverage_by_type(d.pids, d.in_meta, d.labels)


@query("""select position, meta_type, len, iris_type, len_iris
    from (select row_number() over (order by count(*) desc, meta_type) as position,
            case when meta_type = '' then 'no type' else meta_type end as meta_type, count(*) as len
        from (select case when meta_type = '' then 'no type' else meta_type end as meta_type from iim) group by meta_type) a
    full join (select row_number() over (order by count(*) desc, iris_type nulls last) as position, iris_type,
        count(*) as len_iris from iim group by iris_type) b using (position)""")
def type_ranking_side_by_side(d):
    return profiles.type_ranking_side_by_side(
        questions.question_2_meta_types(d.in_meta), questions.question_2(d.in_meta)
    )


def _matching(d):
    return lookup.matching_types(d.in_meta, lookup.type_mapping(d.spark))


def _mismatching(d):
    return lookup.mismatching_types(d.in_meta, lookup.type_mapping(d.spark))


@query("select id, title, meta_type, pub_date, omid, iris_id, iris_type from fitting_types")
def type_match(d):
    return _matching(d)


@query("select id, title, meta_type, pub_date, omid, iris_id, iris_type from unfitting_types")
def type_mismatch(d):
    return _mismatching(d)


@query("select id, iris_id, meta_type || '|' || iris_type as types from fitting_types")
def type_pair_array(d):
    pairs = profiles.type_pairs(_matching(d))
    return pairs.select("id", "iris_id", F.array_join("types", "|").alias("types"))


@query("""select meta_type, cast(sum(n) as bigint) as count,
        string_agg(iris_type || '=' || n, ';' order by n desc, iris_type) as iris_types
    from (select meta_type, iris_type, count(*) as n from fitting_types group by all) group by meta_type""")
def type_breakdown_nested(d):
    nested = profiles.type_breakdown(_matching(d))
    texts = F.transform(
        "iris_types", lambda s: F.concat_ws("=", s["iris_type"], s["iris_count"].cast("string"))
    )
    return nested.select("meta_type", "count", F.array_join(texts, ";").alias("iris_types"))


@query("""select meta_type, cast(sum(n) over (partition by meta_type) as bigint) as count, iris_type, n as iris_count
    from (select meta_type, iris_type, count(*) as n from fitting_types group by all)""")
def type_breakdown_long(d):
    return profiles.type_breakdown_long(profiles.type_breakdown(_matching(d)))


@query("""select coalesce(meta_type, 'No type') as meta_type, iris_type, count(*) as iris_count
    from unfitting_types group by unfitting_types.meta_type, iris_type""")
def type_mismatch_breakdown(d):
    return profiles.mismatch_breakdown(_mismatching(d))


MAPPED_TYPES = sorted({local for local, _ in fixed.TYPE_MAPPING if local} & set(LABELS.values()))


@query("select meta_type, " + ", ".join(f"""count(*) filter (iris_type = '{t}') as "{t}\"""" for t in MAPPED_TYPES)
       + " from fitting_types group by meta_type")
def type_pivot(d):
    return profiles.type_pivot(_matching(d), MAPPED_TYPES)


@query("""select meta_type, iris_type, n as iris_count, round(n / sum(n) over (partition by meta_type), 4) as share
    from (select meta_type, iris_type, count(*) as n from unfitting_types group by all)""")
def type_share(d):
    return profiles.type_share(_mismatching(d))


# Shares


@query("""select total, traceable, total - traceable as not_traceable, round(traceable * 100 / total, 2) as pct_traceable,
        round(100 - traceable * 100 / total, 2) as pct_not_traceable
    from (select count(*) as total, count(coalesce(IDE_DOI, IDE_ISBN, IDE_PMID)) as traceable from items)""")
def pid_traceability(d):
    return profiles.traceability(d.items)


@query("""select total, doi, pmid, isbn, round(doi * 100 / total, 2) as pct_doi, round(pmid * 100 / total, 2) as pct_pmid,
        round(isbn * 100 / total, 2) as pct_isbn
    from (select count(*) as total, count(*) filter (id like 'doi:%') as doi, count(*) filter (id like 'pmid:%') as pmid,
        count(*) filter (id like 'isbn:%') as isbn from pids)""")
def pid_scheme_share(d):
    return profiles.scheme_share(d.pids)


@query("""select found, n_items, n_with_id, round(found * 100 / n_items, 2) as pct_of_items,
        round(found * 100 / n_with_id, 2) as pct_of_with_id
    from (select (select count(*) from iim) as found, (select count(*) from items) as n_items,
        (select count(*) from pids) as n_with_id)""")
def coverage_rates(d):
    return profiles.coverage_rates(d.items, d.pids, d.in_meta)


# Items without identifier


@query("select OWNING_COLLECTION_DES, count(*) as len from no_id group by 1")
def no_id_by_type(d):
    return groups.ranked_counts(d.no_id, "OWNING_COLLECTION_DES")


@query("select DES_ALLPEOPLE, count(*) as len from no_id group by 1")
def no_id_by_author(d):
    return groups.ranked_counts(d.no_id, "DES_ALLPEOPLE")


@query("select PUB_COUNTRY, count(*) as len from clean_no_id group by 1")
def no_id_by_country(d):
    return groups.ranked_counts(d.clean_no_id, "PUB_COUNTRY")


@query("select LAN_ISO, count(*) as len from clean_no_id group by 1")
def no_id_by_language(d):
    return groups.ranked_counts(d.clean_no_id, "LAN_ISO")


@query("""select DATE_ISSUED_YEAR, count(*) as len from clean_no_id
    where DATE_ISSUED_YEAR is not null group by 1""")
def no_id_by_year(d):
    return profiles.item_years(d.clean_no_id)


@query("""select OWNING_COLLECTION_DES, count(OWNING_COLLECTION_DES) as count,
        round(count(OWNING_COLLECTION_DES) * 100 / (select count(*) from clean_no_id), 2) as percentage
    from clean_no_id group by 1""")
def no_id_type_share(d):
    return profiles.no_id_type_share(d.clean_no_id)


@query("""select PUB_COUNTRY, count(*) as count, round(count(*) * 100 / (select count(*) from clean_no_id), 2) as percentage
    from clean_no_id group by 1""")
def no_id_country_share(d):
    return profiles.no_id_country_share(d.clean_no_id)


@query("select * from clean_no_id")
def no_id_clean(d):
    return dedup.clean_no_id(d.no_id)


@query("""select TITLE, cast(sum(n) as bigint) as count from (select TITLE, lower(DES_ALLPEOPLE) as people, count(*) as n
    from no_id where TITLE is not null group by all having count(*) > 1) group by TITLE""")
def no_id_duplicates(d):
    return profiles.no_id_duplicates(dedup.titled_no_id(d.no_id))


@query("select ITEM_ID, TITLE, DES_ALLPEOPLE from clean_no_id qualify count(*) over (partition by TITLE) > 1")
def no_id_same_title(d):
    repeated = groups.duplicate_rows(d.clean_no_id, "TITLE")
    return repeated.select("ITEM_ID", "TITLE", "DES_ALLPEOPLE")


# Items not matched


@query("""select substr(id, 1, 4) as id, count(id) as count, count(*) as len from inim group by 1""")
def not_in_meta_by_scheme(d):
    return profiles.ids_by_scheme(d.not_in_meta)


@query("""select l.OWNING_COLLECTION_DES as iris_type, count(*) as len from inim i
    left join labels l on i.iris_type = l.OWNING_COLLECTION group by 1""")
def not_in_meta_by_type(d):
    return profiles.unmatched_by_type(d.not_in_meta, d.labels)


# Years


@query("select year, count(*) as count from meta_years group by year")
def year_histogram_meta(d):
    return profiles.meta_years(d.inputs["meta"])


@query("""select cast(sum(case when year is null then 1 else 0 end) as bigint) as no_year,
    cast(sum(case when try_cast(year as int) > 2025 then 1 else 0 end) as bigint) as future_year from meta_years""")
def year_future_count(d):
    return profiles.year_anomalies(profiles.meta_years(d.inputs["meta"]))


@query("""select try_cast(year as int) as year, count(*) as count from meta_years
    where try_cast(year as int) > 1950 and try_cast(year as int) <= 2025 group by 1""")
def year_range(d):
    return profiles.chart_years(profiles.meta_years(d.inputs["meta"]))


@query("select DATE_ISSUED_YEAR, count(*) as len from fx_master where DATE_ISSUED_YEAR is not null group by 1")
def year_histogram_items(d):
    return profiles.item_years(d.inputs["master"])


@query("""select count(*) filter (DATE_ISSUED_YEAR is null) as no_year,
    count(*) filter (DATE_ISSUED_YEAR > 2025) as future_year from no_id""")
def no_id_year_anomalies(d):
    years = groups.count_by(d.no_id, F.col("DATE_ISSUED_YEAR").cast("string").alias("year"), name="count")
    return profiles.year_anomalies(years)


@query("""select DATE_ISSUED_YEAR, len from (select DATE_ISSUED_YEAR, count(*) as len from fx_master group by 1)
    where DATE_ISSUED_YEAR < 2030""")
def item_chart_years(d):
    years = profiles.item_years(d.inputs["master"])
    return years.where(F.col("DATE_ISSUED_YEAR") < fixed.ITEM_CHART_YEAR_BELOW)


@query("""select DATE_ISSUED_YEAR, a.len, b.len2 from
    (select DATE_ISSUED_YEAR, count(*) as len from clean_no_id group by 1) a
    join (select DATE_ISSUED_YEAR, count(*) as len2 from fx_master group by 1) b using (DATE_ISSUED_YEAR)
    where DATE_ISSUED_YEAR <= 2025""")
def year_common(d):
    return profiles.common_years(
        profiles.item_years(d.clean_no_id), profiles.item_years(d.inputs["master"])
    )


@query("""select DATE_ISSUED_YEAR from clean_no_id where DATE_ISSUED_YEAR is not null
    intersect select DATE_ISSUED_YEAR from fx_master""")
def year_intersect(d):
    return profiles.year_set_intersection(
        profiles.item_years(d.clean_no_id), profiles.item_years(d.inputs["master"])
    )


# Text linkage


@query("""select item_id, doc_id, score, total, ambiguous_match from passage_matches""")
def best_match(d):
    """Passages of the benchmark table looked up in the documents."""
    passages = d.inputs.table("benchmark").select("item_id", "text")
    documents = d.inputs.table("documents").select("doc_id", "text")
    return linkage.best_match(passages, documents)


@query("""select item_id, doc_id, score, coalesce(next_score = score, false) as ambiguous_match
    from (select *, row_number() over w as rn, lead(score) over w as next_score from
            (select l_orderkey as item_id, l_partkey * 10 + l_linenumber as doc_id, l_quantity * 2 as score from lineitem)
        window w as (partition by item_id order by score desc, doc_id))
    where rn = 1 and score > 85""")
def best_match_select(d):
    scored = d.inputs.table("lineitem").select(
        F.col("l_orderkey").alias("item_id"),
        (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("doc_id"),
        (F.col("l_quantity") * 2).alias("score"),
    )
    return linkage.best_of_two(scored, F.lit(fixed.MATCH_SCORE_ABOVE))


@query("""select r.matched_title, r.doi, r.issn, r.ambiguous_match, round(r.score, 3) as score,
        n.ITEM_ID, n.TITLE, n.OWNING_COLLECTION_DES, n.DES_ALLPEOPLE
    from title_results r join clean_no_id n on r.item_id = n.ITEM_ID""")
def reconciled_items(d):
    found = linkage.with_items(d.match_results, d.clean_no_id)
    return found.select(
        "matched_title", "doi", "issn", "ambiguous_match", F.round("score", 3).alias("score"),
        "ITEM_ID", "TITLE", "OWNING_COLLECTION_DES", "DES_ALLPEOPLE",
    )


@query("select doi, count(*) as n_rows from title_results group by doi having count(*) > 1")
def reconciled_duplicates(d):
    return groups.duplicated_keys(d.match_results, "doi")


@query("select id, title, type, pub_date, omid from reconciled")
def reconciled_in_meta(d):
    return d.reconciled


@query("""select (select count(*) from reconciled) as found, count(*) as total,
    round((select count(*) from reconciled) * 100 / count(*), 2) as percentage from clean_no_id""")
def reconciliation_rate(d):
    return reconciliation.rate(d.reconciled, d.clean_no_id)
