"""SQL counterparts: each step of the engine as a common table expression."""

from bibspan import fixed_values as fixed
from bibspan.fixtures import views


def _sql_pattern(pattern: str) -> str:
    """The pattern for an engine that has no (?U) flag; the derived tables are ASCII."""
    return pattern.removeprefix("(?U)").replace("'", "''")


def _found(column: str, pattern: str, group: int = 0) -> str:
    return f"nullif(regexp_extract({column}, '{_sql_pattern(pattern)}', {group}), '')"


def _priority() -> str:
    cases = " ".join(
        f"when id like '{scheme}:%' and iris_type = {code} then {value}"
        for scheme, codes in fixed.TYPE_PRIORITY.items()
        for code, value in codes.items()
    )
    return f"case {cases} else 99 end"


def _preference() -> str:
    cases = " ".join(
        f"when type = '{name}' and iris_type = {code} then {value}"
        for name, code, value in fixed.TYPE_PREFERENCE
    )
    return f"case {cases} end"


def best_match_steps(prefix: str, queries: str, corpus: str, percent: int) -> dict[str, str]:
    """Best match by brute force: all pairs of word sets that share any word."""
    words = r"unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+'))"

    def sets(texts, key):
        return f"""select {key}, string_agg(word, ' ' order by word) as words
            from (select distinct {key}, word from (select {key}, {words} as word from ({texts})) where word <> '')
            group by {key}"""

    p = prefix
    return {
        f"{p}_q": sets(queries, "item_id"),
        f"{p}_d": sets(corpus, "doc_id"),
        f"{p}_qset": f"select distinct words from {p}_q",
        f"{p}_dset": f"select words, min(doc_id) as doc_id, count(*) as copies from {p}_d group by words",
        f"{p}_dword": f"select words, unnest(string_split(words, ' ')) as word, copies from {p}_dset",
        f"{p}_df": f"select word, sum(copies) as df from {p}_dword group by word",
        f"{p}_qword": f"""select q.words, q.word, cast(round({1_000_000} * ln(((select count(*) from {p}_d) + 1) /
                (coalesce(f.df, 0) + 1))) as bigint) as weight
            from (select words, unnest(string_split(words, ' ')) as word from {p}_qset) q left join {p}_df f using (word)""",
        f"{p}_total": f"select words, cast(sum(weight) as bigint) as total from {p}_qword group by words",
        f"{p}_pair": f"""select q.words as qwords, d.words as dwords, cast(sum(q.weight) as bigint) as score
            from {p}_qword q join {p}_dword d on q.word = d.word group by 1, 2""",
        f"{p}_best": f"""select qwords, score, total, min(doc_id) as doc_id, sum(copies) > 1 as ambiguous_match
            from {p}_pair join {p}_total t on qwords = t.words join {p}_dset d on dwords = d.words
            where score * 100 > total * {percent}
            group by qwords, score, total qualify row_number() over (partition by qwords order by score desc) = 1""",
        f"{p}_matches": f"""select item_id, doc_id, score, total, ambiguous_match
            from {p}_q q join {p}_best b on q.words = b.qwords""",
    }


ITEM_COLUMNS = "i.ITEM_ID, IDE_DOI, IDE_ISBN, IDE_PMID, OWNING_COLLECTION, OWNING_COLLECTION_DES"
META_COLUMNS = "id, title, type, pub_date, omid"

STEPS = {
    "items": f"select {ITEM_COLUMNS} from fx_identifier i join fx_master m on i.ITEM_ID = m.ITEM_ID",
    "dois": f"""select ITEM_ID as iris_id, OWNING_COLLECTION as iris_type,
        'doi:' || lower({_found('IDE_DOI', fixed.DOI_PATTERN)}) as id from items where id is not null""",
    "pmids": f"""select ITEM_ID as iris_id, OWNING_COLLECTION as iris_type,
        'pmid:' || {_found('IDE_PMID', fixed.PMID_PATTERN, 1)} as id from items
        where IDE_PMID not like '%{fixed.PMC_MARK}%' and id is not null""",
    "isbns": f"""select ITEM_ID as iris_id, OWNING_COLLECTION as iris_type,
        'isbn:' || lower(regexp_replace({_found('IDE_ISBN', fixed.ISBN_PATTERN)}, '{fixed.ISBN_SEPARATORS}', '', 'g')) as id
        from items where id is not null""",
    "all_pids": """select *, 0 as scheme from dois union all select *, 1 from pmids
        union all select *, 2 from isbns""",
    "per_item": """select * from all_pids
        qualify row_number() over (partition by iris_id order by scheme, id, iris_type) = 1""",
    "pids": f"""select * from per_item
        qualify row_number() over (partition by id order by {_priority()}, iris_id) = 1""",
    "labels": """select OWNING_COLLECTION, min(OWNING_COLLECTION_DES) as OWNING_COLLECTION_DES
        from items where OWNING_COLLECTION is not null group by 1""",
    "parsed": f"""select {META_COLUMNS} from (select title, type, pub_date,
            {_found('m.id', fixed.META_OMID_PATTERN)} as omid,
            coalesce({_found('m.id', fixed.META_DOI_PATTERN)}, {_found('m.id', fixed.META_PMID_PATTERN)},
                {_found('m.id', fixed.META_ISBN_PATTERN)}) as id
        from fx_meta m) where id is not null""",
    "matches": f"""select {META_COLUMNS}, iris_id, iris_type, {_preference()} as preference
        from parsed join (select iris_id, iris_type, id from pids) using (id)""",
    "iim": """select id, title, type as meta_type, pub_date, omid, iris_id, OWNING_COLLECTION_DES as iris_type
        from (select * from matches
            qualify row_number() over (partition by id order by preference desc nulls last, omid) = 1)
        left join labels on iris_type = OWNING_COLLECTION""",
    "omids": "select distinct omid from iim where omid is not null",
    "iii": """select * from fx_index where citing in (select omid from omids)
        or cited in (select omid from omids)""",
    "inim": "select * from pids where iris_id not in (select iris_id from iim)",
    "no_id": f"""select {ITEM_COLUMNS}, DES_ALLPEOPLE, DES_NUMBEROFAUTHORS, DATE_ISSUED_YEAR, TITLE, PUB_NAME,
            PUB_PLACE, PUB_COUNTRY, LAN_ISO
        from items i left join fx_description d on i.ITEM_ID = d.ITEM_ID
            left join (select ITEM_ID, DATE_ISSUED_YEAR, TITLE from fx_master) m on i.ITEM_ID = m.ITEM_ID
            left join fx_publisher p on i.ITEM_ID = p.ITEM_ID left join fx_language l on i.ITEM_ID = l.ITEM_ID
        where coalesce(IDE_DOI, IDE_ISBN, IDE_PMID) is null""",
    "clean_no_id": """select * replace (lower(DES_ALLPEOPLE) as DES_ALLPEOPLE) from no_id where TITLE is not null
        qualify row_number() over (partition by TITLE, lower(DES_ALLPEOPLE) order by ITEM_ID, LAN_ISO nulls last) = 1""",
    "title_matches": r"""select title, omid, id, type, iris_id
        from (select ITEM_ID as iris_id, replace(replace(replace(TITLE, chr(13), ' '), chr(10), ''), '"', '''') as title
            from fx_master where ITEM_ID in (select ITEM_ID from items where coalesce(IDE_DOI, IDE_ISBN, IDE_PMID) is null))
            join parsed using (title)
        where id like 'doi:%' and type <> '' and len(string_split_regex(trim(title), '\s+')) >= 3""",
    "fitting_types": "select * from iim join fx_mapping using (iris_type, meta_type)",
    "unfitting_types": """select * from iim where not exists (select 1 from fx_mapping m
        where m.iris_type = iim.iris_type and m.meta_type = iim.meta_type)""",
    "meta_years": f"select {_found('pub_date', fixed.YEAR_PATTERN)} as year from fx_meta",
    **best_match_steps(
        "passage",
        "select item_id, text from benchmark",
        "select doc_id, text from documents",
        fixed.MATCH_SCORE_ABOVE,
    ),
    **best_match_steps(
        "title_text",
        "select ITEM_ID as item_id, TITLE || coalesce(', ' || DES_ALLPEOPLE, '') as text from clean_no_id",
        """select doc_id, title || ', ' || coalesce(given_1, '') || ' ' || family_1 ||
            coalesce(', ' || given_2 || ' ' || family_2, '') as text from fx_publication where doi is not null""",
        fixed.MATCH_SCORE_ABOVE,
    ),
    "title_results": """select item_id, title as matched_title, doi, issn, ambiguous_match,
            score * 100 / total as score
        from title_text_matches m join fx_publication p on m.doc_id = p.doc_id""",
    "reconciled": f"""select {META_COLUMNS} from parsed
        where id in (select lower('doi:' || doi) from title_results)""",
}


def statement(body: str) -> str:
    """A query over the steps, as one statement over the driver's tables."""
    steps = ",\n".join(f"{name} as materialized ({text})" for name, text in STEPS.items())
    return f"with {views.common_table_expressions()},\n{steps}\nselect * from ({body})"
