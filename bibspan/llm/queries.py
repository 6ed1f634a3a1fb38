"""The operators as queries over whole tables, and the SQL that gives the same rows."""

import public_tokenizers
from pyspark.sql import functions as F

from bibspan.llm import quality, toxicity
from bibspan.llm.bpe import encode_texts
from bibspan.llm.common import table
from bibspan.llm.decontaminate import contained_windows, hit_report
from bibspan.llm.line_dedup import without_repeated_blocks
from bibspan.llm.main_text import fit as main_text_of, with_main_text
from bibspan.llm.mixing import MOST_COPIES, mixed, taken_words
from bibspan.llm.search import ranked_documents
from bibspan.llm.set_join import similar_sets
from bibspan.llm.spelling import spelling_variants
from bibspan.llm.tiles import near_vectors
from bibspan.llm.token_files import read_token_files, write_token_files
from bibspan.llm.warc import read_chunks, stored_records, with_record_types, write_archives
from bibspan.session import configured, fresh_folder

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def register(plan):
        def run(spark, sf_dir):
            return plan(configured(spark), sf_dir)

        QUERIES[plan.__name__] = run
        if sql:
            ORACLES[plan.__name__] = sql
        return plan

    return register


LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = rf"""
with recursive words as (
    select doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') as w from documents),
shingles as (
    select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as s
    from words),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
pairs as (
    select a.doc_id as x, b.doc_id as y, count(*) as o from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id
    group by 1, 2),
links as (
    select x, y from pairs join sizes a on a.doc_id = x join sizes b on b.doc_id = y
    where 100 * o >= 90 * (a.n + b.n - o)),
edges as (select x, y from links union select y, x from links),
reached as (
    select x, x as y from edges union select r.x, e.y from reached r join edges e on e.x = r.y)
select d.doc_id, coalesce(s.n, 0) as n_shingles, coalesce(least(d.doc_id, min(r.y)), d.doc_id) as component_id
from documents d left join sizes s on s.doc_id = d.doc_id left join reached r on r.x = d.doc_id
group by d.doc_id, s.n"""


@query(JACCARD)
def op2_ngram_jaccard_join(spark, sf_dir):
    return similar_sets(table(spark, sf_dir, "documents"), width=3, percent=90)


WORDS7 = rf"regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = rf"""
with item_words as (select item_id, {WORDS7} as w from benchmark),
windows as (
    select distinct item_id, least(len(w), 10) as m, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1),
        lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) as win
    from item_words where len(w) > 0),
doc_words as (select doc_id, {WORDS7} as w from documents),
places as (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as i
    from doc_words, (select distinct m from windows) where len(w) >= m),
found as (select p.doc_id, p.i, p.m, x.item_id from places p join windows x
    on x.m = p.m and x.win = array_to_string(p.w[p.i:p.i + p.m - 1], ' ')),
hits as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + m)) as j from found) group by 1),
held as (select doc_id, count(*) as n_items, string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids
    from (select distinct doc_id, item_id from found) group by 1)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
    sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc_words d left join hits using (doc_id) left join held using (doc_id)"""


@query(DECONTAMINATION)
def op7_decontamination(spark, sf_dir):
    found = contained_windows(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return hit_report(found)


@query()
def op8_bpe(spark, sf_dir, path=None):
    path = path or public_tokenizers.path("word_bpe_49k.json")
    return encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), path, decoded=True).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query()
def op6_token_files(spark, sf_dir):
    folder = fresh_folder(spark, "tokens")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), folder)
    n_tokens = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return read_token_files(spark, folder).select("doc_id", "start", n_tokens, F.crc32("ids").alias("ids_crc32"))


WARC = """
with p as (select page_id, coalesce(html, '') as h, octet_length(encode(coalesce(html, ''))) as b from pages),
r as (select sha1(h) as d, b, max(page_id) as target from p where b >= 1000 group by 1, 2)
select page_id, cast(p.b as bigint) as payload_bytes, sha1(h) as payload_digest,
    case when target <> page_id then 'revisit' else 'response' end as record_type,
    case when target <> page_id then target end as refers_to
from p left join r on r.d = sha1(h) and r.b = p.b"""


@query(WARC)
def op5_warc(spark, sf_dir):
    folder = fresh_folder(spark, "warc")
    write_archives(with_record_types(table(spark, sf_dir, "pages")), folder)
    return stored_records(read_chunks(spark, folder, with_payload=False))


NEAR_VECTORS = """
with recursive v as (
    select vec_id, cast(embedding as double[]) as e, list_count(embedding) = len(embedding)
        and len(list_filter(embedding, lambda x: not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0 as good
    from embeddings),
good as (select vec_id, e from v where good),
links as (select a.vec_id as x, b.vec_id as y from good a join good b
    on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.9),
reached as (select x, y from links union select r.x, l.y from reached r join links l on l.x = r.y)
select vec_id, coalesce(n, 0) as n_links, coalesce(least(vec_id, c), vec_id) as component_id,
    coalesce(least(vec_id, c), vec_id) = vec_id as kept
from embeddings left join (select x, count(*) as n from links group by x) n on n.x = vec_id
    left join (select x, min(y) as c from reached group by x) r on r.x = vec_id"""


@query(NEAR_VECTORS)
def op4_embedding_near_dedup(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))


@query()
def op3_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeated_blocks(docs, count="n_deleted")


@query()
def op10_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.predicted(toxicity.with_toxicity(docs, model), 0.3)


@query()
def op1_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = quality.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.predicted(quality.with_quality(docs, trees), 0.7)


@query()
def op9_html_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = with_main_text(pages, main_text_of(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


RANKED = rf"""
with words as (
    select doc_id, unnest(regexp_extract_all({LOWER.format("text")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from documents),
held as (select doc_id, t, count(*) as tf from words group by all),
lengths as (select doc_id, count(*) as n from words group by all),
corpus as (select count(*) as n_docs, cast(sum(n) as bigint) as n_terms from lengths),
asked as (
    select item_id, t, count(*) as times from (
        select item_id, unnest(regexp_extract_all({LOWER.format("text")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark)
    group by all),
weights as (
    select t, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) as bigint) as w from held, corpus group by t, n_docs),
scores as (
    select item_id, doc_id, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) as bigint) as score
    from asked join held using (t) join weights using (t) join lengths using (doc_id), corpus group by all)
select item_id, cast(row_number() over w as integer) as rank, doc_id, score from scores where score > 0
window w as (partition by item_id order by score desc, doc_id) qualify rank <= 10"""


@query(RANKED)
def op11_ranked_search(spark, sf_dir):
    return ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


MIXED = rf"""
with sized as (
    select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size, coalesce(md5(text), '') as digest
    from documents),
counted as (select *, count(*) as copies from sized group by all),
parts as (select *, unnest(range(0, (copies - 1) // {MOST_COPIES} + 1)) as part from counted),
sources as (
    select source, cast(sum(size) as bigint) as words, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight
    from sized group by source),
ordered as (
    select *, coalesce(sum(words * 3) over before, 0) as cap_before, coalesce(sum(weight) over before, 0) as weight_before,
        sum(words) over () as all_words, sum(weight) over () as all_weights
    from sources window before as (order by words * 3 / weight, weight rows between unbounded preceding and 1 preceding)),
level as (
    select any_value(all_words) - coalesce(sum(words * 3) filter (above), 0) as left_words,
        any_value(all_weights) - coalesce(sum(weight) filter (above), 0) as left_weights
    from (select *, weight * (all_words - cap_before) / (all_weights - weight_before) > words * 3 as above from ordered)),
targets as (
    select source, words, case when share > words * 3 then cast(words * 3 as double) else share end as target
    from (select *, weight * left_words / greatest(left_weights, 1) as share from sources, level)),
streams as (
    select p.*, t.words as source_size, target, least(cast(round(target) as bigint), t.words * 3) as wanted, size * least(copies - part * {MOST_COPIES}, {MOST_COPIES}) as own_words,
        sum(own_words) over (partition by p.source order by md5(concat_ws(':', coalesce(cast(doc_id as varchar), ''), digest, cast(part as varchar))),
            doc_id, digest) - own_words as start
    from parts p join targets t on p.source is not distinct from t.source),
taken as (
    select *, cast(greatest(0, least(wanted - start, own_words)) + greatest(0, least(wanted - source_size - start, own_words))
        + greatest(0, least(wanted - 2 * source_size - start, own_words)) as bigint) as words, least(copies - part * {MOST_COPIES}, {MOST_COPIES}) as own_copies
    from streams)
select doc_id, cast(size as bigint) as size, cast(source_size as bigint) as source_size, target,
    cast(words // own_copies + case when copy <= words % own_copies then 1 else 0 end as bigint) as taken
from (select *, unnest(range(1, own_copies + 1)) as copy from taken)"""


@query(MIXED)
def op12_source_mixing(spark, sf_dir):
    return taken_words(mixed(table(spark, sf_dir, "documents")))


@query()
def op13_spelling_variants(spark, sf_dir):
    return spelling_variants(table(spark, sf_dir, "documents"))
