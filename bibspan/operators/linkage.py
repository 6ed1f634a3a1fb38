"""Linking items without identifiers by their texts."""

from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibspan import fixed_values as fixed
from bibspan.functions import records
from bibspan.operators.sizing import (
    BROADCAST_BYTES,
    broadcast_if_small,
    lookup_side,
    measured_bytes,
    written,
)

WEIGHT_UNIT = 1_000_000
# Pairs of a query that are scored first, for a score that the others have to reach.
SEEDS = 4
# Places where words mark a signature: a bit in each of its two halves.
SIGNATURE_BITS = 64
# Words of a query, the heaviest first, that are looked for in signatures.
MARKS = 8
# Items of one title that travel together, and how many pairs of titles a task makes at least and at most.
ITEMS_AT_ONCE = 4096
LEAST_PAIRS, PAIRS_AT_ONCE = 1 << 17, 1 << 22


def title_match(
    items: DataFrame, parsed: DataFrame, limit: int = BROADCAST_BYTES
) -> DataFrame:
    """Every record with a DOI and a type whose title equals an item's cleaned title.

    Titles of fewer than three words do not take part.  The result is by definition
    one row per item and record of equal title, so its size is the reference size; the
    pairs are made from the classes, in the plan of whoever reads them, and are not written here.
    """
    return title_classes(items, parsed, limit).expanded(limit)


@dataclass
class TitleClasses:
    """Title matches by class: the items and the records of each title, never their pairs.

    `classes` has title, n_items and n_records; `items` title and iris_id; `records` title, omid, id
    and type.  All hold only titles that are on both sides.
    """

    classes: DataFrame
    items: DataFrame
    records: DataFrame

    def expanded(self, limit: int = BROADCAST_BYTES) -> DataFrame:
        """All pairs, the rows of `title_match`.

        The items of a title travel as lists of about ITEMS_AT_ONCE, and a record as one row for each of these lists, so
        no row grows with the items, and no more than the pairs of one row are held at a time.  Beside lists small
        enough to be broadcast, these rows are spread over as many tasks as the pairs need, not as their own bytes
        ask for.  Larger ones meet them by title, list and chunk of the records, which are so many that a title,
        however large, is spread over the tasks as well.
        """
        pairs = self.classes.agg(F.sum(F.col("n_items") * F.col("n_records")).alias("n")).first()["n"] or 0
        tasks = self._tasks(pairs)
        n_lists = F.ceil(F.col("n_items") / ITEMS_AT_ONCE)
        n_chunks = F.ceil(F.col("n_items") * F.col("n_records") / (n_lists * max(-(-pairs // tasks), 1)))
        sizes = broadcast_if_small(self.classes.select("title", n_lists.alias("n_lists"), n_chunks.alias("n_chunks")), limit)

        placed = _dealt(self.items, sizes, "n_lists", "_list").groupBy("title", "_list", "n_chunks")
        ids = F.transform(F.collect_list(F.struct("iris_id")), lambda item: item["iris_id"])
        lists = written(placed.agg(ids.alias("_items")), "title-items")
        found = _dealt(self.records, sizes, "n_chunks", "_chunk").withColumn("_list", _each_below("n_lists"))
        if measured_bytes(lists) <= limit:
            met = found.repartition(tasks).join(F.broadcast(lists.drop("n_chunks")), ["title", "_list"])
        else:
            key = ["title", "_list", "_chunk"]
            lists = lists.withColumn("_chunk", _each_below("n_chunks"))
            if tasks > 1:
                found, lists = found.repartition(tasks, *key), lists.repartition(tasks, *key)
            # Without the hint the records may be broadcast, and the pairs of a list are then made all at once.
            met = found.join(lists.hint("merge"), key)
        return met.select("title", "omid", "id", "type", F.explode("_items").alias("iris_id"))

    def _tasks(self, pairs: int) -> int:
        """Tasks that make the pairs: every core has some, and none has much more than PAIRS_AT_ONCE."""
        cores = self.classes.sparkSession.sparkContext.defaultParallelism
        return max(min(cores, -(-pairs // LEAST_PAIRS)), -(-pairs // PAIRS_AT_ONCE), 1)


def _dealt(titled: DataFrame, sizes: DataFrame, n: str, name: str) -> DataFrame:
    """Rows with the sizes of their title, dealt out to as many parts of it as its column `n` says."""
    placed = titled.withColumn("_at", F.monotonically_increasing_id()).join(sizes, "title")
    return placed.withColumn(name, F.pmod(F.xxhash64("_at"), F.col(n))).drop("_at")


def _each_below(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))


def _titled_items(items: DataFrame) -> DataFrame:
    cleaned = records.clean_title(F.col("TITLE"))
    titled = items.select(F.col("ITEM_ID").alias("iris_id"), cleaned.alias("title"))
    return titled.where(records.word_count(F.col("title")) >= fixed.MIN_TITLE_WORDS)


def _typed_records(parsed: DataFrame) -> DataFrame:
    found = parsed.where(F.col("id").startswith("doi:") & (F.col("type") != ""))
    return found.select("title", "omid", "id", "type")


def title_classes(items: DataFrame, parsed: DataFrame, limit: int = BROADCAST_BYTES) -> TitleClasses:
    """Title matches factorised: a title on m items and n records costs m + n rows instead of m times n.

    Of the records only those of an item's title are kept, after a join with the distinct titles.
    """
    titled = written(_titled_items(items), "titled-items")
    of_items = lookup_side(titled.groupBy("title").agg(F.count(F.lit(1)).alias("n_items")), "item-titles", limit)
    found = written(_typed_records(parsed).join(of_items.select("title"), "title", "left_semi"), "titled-records")
    of_records = lookup_side(found.groupBy("title").agg(F.count(F.lit(1)).alias("n_records")), "record-titles", limit)
    classes = written(of_items.join(of_records, "title"), "title-classes")
    kept = titled.join(lookup_side(classes.select("title"), "matched-titles", limit), "title", "left_semi")
    return TitleClasses(classes, written(kept, "matched-items"), found.select("title", "omid", "id", "type"))


def best_of_two(scored: DataFrame, threshold: Column) -> DataFrame:
    """Best candidate per item if its score is above the threshold.

    `scored` has item_id, doc_id and score.  The match is ambiguous when the second
    candidate scores the same.  Two top ranks per item are kept before the shuffle.
    """
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc())
    top = scored.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= 2)
    return (
        top.withColumn("_next", F.lead("score").over(order))
        .where((F.col("_rank") == 1) & (F.col("score") > threshold))
        .withColumn("ambiguous_match", F.coalesce(F.col("_next") == F.col("score"), F.lit(False)))
        .drop("_rank", "_next")
    )


def _weight(n_docs: Column, frequency: Column) -> Column:
    """Weight of a word: rarer words weigh more, in whole millionths.

    Integers make sums independent of their order, so equal scores are equal.
    """
    ratio = (n_docs + F.lit(1)) / (frequency + F.lit(1))
    return F.round(F.lit(WEIGHT_UNIT) * F.ln(ratio)).cast("bigint")


def _keyed_texts(texts: DataFrame, key: str) -> DataFrame:
    listed = texts.select(key, records.words(F.col("text")).alias("words"))
    return listed.select(key, records.words_key(F.col("words")).alias("set_id"), "words")


def _distinct_texts(texts: DataFrame, key: str) -> DataFrame:
    """Texts collapsed by their set of words: one row per set, smallest key, number of copies.

    A group of copies, however large, becomes one row under partial aggregation.
    Texts without words are dropped after it, so that no filter splits texts twice.
    """
    collapsed = _keyed_texts(texts, key).groupBy("set_id").agg(
        F.min(key).alias(key),
        F.count(F.lit(1)).alias("copies"),
        F.any_value("words").alias("words"),
    )
    number = F.monotonically_increasing_id().alias("doc_no")
    return collapsed.where(F.size("words") > 0).select(number, key, "copies", "words", *_signature())


def _bits(word: Column) -> list[Column]:
    """The bits of a word in the two halves of a signature."""
    number = F.pmod(F.xxhash64(word), F.lit(SIGNATURE_BITS * SIGNATURE_BITS)).cast("int")
    halves = F.floor(number / SIGNATURE_BITS).cast("int"), F.pmod(number, F.lit(SIGNATURE_BITS))
    return [half.alias(f"bit_{k}") for k, half in enumerate(halves)]


def _signature() -> list[Column]:
    """Two numbers in which every word of `words` has its bit: a word without one of them is not there."""

    def half(k):
        marked = F.array_distinct(F.transform("words", lambda w: _bits(w)[k]))
        powers = F.transform(marked, lambda bit: F.call_function("shiftleft", F.lit(1).cast("bigint"), bit))
        return F.aggregate(powers, F.lit(0).cast("bigint"), lambda s, power: s.bitwiseOR(power))

    return [half(k).alias(f"bits_{k}") for k in (0, 1)]


def _possible_weight() -> Column:
    """Most that a pair can share: the total without the words of `marks` that the document's signature rules out."""

    def missing(k):
        mark = F.get("marks", F.lit(k))
        there = F.getbit("bits_0", mark["bit_0"]) + F.getbit("bits_1", mark["bit_1"]) == 2
        return F.when(~there, mark["weight"]).otherwise(0)

    return F.col("total") - reduce(add, map(missing, range(MARKS)))


def best_match(
    queries: DataFrame, corpus: DataFrame, percent_above: int = fixed.MATCH_SCORE_ABOVE
) -> DataFrame:
    """Best document for each query text, by the weight of the words they share.

    `queries` has item_id and text, `corpus` doc_id and text.  The score of a pair is
    the sum of the weights of shared words; a match must score more than
    `percent_above` percent of the weight of all the query's words.

    The search is exact and needs no limit on word frequency.  A query's cheapest
    words, as long as they weigh no more than that percentage together, cannot reach
    the threshold by themselves; every match therefore shares one of the remaining,
    rarest words, and only those are looked up.  What a pair found that way can score at most is
    known from the words it was found by and from the document's signature, which rules out words
    that it has not.  The first few pairs of a query by this bound are scored in full; after that only those
    whose bound reaches the best score found.  Copies, of queries and of documents,
    are collapsed beforehand.
    """
    documents = written(_distinct_texts(corpus, "doc_id"), "match-documents")
    asked = written(_keyed_texts(queries, "item_id"), "match-queries")
    weighed = written(_weighed_queries(asked, documents, percent_above), "match-weights")
    bounds = written(_bounded_pairs(weighed, documents, percent_above), "match-bounds")

    order = Window.partitionBy("query_no").orderBy(F.col("bound").desc(), F.col("doc_no").asc())
    first = bounds.withColumn("place", F.row_number().over(order)).where(F.col("place") <= SEEDS)
    first = written(first.select("query_no", "doc_no"), "match-first")
    seeds = written(_scored(first, weighed, documents, percent_above), "match-seeds")
    reached = lookup_side(seeds.groupBy("query_no").agg(F.max("score").alias("reached")), "match-reached")
    # Pairs that cannot have the best score, nor share it, are never scored.
    rest = bounds.join(reached, "query_no", "left").where(F.col("reached").isNull() | (F.col("bound") >= F.col("reached")))
    rest = rest.join(broadcast_if_small(first), ["query_no", "doc_no"], "left_anti")
    scored = seeds.unionByName(_scored(rest, weighed, documents, percent_above))
    best = lookup_side(_best_per_query(scored), "match-best")
    numbers = lookup_side(weighed.select("query_set", "query_no"), "match-numbers")
    items = asked.select("item_id", F.col("set_id").alias("query_set")).join(numbers, "query_set")
    return items.join(best, "query_no").select("item_id", "doc_id", "score", "total", "ambiguous_match")


def _bounded_pairs(weighed: DataFrame, documents: DataFrame, percent_above: int) -> DataFrame:
    """Pairs that share a probe, with the most they can score, where that is above the threshold.

    All probes are looked up, so a pair lacks every probe it was not found by, and can share at
    most all other words; of these, too, no word that the signature of the document rules out.
    """
    signature = ["bits_0", "bits_1"]
    postings = documents.select("doc_no", *signature, F.explode("words").alias("word"))
    probes = weighed.select("query_no", F.inline("probes"))
    found = postings.join(broadcast_if_small(written(probes, "match-probes")), "word")
    shared = found.groupBy("query_no", "doc_no").agg(F.sum("weight").alias("shared"), *(F.max(b).alias(b) for b in signature))
    known = broadcast_if_small(weighed.select("query_no", "total", "probed", "marks"))
    bound = F.least(F.col("total") - F.col("probed") + F.col("shared"), _possible_weight())
    bounded = shared.join(known, "query_no").select("query_no", "doc_no", _evaluated_once(bound).alias("bound"), "total")
    return bounded.where(F.col("bound") * 100 > F.col("total") * percent_above).drop("total")


def _scored(pairs: DataFrame, weighed: DataFrame, documents: DataFrame, percent_above: int) -> DataFrame:
    """Full scores of pairs, where they are above the threshold: word lists travel only with these."""
    listed = documents.select("doc_no", "doc_id", "copies", "words")
    return (
        pairs.select("query_no", "doc_no")
        .join(weighed.select("query_no", "weighted", "total"), "query_no")
        .join(listed, "doc_no")
        .select("query_no", "doc_id", "copies", "total", _evaluated_once(_shared_weight()).alias("score"))
        .where(F.col("score") * 100 > F.col("total") * percent_above)
    )


def _shared_weight() -> Column:
    """Weight of the words of `weighted` that are in `words`, in time linear in both.

    The intersection keeps the order of the query's words, so one walk over these with a
    pointer into it finds each shared word's weight.
    """
    shared = F.array_intersect(F.transform("weighted", lambda x: x["word"]), F.col("words"))
    start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).alias("at"), shared.alias("shared"))

    def step(s, x):
        found = (s["at"] < F.size(s["shared"])) & (F.get(s["shared"], s["at"]) == x["word"])
        return F.struct(
            (s["sum"] + F.when(found, x["weight"]).otherwise(0)).alias("sum"),
            (s["at"] + F.when(found, 1).otherwise(0)).alias("at"),
            s["shared"].alias("shared"),
        )

    return F.aggregate("weighted", start, step, lambda s: s["sum"])


def _evaluated_once(value: Column) -> Column:
    """The value as the output of a generator: filters on it are not computed below it again."""
    return F.explode(F.array(value))


def _weighed_queries(asked: DataFrame, documents: DataFrame, percent_above: int) -> DataFrame:
    """Per distinct set of query words: their weights, the total, and the words to look up."""
    n_docs = documents.agg(F.sum("copies")).scalar()
    frequency = (
        documents.select(F.explode("words").alias("word"), "copies")
        .groupBy("word")
        .agg(F.sum("copies").alias("df"))
    )
    query_sets = asked.groupBy("set_id").agg(F.any_value("words").alias("words"))
    query_words = query_sets.select(F.col("set_id").alias("query_set"), F.explode("words").alias("word"))
    weighted = query_words.join(written(frequency, "match-frequency"), "word", "left").select(
        "query_set", "word", _weight(n_docs, F.coalesce("df", F.lit(0))).alias("weight")
    )
    cheapest_first = Window.partitionBy("query_set").orderBy(F.col("weight").asc(), F.col("word").asc())
    up_to = F.sum("weight").over(
        cheapest_first.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    total = F.sum("weight").over(Window.partitionBy("query_set"))
    ranked = weighted.select("*", up_to.alias("up_to"), total.alias("total"))
    is_probe = F.col("up_to") * 100 > F.col("total") * percent_above
    grouped = ranked.groupBy("query_set").agg(
        F.collect_list(F.struct("word", "weight")).alias("weighted"),
        F.slice(F.sort_array(F.collect_list(F.struct("weight", *_bits(F.col("word")))), False), 1, MARKS).alias("marks"),
        F.any_value("total").alias("total"),
        F.collect_list(F.when(is_probe, F.struct("word", "weight"))).alias("probes"),
        F.coalesce(F.sum(F.when(is_probe, F.col("weight"))), F.lit(0)).alias("probed"),
    )
    return grouped.select(F.monotonically_increasing_id().alias("query_no"), "*")


def _best_per_query(scored: DataFrame) -> DataFrame:
    """Highest score, smallest document id, and whether another document scores the same.

    Counting by score first keeps the second level to one row per query and score.
    """
    per_score = scored.groupBy("query_no", "score", "total").agg(
        F.min("doc_id").alias("doc_id"), F.sum("copies").alias("n_docs")
    )
    order = Window.partitionBy("query_no").orderBy(F.col("score").desc())
    return (
        per_score.withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") == 1)
        .select("query_no", "doc_id", "score", "total", (F.col("n_docs") > 1).alias("ambiguous_match"))
    )


def match_results(best: DataFrame, corpus: DataFrame) -> DataFrame:
    """Best matches with title, DOI and ISSN of the document, as they are saved.

    `corpus` has doc_id, title, doi and issn.
    """
    return best.join(corpus.select("doc_id", "title", "doi", "issn"), "doc_id").select(
        "item_id",
        F.col("title").alias("matched_title"),
        "doi",
        "issn",
        "ambiguous_match",
        (F.col("score") * 100 / F.col("total")).alias("score"),
    )


def with_items(results: DataFrame, items: DataFrame) -> DataFrame:
    """Saved results next to their items."""
    return results.join(items, results["item_id"] == items["ITEM_ID"], "inner").drop(
        results["item_id"]
    )


def unprocessed(items: DataFrame, results: DataFrame) -> DataFrame:
    """Items that have no saved result yet."""
    done = results.select(F.col("item_id").alias("ITEM_ID")).distinct()
    return items.join(lookup_side(done, "done"), "ITEM_ID", "left_anti")
