"""Spelling variants: words one inserted, deleted or replaced character apart, by pairs of trie nodes.

Words are numbered by the nodes of two tries: of their beginnings, and of their ends.  A word
split at a place is a pair of integers, the node of what comes before and the node of what
comes after; a pair belongs to one word only.  A word with a place skipped is such a pair, too.  Two words
that skip to the same pair differ in the character skipped; a word that skips to the pair of
another one's split has one character more.  So all neighbours, and nothing else, meet under equal pairs of
integers, without comparing texts.  The words that skip to one pair have different characters
there, so a pair holds no more words than there are letters.

A trie is numbered in sorted ranges of the words.  Within a range a word shares the nodes of the one before
as far as their common beginning reaches.  Nodes that go over the edge of a range are
beginnings of a range's first word; these few words are numbered beforehand, for all tasks.
"""

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspan.operators.sizing import broadcast_if_small, written

LEAST_LETTERS = 7
LEAST_TIMES = 2
TIMES_MORE = 10
# A word of the text loses a letter if this divides the checksum of its document and itself.
SLIP_EVERY = 31
# Kinds of pairs: a split, a skip of the first of equal letters in a row, another skip.
SPLIT, SKIP, SKIP_AGAIN = 0, 1, 2
_RANGE_SHIFT = 40


def counted_words(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_times: int = LEAST_TIMES) -> DataFrame:
    """Words with the slips of their documents, and how often they occur: columns word and n."""
    letters = rf"[A-Za-zÀ-ÿ]{{{least_letters},}}"
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(letters), F.lit(0))).alias("run"),
    )
    small = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = runs.select("id", F.when(F.col("run").rlike("[A-Z]"), small).otherwise(F.col("run")).alias("run"))
    sums = runs.select("run", F.crc32(F.concat_ws(":", "id", "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = sums.select(F.when(F.col("h") % SLIP_EVERY == 0, slipped).otherwise(F.col("run")).alias("word"))
    counts = words.where(F.length("word") >= least_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= least_times)


def shared_length(one: str, two: str) -> int:
    n = 0
    for a, b in zip(one, two):
        if a != b:
            break
        n += 1
    return n


def edge_nodes(firsts: list[str]) -> list[list[int]]:
    """Numbers of the beginnings, from the empty one on, of the first words of the ranges, in order."""
    found, before, nodes, used = [], "", [0], 0
    for word in firsts:
        kept = shared_length(before, word) + 1
        nodes = nodes[:kept] + list(range(used + 1, used + 2 + len(word) - kept))
        used += len(word) + 1 - kept
        before = word
        found.append(nodes)
    return found


def _numbering(shared):
    """Nodes of the words of sorted ranges, a task going through one or more whole ranges."""

    def number(batches):
        firsts = shared.value
        nodes_of_edges = edge_nodes([w for _, w in firsts])
        place = {part: k for k, (part, _) in enumerate(firsts)}
        current, before, nodes, used, row, next_word, next_nodes = None, "", [], 0, 0, "", []
        for batch in batches:
            ids, lists = [], []
            for part, word in zip(batch.column("part").to_pylist(), batch.column("key").to_pylist()):
                if part != current:
                    current, used, row, k = part, 0, 0, place[part]
                    before, nodes = firsts[k][1], nodes_of_edges[k]
                    next_word, next_nodes = (firsts[k + 1][1], nodes_of_edges[k + 1]) if k + 1 < len(firsts) else ("", [])
                kept = shared_length(before, word)
                if kept < len(word):
                    edge = max(min(shared_length(word, next_word), len(word)), kept)
                    new = len(word) - edge
                    start = ((part + 1) << _RANGE_SHIFT) + used
                    nodes = nodes[: kept + 1] + next_nodes[kept + 1 : edge + 1] + list(range(start, start + new))
                    used += new
                else:
                    nodes = nodes[: kept + 1]
                before = word
                ids.append((part << _RANGE_SHIFT) + row)
                row += 1
                lists.append(nodes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("n"), pa.array(ids, pa.int64()), pa.array(lists, pa.list_(pa.int64()))],
                names=["word", "n", "id", "nodes"],
            )

    return number


def trie_nodes(words: DataFrame, key, name: str) -> DataFrame:
    """`words` with an id in the order of `key` and the trie nodes of all beginnings of `key`.

    The ranges are of about equal size, as a sort would make them; one word per range comes to the driver,
    and their number is that of shuffle partitions.
    """
    keyed = words.select("word", "n", key.alias("key"))
    ranges = keyed.repartitionByRange("key").withColumn("part", F.spark_partition_id())
    ranges = written(ranges, f"{name}-ranges")
    firsts = sorted(tuple(r) for r in ranges.groupBy("part").agg(F.min("key").alias("key")).collect())
    shared = words.sparkSession.sparkContext.broadcast(firsts)
    ordered = ranges.repartition("part").sortWithinPartitions("part", "key")
    return ordered.mapInArrow(_numbering(shared), "word string, n long, id long, nodes array<long>")


def pairs_of_nodes(numbered: DataFrame) -> DataFrame:
    """Splits and skips of all words as pairs of nodes: id, n, kind, before, after.

    `numbered` has the words with their ids and the nodes of their beginnings.
    """
    backward = written(trie_nodes(numbered, F.reverse("word"), "backward"), "backward")
    both = numbered.join(backward.select("word", F.col("nodes").alias("ends")), "word")
    length = F.length("word")

    def split(i):
        return F.struct(
            F.lit(SPLIT).alias("kind"), F.element_at("nodes", i + 1).alias("before"), F.element_at("ends", length - i + 1).alias("after")
        )

    def skip(i):
        again = (i > 0) & (F.substring("word", i + 1, F.lit(1)) == F.substring("word", i, F.lit(1)))
        return F.struct(
            F.when(again, SKIP_AGAIN).otherwise(SKIP).alias("kind"),
            F.element_at("nodes", i + 1).alias("before"), F.element_at("ends", length - i).alias("after"),
        )

    made = F.concat(F.transform(F.sequence(F.lit(0), length), split), F.transform(F.sequence(F.lit(0), length - 1), skip))
    return both.select("id", "n", F.inline(made))


def near_words(pairs: DataFrame) -> DataFrame:
    """Per word with neighbours: id, n_near, and form_n and form, count and id of the most frequent one.

    Of equally frequent neighbours that of the smallest id counts.  The members of a pair are at
    most one split and one skip for each letter there is.
    """
    member = F.struct(F.col("n"), (-F.col("id")).alias("order"), F.col("kind"))
    groups = pairs.groupBy("before", "after").agg(F.collect_list(member).alias("members")).where(F.size("members") > 1)
    links = groups.select(F.explode("members").alias("a"), "members")

    def near(x):
        inserted = (F.col("a.kind") == SPLIT) & (x["kind"] == SKIP) | (F.col("a.kind") == SKIP) & (x["kind"] == SPLIT)
        return inserted | (F.col("a.kind") > SPLIT) & (x["kind"] > SPLIT) & (x["order"] != F.col("a.order"))

    links = links.select((-F.col("a.order")).alias("id"), F.filter("members", near).alias("near")).where(F.size("near") > 0)
    best = F.max(F.array_max("near")).alias("best")
    found = links.groupBy("id").agg(F.sum(F.size("near")).cast("long").alias("n_near"), best)
    return found.select("id", "n_near", F.col("best.n").alias("form_n"), (-F.col("best.order")).alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """The last word on the way from each word over its forms: columns id and root.

    `forms` has id and form.  A form is many times as frequent as its word, so ways are short and have no
    circle; each round doubles the steps taken.
    """
    known = written(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        ahead = broadcast_if_small(known.select(F.col("id").alias("root"), F.col("root").alias("beyond")))
        moved = known.join(ahead, "root", "left")
        if not moved.where("beyond is not null").limit(1).count():
            return known
        known = written(moved.select("id", F.coalesce("beyond", "root").alias("root")), "roots")


def spelling_variants(docs: DataFrame, times_more: int = TIMES_MORE) -> DataFrame:
    """Words of the whole texts with their near words, form and root.

    Near words differ by exactly one inserted, deleted or replaced code point.  A word's form is its most
    frequent near word, the first in code-point order of equals, if it occurs `times_more`
    times as often; the root is where forms of forms end, the word itself without a form.
    `docs` has doc_id and text; other columns do not matter, whatever their names.  Null and empty texts have no words;
    repeated rows count each; a null doc_id is an empty text in the checksum.  Without words the result is empty.
    """
    words = written(counted_words(docs), "words")
    numbered = written(trie_nodes(words, F.col("word"), "forward"), "forward")
    known = numbered.select("id", "word", "n")
    near = written(near_words(pairs_of_nodes(numbered)), "near-words")
    joined = written(known.join(near, "id", "left"), "near-counts")
    is_form = F.col("form_n") >= times_more * F.col("n")
    with_form = joined.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("form")).alias("form"))
    last = roots(with_form.where("form is not null"))
    form = known.select(F.col("id").alias("form"), F.col("word").alias("form_word"), F.col("n").alias("form_n"))
    root = known.select(F.col("id").alias("root"), F.col("word").alias("root_word"))
    ended = last.join(root, "root").select("id", "root_word")
    done = with_form.join(form, "form", "left").join(ended, "id", "left")
    return done.select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n"
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
