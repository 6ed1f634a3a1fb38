"""Line dedup by pairwise alignment: blocks of lines a document shares with an earlier one go.

A line is a line of text or, within one, a sentence: it ends after a line break, after `.`,
`!` or `?` and a space, after a full stop of another script, and after a space between letters
of scripts that write no full stops (Thai, Lao).  Lines are equal when their words are,
whatever their case in A-Z and their white space; lines without words count for nothing.
Scripts without spaces between words count as many words as their letters make up: two
letters of Chinese and Japanese, four of Thai, Lao, Tibetan, Burmese and Khmer.

Runs of lines lead to pairs of documents: of every line the shortest run of enough words that
starts with it, and the shortest that ends with it.  Each run is looked up in the first
document that has it, so a passage in a third of all documents gives one pair for each of
them and never all pairs.  Any common block of enough words is made up of such runs, so it is
found whichever earlier document has it.  The lines that both documents of a pair have are
aligned by patience diff, rare lines first: those that occur once in both fix the alignment,
the stretches between are aligned in the same way.  Common blocks of enough words leave the
later document; runs that the alignment leaves, as they stand in another order there, go too.
"""

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspan.llm.common import free_name, pieces, utf8
from bibspan.llm.words import WordHasher, spans
from bibspan.operators.sizing import broadcast_if_small, lookup_side, written

MIN_BLOCK_WORDS = 20


# Code points that end a line, and those of scripts without spaces between words with twelfths of a word per byte.
STOPS = (0x589, 0x61F, 0x6D4, 0x700, 0x701, 0x702, 0x964, 0x965, 0xF0D, 0xF0E, 0x104A, 0x104B, 0x1362, 0x1367, 0x17D4, 0x17D5,
         0x1803, 0x1809, 0x203C, 0x203D, 0x2047, 0x2048, 0x2049, 0x3002, 0xFE12, 0xFF01, 0xFF0E, 0xFF1F, 0xFF61)
UNSPACED = [(0xE00, 0xEFF, 1), (0xF00, 0xFFF, 1), (0x1000, 0x109F, 1), (0x1780, 0x17FF, 1), (0x1950, 0x19DF, 1), (0x1A20, 0x1AAF, 1),
            (0x2E80, 0x2FDF, 2), (0x3005, 0x3007, 2), (0x3021, 0x312F, 2), (0x31A0, 0x31FF, 2), (0x3400, 0x4DBF, 2), (0x4E00, 0x9FFF, 2),
            (0xF900, 0xFAFF, 2), (0xFF66, 0xFF9D, 2)]
SHARES = np.zeros(1 << 16, dtype=np.uint8)
for _from, _to, _share in UNSPACED:
    SHARES[_from : _to + 1] = _share
IS_STOP = np.zeros(1 << 16, dtype=bool)
IS_STOP[list(STOPS)] = True


def _other_scripts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places after which a line ends by rules of scripts other than Latin, and twelfths of a word for every byte."""
    share = np.zeros(len(data), dtype=np.uint8)
    two, three, four = (np.flatnonzero((data >= a) & (data <= b)) for a, b in ((0xC2, 0xDF), (0xE0, 0xEF), (0xF0, 0xF4)))
    wide = data.astype(np.int32) & 63 if len(two) + len(three) + len(four) else data
    points = ((wide[two] & 31) << 6) | wide[two + 1] if len(two) else two
    ends = [two[IS_STOP[points]] + 1]
    if len(three):
        points = ((wide[three] & 15) << 12) | (wide[three + 1] << 6) | wide[three + 2]
        ends.append(three[IS_STOP[points]] + 2)
        own = SHARES[points]
        for k in range(3):
            share[three + k] = own
        thai = three[(points >= 0xE00) & (points <= 0xEFF)]
        starts = np.zeros(len(data) + 4, dtype=bool)
        starts[thai] = True
        ends.append(thai[starts[thai + 4] & (data[np.minimum(thai + 3, len(data) - 1)] == 32)] + 3)
    # Beyond the first plane, ideographs lie in planes 2 and 3.
    for at in four[(data[four] == 0xF0) & (data[np.minimum(four + 1, len(data) - 1)] >= 0xA0)]:
        share[at : at + 3] = 2
    return np.concatenate(ends), share


def _lines(data: np.ndarray, offsets: np.ndarray, hasher: WordHasher):
    """Start byte, hash, number of words and text of every line with words."""
    before = np.concatenate((np.zeros(1, np.uint8), data[:-1])) if len(data) else data
    ends = (data == 10) | ((data == 32) & np.isin(before, np.frombuffer(b".!?", np.uint8)))
    others, share = _other_scripts(data)
    starts = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(ends) + 1, others + 1]))
    starts = starts[starts < len(data)]
    # A line may end without a space, so a word ends with its line.
    hashes, places = hasher.located(data, np.append(starts, len(data)))
    first = np.searchsorted(places, starts)
    total = np.concatenate(([0], np.cumsum(share, dtype=np.int64)))
    weights = np.maximum(np.diff(total[np.append(places, len(data))]) // 12, 1)
    total = np.concatenate(([0], np.cumsum(weights)))
    count = np.diff(total[np.append(first, len(places))])
    named = spans(hashes, first)
    worded = count > 0
    text = np.searchsorted(offsets, starts[worded], side="right") - 1
    return starts[worded], named[worded], count[worded], text


def _describing(batches):
    hasher = WordHasher("space")
    for batch in pieces(batches):
        _, named, count, text = _lines(*utf8(batch.column("text")), hasher)
        counts = np.bincount(text, minlength=batch.num_rows) if len(text) else np.zeros(batch.num_rows, np.int64)
        offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), pa.ListArray.from_arrays(offsets, pa.array(named.view(np.int64))),
             pa.ListArray.from_arrays(offsets, pa.array(count.astype(np.int32)))], names=["key", "lines", "words"]
        )


def increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence of distinct values, by patience sorting."""
    from bisect import bisect_left

    tops, places, back = [], [], []
    for k, value in enumerate(values):
        pile = bisect_left(tops, value)
        back.append(places[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(value)
            places.append(k)
        else:
            tops[pile], places[pile] = value, k
    found, k = [], places[-1] if places else -1
    while k >= 0:
        found.append(k)
        k = back[k]
    return found[::-1]


def _anchors(one: list, two: list) -> list[tuple[int, int]]:
    """Aligned places of values that occur once in both; without any, of equal occurrences of the others."""

    def once(values):
        places, twice = {}, set()
        for k, value in enumerate(values):
            twice.add(value) if value in places else places.setdefault(value, k)
        return {value: k for value, k in places.items() if value not in twice}

    def numbered(values):
        seen, places = {}, {}
        for k, value in enumerate(values):
            seen[value] = seen.get(value, 0) + 1
            places[value, seen[value]] = k
        return places

    for places in (once, numbered):
        left, right = places(one), places(two)
        both = sorted((k, right[value]) for value, k in left.items() if value in right)
        if both:
            return [both[k] for k in increasing([j for _, j in both])]
    return []


def aligned(one: list, two: list) -> list[tuple[int, int]]:
    """Patience diff: pairs of places of equal values, increasing in both."""
    found, work = [], [(0, len(one), 0, len(two))]
    while work:
        a, b, c, d = work.pop()
        while a < b and c < d and one[a] == two[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and one[b - 1] == two[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a == b or c == d:
            continue
        anchors = [(a + i, c + j) for i, j in _anchors(one[a:b], two[c:d])]
        found.extend(anchors)
        edges = [(a - 1, c - 1), *anchors, (b, d)]
        if anchors:
            work.extend((i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:]) if i + 1 < k and j + 1 < m)
    return sorted(found)


def long_runs(steps: np.ndarray, words: np.ndarray, least: int) -> np.ndarray:
    """Marks the members of runs (a step of True goes on with the run) of `least` words or more."""
    if not len(words):
        return np.zeros(0, dtype=bool)
    run = np.cumsum(~np.concatenate(([False], steps)))
    return np.bincount(run, words)[run] >= least


def _slices(batches, rows: int = 256):
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of all rows of a list of numbers, and where each row starts."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes)))


def shortest_runs(words: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First places and ends of the shortest runs of `least` words from every line and up to every line of its text.

    A line of a block of `least` words or more is in a run that lies within the block: in that
    from the block's first line, from itself, or up to itself.
    """
    total = np.concatenate(([0], np.cumsum(words, dtype=np.int64)))
    at, text = np.arange(len(words)), np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    stop = np.searchsorted(total, total[:-1] + least)
    start = np.searchsorted(total, total[1:] - least, side="right") - 1
    ahead, back = stop <= offsets[text + 1], start >= offsets[text]
    # A run up to a line may be the run from its first line.
    back &= stop[np.maximum(start, 0)] != at + 1
    return np.concatenate([at[ahead], start[back]]), np.concatenate([stop[ahead], at[back] + 1])


def _running(least: int, placed: bool):
    """Runs of every document with their places, or only with a number for the document."""

    def find(batches):
        for batch in _slices(batches):
            lines, offsets = _flat(batch.column("lines"))
            starts, stops = shortest_runs(_flat(batch.column("words"))[0], offsets, least)
            named = spans(lines.view(np.uint64), starts, stops).view(np.int64)
            text = np.searchsorted(offsets, starts, side="right") - 1
            if not placed:
                yield pa.RecordBatch.from_arrays([batch.column("mark").take(pa.array(text)), pa.array(named)], names=["mark", "run"])
                continue
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(text)), pa.array(named), pa.array((starts - offsets[text]).astype(np.int32)),
                 pa.array((stops - offsets[text]).astype(np.int32))], names=["key", "run", "start", "stop"]
            )

    return find


def _lists(column: pa.ListArray):
    flat, offsets = _flat(column)
    return (flat[a:b] for a, b in zip(offsets, offsets[1:]))


def _aligning(least: int):
    def align(batches):
        for batch in _slices(batches):
            keys, gone = [], []
            sides = (_lists(batch.column(c)) for c in ("earlier", "lines", "words", "starts", "stops"))
            for key, one, two, words, starts, stops in zip(batch.column("key").to_pylist(), *sides):
                left, right = np.flatnonzero(np.isin(one, two)), np.flatnonzero(np.isin(two, one))
                pairs = aligned(one[left].tolist(), two[right].tolist())
                at = np.array(pairs, dtype=np.int64).reshape(-1, 2)
                i, j = left[at[:, 0]], right[at[:, 1]]
                marked = np.zeros(len(two) + 1, dtype=np.int64)
                np.add.at(marked, starts, 1)
                np.add.at(marked, stops, -1)
                marked = np.cumsum(marked[:-1]) > 0
                marked[j[long_runs((np.diff(i) == 1) & (np.diff(j) == 1), words[j], least)]] = True
                keys.append(key)
                gone.append(np.flatnonzero(marked).astype(np.int32))
            kind = batch.schema.field("key").type
            yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(gone, pa.list_(pa.int32()))], names=["key", "gone"])

    return align


def _deleting(count: str):
    def delete(batches):
        hasher = WordHasher("space")
        for batch in pieces(batches):
            at = batch.schema.get_field_index("text")
            texts, gone = batch.column(at).to_pylist(), batch.column(count).to_pylist()
            chosen = [k for k, marked in enumerate(gone) if marked]
            if chosen:
                data, offsets = utf8(batch.column(at).take(pa.array(chosen)))
                starts, _, _, text = _lines(data, offsets, hasher)
                first = np.searchsorted(text, np.arange(len(chosen) + 1))
                for k, place in enumerate(chosen):
                    # A line with words reaches to the next one, so lines without words go with it.
                    own = np.append(starts[first[k] : first[k + 1]], offsets[k + 1])
                    stay = np.setdiff1d(np.arange(len(own) - 1), np.array(gone[place]))
                    head = data[offsets[k] : own[0]].tobytes()
                    texts[place] = (head + b"".join(data[own[i] : own[i + 1]].tobytes() for i in stay)).decode()
            columns = [batch.column(k) for k in range(batch.num_columns)]
            columns[at] = pa.array(texts, pa.string())
            columns[batch.schema.get_field_index(count)] = pa.array([len(set(x or ())) for x in gone], pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return delete


def without_repeated_blocks(docs: DataFrame, least: int = MIN_BLOCK_WORDS, count: str | None = None) -> DataFrame:
    """`docs` with the blocks of lines gone from `text` that an earlier document has.

    Earlier is the smaller doc_id, among rows with equal doc_id the smaller hash of the text;
    rows with equal doc_id and text are one document.  Rows with a null doc_id, null and
    empty texts and texts without words stay as they are and delete nothing.  A text that repeats
    wholly becomes empty; no row goes.  All other columns stay, whatever their names; `count` adds a column
    of that name with the number of lines deleted, in place of one there is.
    """
    h = F.xxhash64(F.col("text").cast("string"))
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), h.alias("h"))
    own = docs.where("doc_id is not null").select(key.alias("key"), F.col("text").cast("string"))
    kind = "key struct<doc_id: bigint, h: bigint>"
    described = written(own.mapInArrow(_describing, f"{kind}, lines array<long>, words array<int>"), "lines")
    # Most runs are in one document only.  Those of several are told by plain numbers, which are summed up
    # by hash; only their places are looked at again.
    marked = described.select(F.xxhash64("key").alias("mark"), "lines", "words")
    marks = marked.mapInArrow(_running(least, False), "mark long, run long").groupBy("run")
    several = marks.agg(F.min("mark").alias("one"), F.max("mark").alias("two")).where("one != two").select("run")
    runs = described.mapInArrow(_running(least, True), f"{kind}, run long, start int, stop int")
    places = written(runs.join(lookup_side(several, "shared-runs"), "run", "left_semi"), "run-places")
    firsts = lookup_side(places.groupBy("run").agg(F.min("key").alias("first")), "first-places")
    shared = places.join(firsts, "run").where("first < key")
    lists = (F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    pairs = written(shared.groupBy("key", "first").agg(*lists), "line-pairs")
    # Rows of one document would pair with those of another; there seldom are any.
    if described.groupBy("key").count().where(F.col("count") > 1).limit(1).count():
        described = described.dropDuplicates(["key"])
    earlier = described.select(F.col("key").alias("first"), F.col("lines").alias("earlier"))
    both = pairs.join(described, "key").join(earlier, "first").select("key", "earlier", "lines", "words", "starts", "stops")
    gone = both.mapInArrow(_aligning(least), f"{kind}, gone array<int>")
    found, whose = free_name(docs, "gone", count or ""), free_name(docs, "key", count or "")
    gone = gone.groupBy("key").agg(F.flatten(F.collect_list("gone")).alias(found))
    gone = broadcast_if_small(written(gone.withColumnRenamed("key", whose), "gone"))
    docs = docs.drop(count) if count else docs
    joined = docs.withColumn("text", F.col("text").cast("string")).join(gone, key == F.col(whose), "left").drop(whose)
    schema = joined.drop(found).schema.add(found, "long")
    done = joined.mapInArrow(_deleting(found), schema)
    return done.withColumnRenamed(found, count) if count else done.drop(found)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
