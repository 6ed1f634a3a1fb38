"""Ranked lexical search by hashed max-sketches.

A document's impacts fold into coordinates: a term's hash picks one of many, and each keeps the
largest impact of the terms it was picked by.  Within a document the impact of a term, but for
the term's weight, grows with its occurrences only, so the sketch keeps the most occurrences
per coordinate and depends neither on the questions nor on the counts of the corpus.  A batch of
questions looks its terms up in a sketch; weight times the impact found there, summed up,
is never less than the document's score.

The documents of the largest bounds are scored exactly first.  The tenth score found is the
threshold of a question; then every document whose bound reaches it is scored exactly.  Bounds are rigorous, so
the result is that of scoring everything.
"""

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bibspan.llm.common import pieces, utf8
from bibspan.llm.words import WordHasher
from bibspan.operators.sizing import broadcast_if_small, lookup_side, measured_bytes, written

TOP = 10
# Documents of the largest bounds that give the threshold.
SEEDS = 40
# Items of about this size are asked at once, held by the driver and every worker.
ITEM_BYTES = 4 << 20
COORDINATE_BITS = 14
_HASH_BITS = 44
MOST_TIMES = 255
_CELLS = 1 << 21


class Questions:
    """Distinct terms of some items, and each item's terms with their repeats."""

    def __init__(self, rows):
        self.items = [row["item_id"] for row in rows]
        hashes, starts = WordHasher("alphanumeric").words(*utf8(pa.array([row["text"] for row in rows], pa.string())))
        self.terms, at = np.unique(hashes, return_inverse=True)
        self.of = []
        for a, b in zip(starts[:-1], starts[1:]):
            term, repeats = np.unique(at[a:b], return_counts=True)
            self.of.append((term, repeats))


def coordinates(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COORDINATE_BITS)).astype(np.int64)


def looked_up(hashes: np.ndarray, document: np.ndarray, terms: np.ndarray):
    """Documents and places in the sorted `terms` of all words that are one of them."""
    at = np.minimum(np.searchsorted(terms, hashes), max(len(terms) - 1, 0))
    some = np.flatnonzero(terms[at] == hashes) if len(terms) else np.zeros(0, np.int64)
    return document[some], at[some]


def sketches(hashes: np.ndarray, document: np.ndarray, rows: int):
    """Coordinates in use, the most occurrences of a term in each, and where each document's start.

    Terms of one document that agree in the bits compared count as one, which only raises a bound.
    """
    key = (document.astype(np.uint64) << np.uint64(_HASH_BITS)) | (hashes >> np.uint64(64 - _HASH_BITS))
    key, times = np.unique(key, return_counts=True)
    cell = key >> np.uint64(_HASH_BITS - COORDINATE_BITS)
    first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.zeros(0, np.int64)
    most = np.maximum.reduceat(times, first) if len(first) else np.zeros(0, np.int64)
    cell = cell[first]
    place = (cell & np.uint64((1 << COORDINATE_BITS) - 1)).astype(np.uint16)
    starts = np.searchsorted(cell >> np.uint64(COORDINATE_BITS), np.arange(rows + 1).astype(np.uint64))
    return place, np.minimum(most, MOST_TIMES).astype(np.uint8), starts


def _binary(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    offsets = (starts * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _flat(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    size = np.dtype(kind).itemsize
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw.view(kind), (offsets - offsets[0]) // size


INDEX = "doc_id long, h1 long, h2 long, n long, places binary, times binary, terms array<int>, documents array<long>"


def _indexing(shared, sketching: bool):
    """Sketches of documents, and at the end of a task one row: in how many documents each term is."""

    def index(batches):
        terms = shared.value
        found_in = np.zeros(len(terms), dtype=np.int64)
        hasher = WordHasher("alphanumeric")
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]
        names = ["doc_id", "h1", "h2", "n", "places", "times", "terms", "documents"]
        for batch in pieces(batches):
            hashes, starts = hasher.words(*utf8(batch.column("text")))
            document = np.repeat(np.arange(batch.num_rows), np.diff(starts))
            own, term = looked_up(hashes, document, terms)
            found_in += np.bincount(np.unique(own * len(terms) + term) % max(len(terms), 1), minlength=len(terms))
            if sketching:
                place, times, begin = sketches(hashes, document, batch.num_rows)
                none = [pa.nulls(batch.num_rows, kind) for kind in kinds[6:]]
                columns = [*(batch.column(c) for c in names[:3]), pa.array(np.diff(starts), pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, _binary(place, begin), _binary(times, begin), *none], names=names)
        some = np.flatnonzero(found_in)
        last = [[None]] * 3 + [[0], [None], [None], [some.tolist()], [found_in[some].tolist()]]
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(last, kinds)], names=names)

    return index


def impacts(times: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Impact of a term without its weight, by its occurrences and the document's length factor."""
    return 1_000_000_000 * times // (1000 * times + 8 * m)


def length_factor(n: np.ndarray, n_documents: int, n_terms: int) -> np.ndarray:
    return 25 + 75 * n * n_documents // max(n_terms, 1)


def _bounds(batch, asked, corpus):
    """For some of the documents at a time: their places in the batch, and bounds by item and document."""
    slot, n_slots, items = asked
    place, begin = _flat(batch.column("places"), np.uint16)
    times = _flat(batch.column("times"), np.uint8)[0].astype(np.int64)
    m = length_factor(batch.column("n").to_numpy(), *corpus)
    rows = max(min(_CELLS // max(n_slots, 1), _CELLS // max(len(items), 1)), 16)
    for start in range(0, batch.num_rows, rows):
        stop = min(start + rows, batch.num_rows)
        own = slice(begin[start], begin[stop])
        at, document = slot[place[own]], np.repeat(np.arange(stop - start), np.diff(begin[start : stop + 1]))
        some = np.flatnonzero(at >= 0)
        at, document, often = at[some], document[some], times[own][some]
        # As many occurrences as the sketch can tell may be any number more.
        most = np.where(often < MOST_TIMES, impacts(often, m[start:stop][document]), 1_000_000)
        table = np.zeros((n_slots, stop - start))
        table[at, document] = most
        found = np.zeros((len(items), stop - start))
        for k, (slots, weights) in enumerate(items):
            if len(slots):
                found[k] = weights @ table[slots]
        # Sums are whole numbers, exact up to 2^53; beyond it they may be off in the last place.
        yield start, found * (1 + 1e-12)


def _seeding(shared):
    """The documents of the largest bounds of a task, for every item."""

    def seed(batches):
        asked, corpus, _ = shared.value
        best = np.zeros((len(asked[2]), SEEDS))
        ids = np.full(best.shape, None, dtype=object)
        for batch in batches:
            own = np.array(batch.column("doc_id").to_pylist(), dtype=object)
            for start, found in _bounds(batch, asked, corpus):
                every = np.concatenate([best, found], axis=1)
                names = np.concatenate([ids, np.broadcast_to(own[start : start + found.shape[1]], found.shape)], axis=1)
                top = np.argpartition(every, -SEEDS, axis=1)[:, -SEEDS:]
                best, ids = np.take_along_axis(every, top, axis=1), np.take_along_axis(names, top, axis=1)
        item, k = np.nonzero(best)
        yield pa.RecordBatch.from_arrays(
            [pa.array(item, pa.int32()), pa.array(best[item, k]), pa.array(ids[item, k].tolist(), pa.int64())], names=["item", "bound", "doc_id"]
        )

    return seed


def _reaching(shared):
    """The documents whose bound reaches the threshold of an item."""

    def reach(batches):
        asked, corpus, thresholds = shared.value
        for batch in batches:
            for start, found in _bounds(batch, asked, corpus):
                item, k = np.nonzero((found > 0) & (found >= thresholds[:, None]))
                ids = batch.column("doc_id").take(pa.array(start + k))
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), ids], names=["item", "doc_id"])

    return reach


def _scoring(shared):
    """Exact scores of documents for the items in the column `asked`."""

    def score(batches):
        terms, items, corpus = shared.value
        hasher = WordHasher("alphanumeric")
        for batch in pieces(batches):
            hashes, starts = hasher.words(*utf8(batch.column("text")))
            document = np.repeat(np.arange(batch.num_rows), np.diff(starts))
            own, term = looked_up(hashes, document, terms)
            m = length_factor(np.diff(starts), *corpus)
            begin = np.searchsorted(own, np.arange(batch.num_rows + 1))
            out = []
            for k, (doc_id, asked) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("asked").to_pylist())):
                times = np.bincount(term[begin[k] : begin[k + 1]], minlength=len(terms))
                held = impacts(times, m[k])
                for item in asked:
                    held_terms, weights = items[item]
                    total = int((weights * held[held_terms]).sum())
                    if total > 0:
                        out.append((item, doc_id, total))
            columns = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(columns, (pa.int32(), pa.int64(), pa.int64()))], names=["item", "doc_id", "score"]
            )

    return score


def _first_copies(index: DataFrame) -> DataFrame:
    """Of documents of equal text only those that can be among the first: the smallest ids."""
    text = ["h1", "h2"]
    many = index.groupBy(*text).count().where(F.col("count") > TOP).select(*text)
    many = lookup_side(many, "many-copies")
    place = F.row_number().over(Window.partitionBy(*text).orderBy(F.col("doc_id").asc_nulls_last()))
    first = index.select("doc_id", *text).join(many, text, "left_semi").withColumn("place", place).where(F.col("place") <= TOP)
    order = F.struct(F.col("doc_id").isNull(), "doc_id")
    last = lookup_side(first.groupBy(*text).agg(F.max(order).alias("last")), "last-copies")
    return index.join(last, text, "left").where(F.col("last").isNull() | (order <= F.col("last"))).drop("last")


def _best(scores: DataFrame, most: int) -> DataFrame:
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
    return ranked.where(F.col("rank") <= most)


def ranked_documents(docs: DataFrame, items: DataFrame, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The ten best documents of each item: item_id, rank, doc_id, score.

    `docs` has doc_id and text, `items` item_id and text; other columns do not matter,
    whatever their names.  Rows of `docs` are documents each, also with equal or null ids, null last
    among equal scores.  Rows of equal item_id and text are one item, those of equal ids and different
    texts are ranked each.  Null and empty texts have no terms; an item without any, or without a document that has
    one, has no rows.  Terms are compared by 64-bit hashes.  Every item is asked; `item_bytes` only says
    how many at once.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    passes = max(1, -(-measured_bytes(items) // item_bytes))
    part = F.pmod(F.xxhash64(F.col("item_id").cast("string"), "text"), F.lit(passes))
    hashed = docs.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(1)).alias("h2"), "text")
    found, index, corpus = [], None, None
    for k in range(passes):
        asked = Questions(items.where(part == k).collect())
        counted = written(hashed.mapInArrow(_indexing(context.broadcast(asked.terms), index is None), INDEX), "sketches")
        if index is None:
            own = counted.where("n > 0")
            index = written(_first_copies(own).select("doc_id", "n", "places", "times"), "search-index")
            sums = own.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("terms")).first()
            corpus = sums["documents"], sums["terms"] or 0
        pairs = counted.where("terms is not null").select(F.inline(F.arrays_zip("terms", "documents")))
        frequency = np.zeros(len(asked.terms), dtype=np.int64)
        for term, n in pairs.groupBy("terms").agg(F.sum("documents")).collect():
            frequency[term] = n
        weight = np.array([math.floor(1000 * math.log((2 * corpus[0] + 2) / (2 * int(n) + 1))) for n in frequency], dtype=np.int64)
        of = [(term, repeats * weight[term]) for term, repeats in asked.of]
        best = _asked(docs, index, asked, of, corpus)
        names = spark.createDataFrame(list(enumerate(asked.items)), f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        found.append(best.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result


def _asked(docs: DataFrame, index: DataFrame, asked: Questions, of: list, corpus: tuple) -> DataFrame:
    context = docs.sparkSession.sparkContext
    place = coordinates(asked.terms)
    used = np.unique(place)
    slot = np.full(1 << COORDINATE_BITS, -1, dtype=np.int64)
    slot[used] = np.arange(len(used))
    lookups = []
    for term, weights in of:
        slots, at = np.unique(slot[place[term]], return_inverse=True)
        lookups.append((slots, np.bincount(at, weights, minlength=len(slots))))
    exact = context.broadcast((asked.terms, of, corpus))

    def scored(pairs: DataFrame, name: str) -> DataFrame:
        wanted = pairs.groupBy("doc_id").agg(F.collect_set("item").alias("asked")).withColumnRenamed("doc_id", "id")
        joined = docs.join(lookup_side(wanted, name), F.col("doc_id").eqNullSafe(F.col("id"))).select("doc_id", "text", "asked")
        return written(joined.mapInArrow(_scoring(exact), "item int, doc_id long, score long"), f"{name}-scores")

    shared = context.broadcast(((slot, len(used), lookups), corpus, None))
    seeds = index.mapInArrow(_seeding(shared), "item int, bound double, doc_id long")
    order = Window.partitionBy("item").orderBy(F.col("bound").desc(), F.col("doc_id").asc_nulls_last())
    seeds = seeds.withColumn("place", F.row_number().over(order)).where(F.col("place") <= SEEDS)
    tenth = _best(scored(seeds.select("item", "doc_id"), "seeds"), TOP).where(F.col("rank") == TOP)
    thresholds = np.zeros(len(of))
    for item, score in tenth.select("item", "score").collect():
        thresholds[item] = score
    shared = context.broadcast(((slot, len(used), lookups), corpus, thresholds))
    reached = index.mapInArrow(_reaching(shared), "item int, doc_id long")
    return _best(scored(reached, "candidates"), TOP)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
