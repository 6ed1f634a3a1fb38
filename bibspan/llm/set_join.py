"""N-gram Jaccard join: groups of documents whose sets of word shingles are similar.

Exact, by prefixes and by relations between sets:

* Shingles are ordered by rarity (counts in a sketch of fixed size; any order all sets
  share keeps the join exact, a good one keeps lists short).  Two similar sets share a
  shingle among the rarest few of either, so only those make index lists.
* Lists are cut into bands of set sizes, and entries carry their position: a pair is
  skipped where the rest of the sets after the positions cannot reach the overlap needed.
* Every list has one pivot, the entry of the least position, and first all members are
  answered against it.  That is linear in a list, also where a third of all documents
  share it.  Members linked to the pivot are in one group, so pairs among them need no
  answer any more.
* A pair is compared set by set only if the rarest shingles of the two overlap enough.
* The answers for a pivot bound those between its members: from |x∩p|, |y∩p| and the sizes
  follow a lower and an upper bound of |x∩y|.  Pairs of different groups whose upper bound
  is too low are skipped, those whose lower bound suffices are linked, and only the rest
  is compared set by set.

Sets that are equal are one class from the start, whatever the number of copies.  Classes are numbered:
index lists, pairs and links carry the number, a third of the room of the 128 bits that name a set.
"""

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspan.llm.common import pieces, utf8
from bibspan.llm.graph import components
from bibspan.llm.words import WordHasher, mixed, runs
from bibspan.operators.sizing import broadcast_if_small, lookup_side, written

# The sketch of shingle counts: its size is fixed, whatever the input.
SKETCH_BITS = 18
SLICE_BITS = 12
_COUNTED_AT_ONCE = 1 << 20


def shingle_sets(batch, hasher: WordHasher, width: int):
    """The distinct shingles of every text of a batch, ascending; the whole text if it is shorter."""
    data, offsets = utf8(batch.column("text"))
    hashes, starts = hasher.words(data, offsets)
    for k in range(batch.num_rows):
        own = hashes[starts[k] : starts[k + 1]]
        yield np.unique(runs(own, min(width, len(own)))) if len(own) else own


def _counting(width: int):
    def count(batches):
        hasher, held, amount = WordHasher("space"), [], 0
        totals = np.zeros(1 << SKETCH_BITS, dtype=np.int64)

        def add():
            buckets = np.concatenate(held) >> np.uint64(64 - SKETCH_BITS)
            totals[:] += np.bincount(buckets.astype(np.int64), minlength=len(totals))

        for batch in pieces(batches):
            for found in shingle_sets(batch, hasher, width):
                held.append(found)
                amount += len(found)
                if amount > _COUNTED_AT_ONCE:
                    add()
                    held, amount = [], 0
        if held:
            add()
        size = 1 << SLICE_BITS
        for k in range(len(totals) // size):
            own = totals[k * size : (k + 1) * size]
            at = np.flatnonzero(own)
            if len(at):
                yield pa.RecordBatch.from_pydict(
                    {"slice": pa.array([k], pa.int32()), "at": [at.astype(np.uint16).tobytes()],
                     "counts": [own[at].astype(np.uint32).tobytes()]}
                )

    return count


def _adding(batches):
    totals = {}
    for batch in batches:
        for k, at, counts in zip(*(batch.column(c).to_pylist() for c in ("slice", "at", "counts"))):
            own = totals.setdefault(k, np.zeros(1 << SLICE_BITS, dtype=np.int64))
            own[np.frombuffer(at, np.uint16)] += np.frombuffer(counts, np.uint32)
    for k, own in totals.items():
        yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "counts": [own.tobytes()]})


def rarity_sketch(docs: DataFrame, width: int) -> np.ndarray:
    """In how many documents shingles occur, by the first bits of their hash."""
    slices = 1 << (SKETCH_BITS - SLICE_BITS)
    parts = docs.select("text").mapInArrow(_counting(width), "slice int, at binary, counts binary")
    added = parts.repartition(slices, "slice").mapInArrow(_adding, "slice int, counts binary")
    sketch = np.zeros((slices, 1 << SLICE_BITS), dtype=np.int64)
    for row in added.collect():
        sketch[row["slice"]] = np.frombuffer(row["counts"], np.int64)
    return np.minimum(sketch.ravel(), np.iinfo(np.uint32).max).astype(np.uint32)


def set_key(found: np.ndarray) -> bytes | None:
    """128 bits that name a set."""
    if not len(found):
        return None
    one, two = mixed(found), mixed(found ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return np.array([one.sum(dtype=np.uint64), two.sum(dtype=np.uint64)]).astype(">u8").tobytes()


def needed(n: int, percent: int) -> int:
    """Least overlap of a set of n with any similar set."""
    return -(-percent * n // 100)


def _lists(values: list, kind) -> pa.Array:
    offsets = np.zeros(len(values) + 1, dtype=np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int64), kind))


def _prefixes(width: int, percent: int, sketch):
    def describe(batches):
        hasher, counts = WordHasher("space"), sketch.value
        for batch in pieces(batches):
            keys, sizes, rarest = [], [], []
            for found in shingle_sets(batch, hasher, width):
                keys.append(set_key(found))
                sizes.append(len(found))
                keep = len(found) - needed(len(found), percent) + 1 if len(found) else 0
                known = counts[found >> np.uint64(64 - SKETCH_BITS)]
                rarest.append(found[np.lexsort((found, known))[:keep]].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()),
                 _lists(rarest, pa.int64())], names=["doc_id", "k", "n", "prefix"]
            )

    return describe


def _full_sets(width: int):
    def describe(batches):
        hasher = WordHasher("space")
        for batch in pieces(batches):
            found = list(shingle_sets(batch, hasher, width))
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_key(x) for x in found], pa.binary()), _lists([x.view(np.int64) for x in found], pa.int64())],
                names=["key", "shingles"],
            )

    return describe


class SetJoin:
    """One join: its parameters and written tables."""

    def __init__(self, docs: DataFrame, width: int, percent: int):
        self.docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        self.width, self.percent = width, percent
        self.context = docs.sparkSession.sparkContext

    def classes(self) -> DataFrame:
        """Every document with the key and size of its set and the set's rarest shingles."""
        sketch = self.context.broadcast(rarity_sketch(self.docs, self.width))
        described = self.docs.mapInArrow(
            _prefixes(self.width, self.percent, sketch), "doc_id long, k binary, n long, prefix array<long>"
        )
        return written(described, "sets")

    def postings(self, classes: DataFrame, firsts: DataFrame) -> DataFrame:
        """Index entries of shingles that more than one class has, once for each class."""
        named = classes.where("k is not null").withColumnRenamed("k", "key")
        ones = named.join(firsts.select("key", "k", F.col("first").alias("_first")), "key")
        ones = ones.where(F.col("doc_id").eqNullSafe(F.col("_first"))).select("k", "n", "prefix")
        tokens = ones.select(F.explode("prefix").alias("token"))
        live = written(tokens.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token"), "live")
        # A filter of fixed size would let through more of the other shingles, the more there are of both.
        entries = ones.select("k", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "token"))
        return written(entries.join(live, "token"), "postings")

    def lists(self, postings: DataFrame) -> DataFrame:
        # Similar sizes differ by one band at most; the small addend keeps that true in floating point.
        ratio = math.log(100 / self.percent) * (1 + 1e-9) if self.percent < 100 else 1.0
        band = F.floor(F.log(F.col("n").cast("double")) / ratio).cast("int")
        return postings.withColumn("band", F.explode(F.array(band, band + 1)))

    def possible(self, n, m, i, j):
        """Length and position bounds for two entries of one list."""
        long, short = F.greatest(n, m), F.least(n, m)
        rest = F.least(n - i, m - j)
        return (short * 100 >= long * self.percent) & self.enough(rest, n, m)

    def enough(self, overlap, n, m):
        return overlap.cast("long") * (100 + self.percent) >= (n + m).cast("long") * self.percent

    def sets_of(self, keys: DataFrame, firsts: DataFrame) -> DataFrame:
        """Whole sets of some classes, made anew from the text of their first document."""
        reps = lookup_side(keys.distinct().join(firsts, "k").select("k", "key", F.col("first").alias("doc_id")), "compared")
        ids = broadcast_if_small(reps.select(F.col("doc_id").alias("_id")).distinct())
        texts = self.docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text")
        sets = texts.mapInArrow(_full_sets(self.width), "key binary, shingles array<long>")
        return sets.join(reps.select("key", "k"), "key").select("k", "shingles")

    def likely(self, pairs: DataFrame, classes: DataFrame, firsts: DataFrame) -> DataFrame:
        """Bounds of the overlaps of pairs (a, b) from the rarest shingles of either.

        The set whose rarest shingles end first has all it shares among them in the
        other's too, so the overlap is at most what they share and all the rest of the
        larger set.
        """
        keys = pairs.select(F.col("a").alias("k")).union(pairs.select(F.col("b").alias("k"))).distinct()
        reps = lookup_side(keys.join(firsts, "k").select("k", "key", F.col("first").alias("_first")), "paired")
        rare = classes.withColumnRenamed("k", "key").join(reps, "key").where(F.col("doc_id").eqNullSafe(F.col("_first"))).select("k", "n", "prefix")
        one, two = rare.toDF("a", "na", "pa"), rare.toDF("b", "nb", "pb")
        both = two.join(broadcast_if_small(pairs), "b").join(one, "a")
        shared = F.size(F.array_intersect("pa", "pb"))
        rest = F.ceil(F.greatest("na", "nb") * self.percent / 100) - 1
        both = both.select("a", "b", "na", "nb", shared.alias("lo"), (shared + rest).cast("long").alias("hi"))
        return written(both.dropDuplicates(["a", "b"]), "likely")

    def answers(self, pairs: DataFrame, classes: DataFrame, firsts: DataFrame) -> DataFrame:
        """Overlaps of the pairs (a, b): bounds lo and hi, equal where whole sets were compared.

        Pairs that cannot reach the overlap needed are not compared.  Of the others, only
        the set of b travels, to where the set of a is.
        """
        rough = self.likely(written(pairs, "pairs"), classes, firsts)
        reach = self.enough(F.col("hi"), F.col("na"), F.col("nb"))
        pairs = written(rough.where(reach).select("a", "b"), "compared-pairs")
        one = self.sets_of(pairs.select(F.col("a").alias("k")), firsts).toDF("a", "sa")
        two = self.sets_of(pairs.select(F.col("b").alias("k")), firsts).toDF("b", "sb")
        found = two.join(broadcast_if_small(pairs), "b").join(one, "a").select(
            "a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("lo")
        )
        found = found.withColumn("hi", F.col("lo")).withColumn("linked", self.enough(F.col("lo"), F.col("na"), F.col("nb")))
        # A doc_id that occurs in several rows answers its pairs several times.
        found = found.dropDuplicates(["a", "b"]).select("a", "b", F.col("lo").cast("long"), F.col("hi").cast("long"), "linked")
        apart = rough.where(~reach).select("a", "b", F.col("lo").cast("long"), "hi", F.lit(False).alias("linked"))
        return written(found.union(apart), "answers")

    def run(self) -> DataFrame:
        classes = self.classes()
        firsts = classes.where("k is not null").groupBy(F.col("k").alias("key")).agg(F.min("doc_id").alias("first"))
        firsts = written(firsts.select("key", "first", F.monotonically_increasing_id().alias("k")), "classes")
        lists = self.lists(self.postings(classes, firsts))
        entry = F.struct("pos", "n", "k")
        pivots = lists.groupBy("token", "band").agg(F.min(entry).alias("p"), F.count("*").alias("c")).where("c > 1")
        # There are about as many pivots as documents, so they are never broadcast.
        pivots = written(
            pivots.select("token", "band", F.col("p.k").alias("pk"), F.col("p.n").alias("pn"), F.col("p.pos").alias("pp")),
            "pivots",
        )
        listed = written(lists.join(pivots, ["token", "band"]), "listed")
        near = self.possible(F.col("n"), F.col("pn"), F.col("pos"), F.col("pp"))
        pairs = listed.where((F.col("k") != F.col("pk")) & near).select(F.col("pk").alias("a"), F.col("k").alias("b"))
        first = self.answers(pairs.distinct(), classes, firsts)
        links = first.where("linked").select("a", "b")
        groups = written(components(links), "groups")
        more, derived = self.across(listed, first, groups)
        second = self.answers(more, classes, firsts).where("linked").select("a", "b")
        joined = components(
            groups.select("node", "root").where("node != root").toDF("a", "b").union(second).union(derived)
        )
        return self.result(classes, firsts, written(joined, "groups"))

    def across(self, listed: DataFrame, first: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pairs of one list and different groups: those to compare, those linked by derivation."""
        groups = lookup_side(groups, "members")
        mine, pivot = groups.toDF("k", "g"), groups.toDF("pk", "pg")
        known = first.select(F.col("a").alias("pk"), F.col("b").alias("k"), "lo", "hi")
        members = listed.join(mine, "k", "left").join(pivot, "pk", "left")
        members = members.join(broadcast_if_small(known), ["pk", "k"], "left")
        members = members.select(
            "token", "band", "k", "n", "pos", "pn", F.coalesce("g", "k").alias("g"), F.coalesce("pg", "pk").alias("pg"),
            *[F.when(F.col("k") == F.col("pk"), F.col("pn")).otherwise(F.col(c)).alias(c) for c in ("lo", "hi")],
        )
        members = written(members, "list-members")
        x = members.where("g != pg").select(
            "token", "band", *[F.col(c).alias(f"x{c}") for c in ("k", "n", "pos", "g", "lo", "hi")]
        )
        both = members.join(written(x, "list-others"), ["token", "band"]).where(
            (F.col("g") != F.col("xg")) & ((F.col("g") == F.col("pg")) | (F.col("k") < F.col("xk")))
            & self.possible(F.col("n"), F.col("xn"), F.col("pos"), F.col("xpos"))
        )
        upper = F.least(F.col("hi") + F.col("xn") - F.col("xlo"), F.col("xhi") + F.col("n") - F.col("lo"))
        lower = F.col("lo") + F.col("xlo") - F.col("pn")
        both = both.where(F.coalesce(self.enough(upper, F.col("n"), F.col("xn")), F.lit(True)))
        sure = F.coalesce(self.enough(lower, F.col("n"), F.col("xn")), F.lit(False))
        both = both.select(F.least("k", "xk").alias("a"), F.greatest("k", "xk").alias("b"), sure.alias("sure"))
        both = written(both.groupBy("a", "b").agg(F.max("sure").alias("sure")), "across")
        answered = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        return both.where("not sure").select("a", "b").join(answered, ["a", "b"], "left_anti"), both.where("sure").select("a", "b")

    def result(self, classes: DataFrame, firsts: DataFrame, groups: DataFrame) -> DataFrame:
        rooted = firsts.join(groups.toDF("k", "root"), "k", "left").withColumn("root", F.coalesce("root", "k"))
        rooted = written(rooted, "rooted")
        least = lookup_side(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least")
        named = lookup_side(rooted.join(least, "root").select(F.col("key").alias("k"), "component_id"), "named")
        return classes.select("doc_id", "n", "k").join(named, "k", "left").select(
            "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
        )


def similar_sets(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents with similar shingle sets: doc_id, n_shingles, component_id.

    Two documents link when 100 * intersection >= percent * union of their sets of
    distinct shingles of `width` words (fewer words: one shingle of all).  One row per
    input row; other columns of `docs` are not read.  Null and empty texts and texts of
    separators only have the empty set, link with nothing and are their own component.
    Rows that repeat a doc_id are compared like any others; rows with a null doc_id take
    part and have the component of their links, null if that holds no id.
    """
    return SetJoin(docs, width, percent).run()


cloudpickle.register_pickle_by_value(sys.modules[__name__])
