"""Benchmark decontamination: document words inside a window of a benchmark item.

A prefix-filtered set join for exact containment.  A window is contained only where its
rarest shingle occurs, so one shingle per window, the one that documents hold least often,
is looked up; the place of the shingle in the window fixes where the window would start,
bounds by the length of the document skip the rest, and the window's words are compared
there one by one.  Documents are scanned and never shuffled; the index of the items has a
bounded size, and items beyond it are taken in further passes.
"""

import sys
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspan.llm.common import pieces, utf8
from bibspan.llm.words import WordHasher, runs
from bibspan.operators.sizing import measured_bytes, written

# Items of about this size make one index, held by the driver and every worker.
ITEM_BYTES = 4 << 20
SHINGLE = 3
_FILTER_BITS = 20


class Windows:
    """Windows of some items: where their words start, how many they are, and of which item."""

    def __init__(self, rows, width: int):
        self.items = [row["item_id"] for row in rows]
        data, offsets = utf8(pa.array([row["text"] for row in rows], pa.string()))
        self.words, starts = WordHasher("alphanumeric").words(data, offsets)
        begin, length, item = [], [], []
        for k in range(len(rows)):
            n = int(starts[k + 1] - starts[k])
            count = max(n - width + 1, 1) if n else 0
            begin.append(np.arange(starts[k], starts[k] + count))
            length.append(np.full(count, min(n, width)))
            item.append(np.full(count, k))
        whole = lambda parts: np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
        self.begin, self.length, self.item = whole(begin), whole(length), whole(item)

    def shingles(self):
        """For each shingle width: the windows that use it, and their shingles as rows of a matrix by length."""
        for m in np.unique(self.length):
            width = min(SHINGLE, int(m))
            every = runs(self.words, width)
            own = np.flatnonzero(self.length == m)
            yield width, own, every[self.begin[own, None] + np.arange(m - width + 1)]

    def tokens(self) -> dict:
        """The distinct shingles, ascending, by width."""
        found = {}
        for width, _, matrix in self.shingles():
            found.setdefault(width, []).append(matrix.ravel())
        return {width: np.unique(np.concatenate(parts)) for width, parts in found.items()}

    def index(self, counts: dict) -> dict:
        """By width: sorted prefix tokens with the window and the offset in it of each entry."""
        entries = {}
        for width, own, matrix in self.shingles():
            known = np.array([counts.get(int(x), 0) for x in matrix.view(np.int64).ravel()]).reshape(matrix.shape)
            least = np.lexsort((matrix, known), axis=1)[:, 0]
            entries.setdefault(width, []).append((matrix[np.arange(len(own)), least], own, least))
        index = {}
        for width, parts in entries.items():
            token, window, offset = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(token, kind="stable")
            index[width] = (token[order], window[order], offset[order])
        return index


def _bits(tokens: np.ndarray) -> np.ndarray:
    seen = np.zeros(1 << _FILTER_BITS, dtype=bool)
    seen[tokens >> np.uint64(64 - _FILTER_BITS)] = True
    return seen


def _maybe(found: np.ndarray, seen: np.ndarray) -> np.ndarray:
    return np.flatnonzero(seen[found >> np.uint64(64 - _FILTER_BITS)])


def _counting(shared):
    def count(batches):
        tokens = shared.value
        seen = {width: _bits(own) for width, own in tokens.items()}
        totals = {width: np.zeros(len(own), dtype=np.int64) for width, own in tokens.items()}
        hasher = WordHasher("alphanumeric")
        for batch in pieces(batches):
            hashes, _ = hasher.words(*utf8(batch.column("text")))
            for width, own in tokens.items():
                found = runs(hashes, width)
                found = found[_maybe(found, seen[width])]
                at = np.minimum(np.searchsorted(own, found), len(own) - 1)
                totals[width] += np.bincount(at[own[at] == found], minlength=len(own))
        for width, own in tokens.items():
            some = np.flatnonzero(totals[width])
            yield pa.RecordBatch.from_pydict({"token": own[some].view(np.int64), "n": totals[width][some]})

    return count


def _intervals(mask: np.ndarray) -> np.ndarray:
    """Starts and stops of the runs of true values, in turn."""
    edges = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edges)


def _scanning(shared, names: dict):
    def scan(batches):
        windows, index = shared.value
        seen = {width: _bits(entries[0]) for width, entries in index.items()}
        hasher = WordHasher("alphanumeric")
        for batch in pieces(batches):
            hashes, starts = hasher.words(*utf8(batch.column("text")))
            document = np.repeat(np.arange(batch.num_rows), np.diff(starts))
            hit = np.zeros(len(hashes), dtype=bool)
            for k, old in enumerate(batch.column(names["hits"]).to_pylist()):
                for a, b in zip((old or [])[::2], (old or [])[1::2]):
                    hit[starts[k] + a : starts[k] + b] = True
            held = [set(x or ()) for x in batch.column(names["items"]).to_pylist()]
            for width, entries in index.items():
                for at, window in _matches(hashes, starts, document, runs(hashes, width), windows, entries, seen[width]):
                    reach = windows.length[window]
                    hit[np.repeat(at, reach) + (np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach))] = True
                    owners = np.unique(np.stack([document[at], windows.item[window]]), axis=1)
                    for d, item in owners.T.tolist():
                        if windows.items[item] is not None:
                            held[d].add(windows.items[item])
            spans = [_intervals(hit[a:b]) for a, b in zip(starts[:-1], starts[1:])]
            new = {
                names["words"]: pa.array(np.diff(starts), pa.int64()),
                names["hits"]: pa.array([x.tolist() for x in spans], pa.list_(pa.int64())),
                names["items"]: pa.array([sorted(x) for x in held], pa.list_(pa.string())),
            }
            columns = [new.get(c, batch.column(k)) for k, c in enumerate(batch.schema.names)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return scan


def _matches(hashes, starts, document, found, windows, entries, seen, at_once: int = 1 << 16):
    """Places in the words where a window stands, with the window."""
    token, window, offset = entries
    place = _maybe(found, seen)
    low = np.searchsorted(token, found[place], side="left")
    count = np.searchsorted(token, found[place], side="right") - low
    some = count > 0
    place, low, count = place[some], low[some], count[some]
    ends = np.cumsum(count)
    done = 0
    while done < len(place):
        stop = max(int(np.searchsorted(ends, (ends[done - 1] if done else 0) + at_once, side="right")), done + 1)
        n = count[done:stop]
        entry = np.repeat(low[done:stop], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at, w = np.repeat(place[done:stop], n), window[entry]
        first, m = at - offset[entry], windows.length[w]
        fits = (first >= starts[document[at]]) & (first + m <= starts[document[at] + 1])
        first, w, m = first[fits], w[fits], m[fits]
        for k in range(int(m.max(initial=0))):
            same = (k >= m) | (
                hashes[np.minimum(first + k, len(hashes) - 1)] == windows.words[np.minimum(windows.begin[w] + k, len(windows.words) - 1)]
            )
            first, w, m = first[same], w[same], m[same]
        if len(first):
            yield first, w
        done = stop


def contained_windows(docs: DataFrame, items: DataFrame, width: int = 10, names: dict | None = None,
                      item_bytes: int = ITEM_BYTES) -> DataFrame:
    """`docs` with three more columns: its number of words, hit words and the items found.

    The columns are named by `names` (keys words, hits, items), by default n_words, hits and
    items; hits holds starts and stops of runs of hit words in turn, items the ids as text.
    Columns of `docs` that have these names are replaced, all others stay as they are.
    `items` has item_id and text; an item of fewer than `width` words is one window of
    them, one without words none.  Rows with equal item_id are one item; words of items
    with a null id are hit, but no item is named.  Null and empty texts have no words.
    """
    names = names or {"words": "n_words", "hits": "hits", "items": "items"}
    items = items.select(F.col("item_id").cast("string"), F.col("text").cast("string")).distinct()
    passes = max(1, -(-measured_bytes(items) // item_bytes))
    kinds = {"words": "bigint", "hits": "array<bigint>", "items": "array<string>"}
    found = docs.select(
        *[c for c in docs.columns if c not in names.values()],
        *[F.lit(None).cast(kinds[k]).alias(name) for k, name in names.items()],
    )
    context = docs.sparkSession.sparkContext
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(passes))
    for k in range(passes):
        windows = Windows(items.where(part == k).collect(), width)
        tokens = windows.tokens()
        counted = docs.select("text").mapInArrow(_counting(context.broadcast(tokens)), "token long, n long")
        counts = {row["token"]: row["n"] for row in counted.groupBy("token").agg(F.sum("n").alias("n")).collect()}
        # Broadcasts carry plain data, as workers need not have this package.
        shared = context.broadcast((SimpleNamespace(**vars(windows)), windows.index(counts)))
        found = found.mapInArrow(_scanning(shared, names), found.schema)
        if k < passes - 1:
            found = written(found, "decontaminate")
    return found


def hit_report(found: DataFrame) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, digest of the items, contaminated."""
    n_hit = F.aggregate(
        "hits", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("sign")),
        lambda s, x: F.struct((s["n"] + s["sign"] * x).alias("n"), (-s["sign"]).alias("sign")), lambda s: s["n"],
    )
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
