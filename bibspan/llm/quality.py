"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the bytes and word hashes of whole texts by numpy.  Trees are grown level by
level on binned statistics, and are complete: a tree is three flat arrays in heap order, and
all rows of a batch walk all trees a level at a time.
"""

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspan.llm.common import held_out, pieces, utf8
from bibspan.llm.labelled import training_rows
from bibspan.llm.words import WordHasher, runs

# The sample: labelled documents of each class.
MOST_DOCUMENTS = 6000
TREES = 150
DEPTH = 4
BINS = 64
RATE = 0.1
LEAST_HESSIAN = 2.0
RIDGE = 1.0

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": [32], "line": [10],
    "stop": map(ord, ".,;:?"), "shout": [33], "bar": [124], "symbol": map(ord, "#$%&*+/<=>@\\^_`~"),
    "bracket": map(ord, "()[]{}\"'-"), "wide": range(128, 256),
}
NAMES = (
    "bytes", "words", "word_length", *(f"share_{c}" for c in _CLASSES), "entropy", "line_length", "lines",
    "distinct_words", "distinct_threes", "distinct_tens", "top_word", "top_three", "short_words", "long_words", "word_spread",
)
_MEMBER = np.zeros((256, len(_CLASSES)))
for _k, _bytes in enumerate(_CLASSES.values()):
    _MEMBER[list(_bytes), _k] = 1


def _repeats(values: np.ndarray) -> tuple[float, float]:
    """Shares of distinct values and of the most frequent one."""
    if not len(values):
        return 1.0, 0.0
    counts = np.unique(values, return_counts=True)[1]
    return len(counts) / len(values), counts.max() / len(values)


def statistics(batch, hasher: WordHasher) -> np.ndarray:
    """A row of statistics (NAMES) for every text; empty and null texts have zeros and shares of one."""
    data, offsets = utf8(batch.column("text"))
    rows, size = len(offsets) - 1, np.diff(offsets)
    text = np.repeat(np.arange(rows), size)
    counts = np.bincount(text * 256 + data, minlength=rows * 256).reshape(rows, 256).astype(float)
    total = np.maximum(size, 1)[:, None]
    share = counts / total
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    hashes, places = hasher.located(data, offsets)
    starts = np.searchsorted(places, offsets)
    words = np.diff(starts)
    letters = size - counts[:, 32] - counts[:, 9:14].sum(axis=1)
    lines = counts[:, 10] + 1
    # The way from one word's start to the next is its length with the space after it.
    way = np.diff(np.append(places, len(data)))
    more = []
    for k in range(rows):
        own = hashes[starts[k] : starts[k + 1]]
        step = way[starts[k] : starts[k + 1]]
        one, top = _repeats(own)
        three, top_three = _repeats(runs(own, 3))
        ten, _ = _repeats(runs(own, 10))
        n = max(len(own), 1)
        more.append((one, three, ten, top, top_three, (step <= 3).sum() / n, (step > 12).sum() / n, step.std() if len(own) else 0.0))
    head = [np.log1p(size), np.log1p(words), letters / np.maximum(words, 1)]
    middle = [entropy, np.log1p(size / lines), np.log1p(lines)]
    tail = np.array(more, dtype=float).reshape(rows, -1)
    return np.column_stack([*head, share @ _MEMBER, *middle, tail])


class Trees:
    """Complete trees as flat arrays, trees by nodes in heap order; leaves hold log odds."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray, start: float):
        self.feature, self.threshold, self.leaf, self.start = feature, threshold, leaf, start

    def plain(self):
        return self.feature, self.threshold, self.leaf, self.start


def scores(rows: np.ndarray, feature, threshold, leaf, start: float) -> np.ndarray:
    """Probabilities of label 1: all rows walk all trees, one level at a time."""
    depth = int(np.log2(leaf.shape[1])) if leaf.size else 0
    at = np.zeros((len(rows), len(feature)), dtype=np.int64)
    tree, row = np.arange(len(feature))[None, :], np.arange(len(rows))[:, None]
    for _ in range(depth):
        at = 2 * at + 1 + (rows[row, feature[tree, at]] > threshold[tree, at])
    odds = start + leaf[tree, at - ((1 << depth) - 1)].sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def train(rows: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> Trees:
    """Boosting of the log loss; a sample of one class gives no trees but its share."""
    mean = np.clip(np.average(labels, weights=weight) if len(labels) else 0.5, 1e-3, 1 - 1e-3)
    start, inner = float(np.log(mean / (1 - mean))), (1 << DEPTH) - 1
    grown = TREES if len(set(labels.tolist())) == 2 else 0
    feature = np.zeros((grown, inner), dtype=np.int64)
    threshold = np.full((grown, inner), np.inf)
    leaf = np.zeros((grown, inner + 1))
    if not grown:
        return Trees(feature, threshold, leaf, start)
    width = rows.shape[1]
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], rows[:, f], side="left") for f in range(width)], axis=1)
    odds = np.full(len(rows), start)
    for t in range(grown):
        p = 1 / (1 + np.exp(-odds))
        gradient, hessian = weight * (labels - p), weight * p * (1 - p)
        node = np.zeros(len(rows), dtype=np.int64)
        for level in range(DEPTH):
            first, many = (1 << level) - 1, 1 << level
            cell = ((node - first)[:, None] * width + np.arange(width)) * BINS + binned
            shape = (many, width, BINS)
            sums = [
                np.bincount(cell.ravel(), np.repeat(v, width), minlength=many * width * BINS).reshape(shape).cumsum(axis=2)
                for v in (gradient, hessian)
            ]
            whole = [s[:, :1, -1:] for s in sums]
            rest = [w - s for w, s in zip(whole, sums)]
            gain = sums[0] ** 2 / (sums[1] + RIDGE) + rest[0] ** 2 / (rest[1] + RIDGE) - whole[0] ** 2 / (whole[1] + RIDGE)
            gain[(sums[1] < LEAST_HESSIAN) | (rest[1] < LEAST_HESSIAN)] = -1
            best = gain.reshape(many, -1).argmax(axis=1)
            for k, b in enumerate(best.tolist()):
                f, cut = divmod(b, BINS)
                if gain[k, f, cut] > 1e-9 and cut < len(edges[f]):
                    feature[t, first + k], threshold[t, first + k] = f, edges[f][cut]
            own = node
            node = 2 * own + 1 + (rows[np.arange(len(rows)), feature[t, own]] > threshold[t, own])
        at = node - inner
        up, down = (np.bincount(at, v, minlength=inner + 1) for v in (gradient, hessian))
        leaf[t] = RATE * up / (down + RIDGE)
        odds += leaf[t][at]
    return Trees(feature, threshold, leaf, start)


def _describing(batches):
    hasher = WordHasher("space")
    for batch in pieces(batches):
        rows = statistics(batch, hasher)
        flat = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1]).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column("label"), flat], names=["label", "row"])


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_DOCUMENTS) -> Trees:
    """Trees for `labels.quality`, from at most `most` documents of each class outside the held-out quarter.

    The classes are weighted by their numbers among all rows that may be learnt from.
    """
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id").cast("long")))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    sample = training_rows(docs, labels, "quality", most).mapInArrow(_describing, "label int, row array<double>")
    found = sorted((tuple(r["row"]), r["label"]) for r in sample.collect())
    rows = np.array([r for r, _ in found]).reshape(len(found), len(NAMES))
    y = np.array([label for _, label in found], dtype=float)
    weight = np.ones(len(y))
    for value in (0, 1):
        own = y == value
        if own.any():
            weight[own] = counts[value] / own.sum()
    return train(rows, y, weight / weight.mean() if len(y) else weight)


def _scoring(shared, name: str):
    def score(batches):
        trees, hasher = shared.value, WordHasher("space")
        for batch in pieces(batches):
            values = scores(statistics(batch, hasher), *trees)
            columns = [batch.column(k) for k in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(values)], names=[*batch.schema.names, name])

    return score


def with_quality(docs: DataFrame, trees: Trees, name: str = "score") -> DataFrame:
    """`docs` with a column `name`: how likely the whole `text` is of label 1, from 0 to 1.

    Only the text counts; null and empty texts are scored as texts without words.  A column
    of that name is replaced; all others and repeated rows stay as they are.
    """
    docs = docs.drop(name)
    schema = docs.select("*", F.lit(0.0).alias(name)).schema
    return docs.mapInArrow(_scoring(docs.sparkSession.sparkContext.broadcast(trees.plain()), name), schema)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
