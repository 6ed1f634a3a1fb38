"""Embedding near-duplicates: products of int8 tiles with proven error bounds.

All vectors are compared in blocks of fixed size: every pair of blocks is a cell, a task's
work is one cell, and its memory does not grow with the table.  Unit vectors are quantised
to int8 with a scale of their own, and the length of what quantising lost is measured for
each: a product of two quantised vectors is off by at most e + f + e*f for losses e and f.
Only pairs that may reach the threshold within that bound are computed again in double
precision.  A cell gives counts and a spanning forest of its links, never the pairs, so a
group of copies costs rows in proportion to its size.  Equal vectors are one class.
"""

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspan.llm.graph import components
from bibspan.operators.sizing import lookup_side, written

BLOCK_ROWS = 2048
_ROWS_AT_ONCE = 256
# Rounding of sums of doubles and of the single-precision scaling, well above what they can be.
_SLACK = 1e-5


class Tile:
    """Unit vectors with their int8 form."""

    def __init__(self, vectors: np.ndarray):
        # Scaling by the largest component first keeps squares finite.
        scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
        self.unit = scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
        self.scale = np.abs(self.unit).max(axis=1) / 127
        self.whole = np.rint(self.unit / self.scale[:, None]).astype(np.int8)
        lost = self.unit - self.whole * self.scale[:, None]
        self.loss = np.sqrt((lost * lost).sum(axis=1))


def possible_pairs(one: Tile, two: Tile, threshold: float, kind):
    """Pairs that may reach the threshold, for some rows of `one` at a time."""
    right = two.whole.T.astype(kind)
    for k in range(0, len(one.unit), _ROWS_AT_ONCE):
        rows = slice(k, k + _ROWS_AT_ONCE)
        about = (one.whole[rows].astype(kind) @ right) * two.scale.astype(kind)
        most = one.loss[rows] + (1 + one.loss[rows]) * two.loss.max()
        a, b = np.nonzero(about >= ((threshold - most - _SLACK) / one.scale[rows]).astype(kind)[:, None])
        near = about[a, b] * one.scale[rows][a]
        a += k
        own = one.loss[a] + two.loss[b] + one.loss[a] * two.loss[b]
        keep = near >= threshold - own - _SLACK
        yield a[keep], b[keep]


def _cosines(one: Tile, two: Tile, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    step = 1 << 14
    parts = [
        np.einsum("ij,ij->i", one.unit[a[k : k + step]], two.unit[b[k : k + step]]) for k in range(0, len(a), step)
    ]
    return np.concatenate(parts) if parts else np.zeros(0)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of nodes with the smallest node of their component, as many as nodes at most."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def _cell(threshold: float):
    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cid", ignore_index=True)
        vectors = np.stack(rows["v"].to_numpy()).astype(np.float64)
        same = bool((rows["one"] == rows["two"]).all())
        first = np.arange(len(rows)) if same else np.flatnonzero(rows["block"] == rows["one"])
        second = first if same else np.flatnonzero(rows["block"] == rows["two"])
        out = {"cid": [], "root": [], "n": []}
        if len(first) and len(second):
            one, two = Tile(vectors[first]), Tile(vectors[second])
            copies = rows["copies"].to_numpy()
            # Sums of products of int8 are whole numbers, exact in single precision up to 2**24.
            kind = np.float32 if vectors.shape[1] * 127 * 127 < 1 << 24 else np.float64
            counts, trees = np.zeros(len(rows)), []
            for a, b in possible_pairs(one, two, threshold, kind):
                near = _cosines(one, two, a, b) >= threshold
                a, b = first[a[near]], second[b[near]]
                apart = a != b
                a, b = a[apart], b[apart]
                counts += np.bincount(a, copies[b], minlength=len(rows))
                if not same:
                    counts += np.bincount(b, copies[a], minlength=len(rows))
                trees.append(forest(a, b, len(rows)))
            node, root = forest(*(np.concatenate(x) for x in zip(*trees)), len(rows))
            some, names = np.flatnonzero(counts), rows["cid"].to_numpy(dtype=object)
            out = {
                "cid": np.concatenate([names[some], names[node]]),
                "root": np.concatenate([np.full(len(some), None), names[root]]),
                "n": np.concatenate([counts[some].astype(np.int64), np.zeros(len(node), np.int64)]),
            }
        kinds = {"cid": object, "root": object, "n": np.int64}
        return pd.DataFrame({name: pd.Series(list(out[name]), dtype=kind) for name, kind in kinds.items()})

    return compare


def near_vectors(table: DataFrame, threshold: float = 0.9, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Groups of vectors of cosine `threshold` or more: vec_id, n_links, component_id, kept.

    Vectors that are null or zero or hold null or non-finite components link with nothing,
    and so do vectors of different lengths.  Every row is a vector, also one that repeats a
    vec_id; n_links counts the other rows linked directly.  component_id is the smallest vec_id
    reachable by links, null if the group has none; `kept` is false for a null vec_id.  Other
    columns are not read.
    """
    vector = F.col("embedding")
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.coalesce(
        vector.isNotNull() & F.forall(vector, number) & F.exists(vector, lambda x: x.isNotNull() & (x != 0)), F.lit(False)
    )
    rows = table.select(F.col("vec_id").cast("long"), F.when(good, vector).alias("v"))
    rows = rows.withColumn("cid", F.when(F.col("v").isNotNull(), F.concat_ws(".", F.xxhash64("v"), F.hash("v"))))
    held = rows.where("cid is not null").groupBy("cid", "v")
    classes = written(held.agg(F.min("vec_id").alias("first"), F.count("*").alias("copies")), "vectors")
    blocks = max(1, -(-classes.count() // block_rows))
    block = F.pmod(F.xxhash64("cid"), F.lit(blocks)).cast("int")
    cells = classes.withColumn("block", block).select(
        "cid", "v", "copies", "block", F.size("v").alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    )
    cells = cells.withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other"))
    found = cells.drop("other").groupBy("dim", "one", "two").applyInPandas(_cell(threshold), "cid string, root string, n long")
    found = written(found, "cells")
    counts = found.where("root is null").groupBy("cid").agg(F.sum("n").alias("n"))
    groups = components(found.where("root is not null").select("cid", "root"))
    named = classes.drop("v").join(written(counts, "counts"), "cid", "left").join(groups.toDF("cid", "g"), "cid", "left")
    named = written(named.withColumn("g", F.coalesce("g", "cid")), "vector-groups")
    least = lookup_side(named.groupBy("g").agg(F.min("first").alias("component_id")), "least")
    links = (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    named = lookup_side(named.join(least, "g").select("cid", links, "component_id"), "named")
    component = F.when(F.col("cid").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    joined = rows.drop("v").join(named, "cid", "left")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
