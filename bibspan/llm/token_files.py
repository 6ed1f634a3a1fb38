"""Token ids on disk: canonical length-limited Huffman codes in independent blocks.

The table of blocks has one row per document, in ascending order of doc_id over its shards:
shard (a folder), place of its first id in the shard, number of ids, the codes as bits, and the
bit offset of every 256th id.  Every stretch between two such checkpoints is decoded on its
own, so a block is decoded in many lanes at once, and a reader may begin anywhere.  The code
book holds the length of each id's code, from which canonical codes follow.
"""

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bibspan.llm.bpe import ByteBpe, tokenizer
from bibspan.llm.common import pieces
from bibspan.session import fresh_folder

MAX_BITS = 16
CHECKPOINT = 256
_IDS_AT_ONCE = 1 << 18
_TEXT_AT_ONCE = 1 << 21


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Lengths of the best prefix code whose codes have `limit` bits at most; 0 for ids without count.

    Package-merge: `limit` times, pairs of packages are joined and merged with the single
    ids; an id's length is the number of the cheapest packages that hold it.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    n = len(used)
    if n > 1 << limit:
        raise ValueError("more ids than codes")
    if n < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    single = counts[order].astype(np.int64)
    rounds, weights = [], single
    for _ in range(limit - 1):
        paired = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([single, paired])
        by = np.argsort(merged, kind="stable")
        rounds.append(by < n)
        weights = merged[by]
    take, total = 2 * n - 2, np.zeros(n, dtype=np.int64)
    for is_single in reversed(rounds):
        # The cheapest packages hold the cheapest ids; the others are pairs of the round before.
        singles = int(is_single[:take].sum())
        total[:singles] += 1
        take = 2 * (take - singles)
    total[:take] += 1
    lengths[order] = total
    return lengths


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes by id, and for all values of MAX_BITS bits the id (shifted by 5) and length of the code they begin with."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    own = lengths[order].astype(np.int64)
    room = np.left_shift(1, MAX_BITS - own)
    first = np.cumsum(room) - room
    codes = np.zeros(len(lengths), dtype=np.uint32)
    codes[order] = first >> (MAX_BITS - own)
    table = np.zeros(1 << MAX_BITS, dtype=np.uint32)
    filled = np.repeat((order.astype(np.uint32) << 5) | own.astype(np.uint32), room)
    table[: len(filled)] = filled
    return codes, table


def packed(ids: list[np.ndarray], codes: np.ndarray, lengths: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """The bits of each run of ids, from the first bit of a byte on, and its checkpoints."""
    sizes = np.array([len(x) for x in ids], dtype=np.int64)
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint16)
    bits = lengths[flat].astype(np.int64)
    ends = np.cumsum(bits)
    stops = np.cumsum(sizes)
    total = np.concatenate(([0], ends))[stops]
    used = np.diff(np.concatenate(([0], total)))
    room = (used + 7) // 8
    base = np.cumsum(room) - room
    shift = base * 8 - (total - used)
    at = ends - bits + np.repeat(shift, sizes)
    value = codes[flat].astype(np.int64) << (24 - (at & 7) - bits)
    out = np.zeros(int(room.sum()) + 3)
    for k in range(3):
        out[k : k + int(room.sum())] += np.bincount(at >> 3, (value >> (16 - 8 * k)) & 255, minlength=int(room.sum()))
    out = out.astype(np.uint8)
    blocks = [out[b : b + r].tobytes() for b, r in zip(base, room)]
    marks = [(at[s - n : s : CHECKPOINT] - 8 * b).astype("<u8").tobytes() for s, n, b in zip(stops, sizes, base)]
    return blocks, marks


def unpacked(blocks: list[bytes], marks: list[bytes], sizes: np.ndarray, table: np.ndarray) -> list[np.ndarray]:
    """Ids of the blocks: one lane per checkpoint, all lanes step by step."""
    raw = np.frombuffer(b"".join([*blocks, b"\0\0\0\0"]), dtype=np.uint8).astype(np.uint32)
    window = (raw[:-3] << 16) | (raw[1:-2] << 8) | raw[2:-1]
    base = np.cumsum([0, *map(len, blocks)])[:-1] * 8
    points = [np.frombuffer(m, "<u8").astype(np.int64) for m in marks]
    at = np.concatenate([p + b for p, b in zip(points, base)]) if points else np.zeros(0, np.int64)
    starts = np.cumsum(sizes) - sizes
    first = np.concatenate([s + CHECKPOINT * np.arange(len(p)) for s, p in zip(starts, points)]) if points else at
    last = np.repeat(starts + sizes, [len(p) for p in points])
    count = np.minimum(last - first, CHECKPOINT)
    order = np.argsort(-count, kind="stable")
    at, first, count = at[order], first[order], count[order]
    out = np.zeros(int(sizes.sum()), dtype=np.uint32)
    active = len(at)
    for step in range(int(count[0]) if active else 0):
        active = int(np.searchsorted(-count, -step, side="left"))
        now = at[:active]
        entry = table[(window[now >> 3] >> (8 - (now & 7)).astype(np.uint32)) & 0xFFFF]
        out[first[:active] + step] = entry >> 5
        now += entry & 31
    return np.split(out, np.cumsum(sizes)[:-1])


TOKENS = "doc_id long, ids binary, id array<int>, n array<long>"


def _tokens(shared, end_id: int):
    """Ids of every text, and at the end of a task one row without: how often each id has come."""

    def encode(batches):
        bpe, end = tokenizer(ByteBpe, shared.value), np.array([end_id], dtype=np.uint16).tobytes()
        total, none = np.zeros(1 << MAX_BITS, dtype=np.int64), (pa.list_(pa.int32()), pa.list_(pa.int64()))
        for batch in pieces(batches, limit=_TEXT_AT_ONCE):
            found = bpe.encode_all([t or "" for t in batch.column("text").to_pylist()])
            ids = [x.tobytes() + end for x in found]
            total += np.bincount(np.frombuffer(b"".join(ids), np.uint16), minlength=len(total))
            columns = [batch.column("doc_id"), pa.array(ids, pa.binary()), *(pa.nulls(len(ids), kind) for kind in none)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "id", "n"])
        some = np.flatnonzero(total)
        last = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([some.tolist()], none[0]), pa.array([total[some].tolist()], none[1])]
        yield pa.RecordBatch.from_arrays(last, names=["doc_id", "ids", "id", "n"])

    return encode


def _groups(batch, sizes: np.ndarray):
    """Slices of a batch with about as many ids as are worked on at once."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + _IDS_AT_ONCE, side="right"))
        stop = max(stop, start + 1)
        yield batch.slice(start, stop - start), sizes[start:stop]
        start = stop


def _packing(shared):
    """Packed blocks, each with its shard: the range of doc_id it is in, null first."""

    def pack(batches):
        lengths, edges = shared.value
        codes, _ = canonical(lengths)
        for batch in batches:
            sizes = np.array([len(x.as_buffer()) // 2 for x in batch.column("ids")], dtype=np.int64)
            for part, own in _groups(batch, sizes):
                ids = [np.frombuffer(x, np.uint16) for x in part.column("ids").to_pylist()]
                bits, marks = packed(ids, codes, lengths)
                doc_id = part.column("doc_id")
                shard = np.searchsorted(edges, doc_id.fill_null(0).to_numpy(), side="left")
                shard[~doc_id.is_valid().to_numpy(zero_copy_only=False)] = 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.astype(np.int32)), doc_id, pa.array(own), pa.array(bits, pa.binary()), pa.array(marks, pa.binary())],
                    names=["shard", "doc_id", "n_tokens", "bits", "checkpoints"],
                )

    return pack


def _numbering(batches):
    """Ids before each block in its shard; a task goes through one or more whole shards."""
    last, done = -1, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        n, shard = batch.column("n_tokens").to_numpy(), batch.column("shard").to_numpy()
        total = np.cumsum(n) - n
        heads = np.flatnonzero(np.diff(shard, prepend=last))
        before = np.zeros(len(n), dtype=np.int64)
        before[heads] = total[heads]
        first = total - np.maximum.accumulate(before)
        first[: heads[0] if len(heads) else len(n)] += done
        last, done = int(shard[-1]), int(first[-1] + n[-1])
        columns = [batch.column(k) for k in range(1, batch.num_columns)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(first), *columns], names=["shard", "first", *batch.schema.names[1:]])


def _unpacking(shared):
    def unpack(batches):
        _, table = canonical(shared.value)
        for batch in batches:
            for part, sizes in _groups(batch, batch.column("n_tokens").to_numpy()):
                ids = unpacked(part.column("bits").to_pylist(), part.column("checkpoints").to_pylist(), sizes, table)
                raw = pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in ("doc_id", "shard", "first")] + [raw], names=["doc_id", "shard", "first", "ids"]
                )

    return unpack


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 2) -> None:
    """Encode the whole `text` of every row, append `end_id`, and write blocks and code book below `folder`.

    Null and empty texts are the end id alone.  Rows with equal doc_id stay as they are,
    one after another; rows with a null doc_id come first.  Vocabularies may have 65,536
    ids.  An empty table gives an empty code book and no blocks.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        shared = spark.sparkContext.broadcast(file.read())
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scratch = fresh_folder(spark, "token-ids")
    docs.mapInArrow(_tokens(shared, end_id), TOKENS).write.option("compression", "zstd").parquet(scratch)
    found = spark.read.schema(TOKENS).parquet(scratch)
    tokens = found.where("ids is not null").select("doc_id", "ids")
    counted = found.where("id is not null").select(F.inline(F.arrays_zip("id", "n"))).groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(1 << MAX_BITS, dtype=np.int64)
    for row in counted.collect():
        counts[row["id"]] = row["n"]
    lengths = code_lengths(counts)
    book = [(int(k), int(lengths[k])) for k in np.flatnonzero(lengths)]
    spark.createDataFrame(book, "id int, bits int").coalesce(1).write.parquet(f"{folder}/codebook")
    # The ranges come from the ids of documents alone, so texts are packed once and shuffled packed.
    n_shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = F.array(*[F.lit(k / n_shards) for k in range(1, n_shards)]) if n_shards > 1 else F.array(F.lit(1.0))
    edges = found.agg(F.percentile_approx("doc_id", shares, 10 * n_shards).alias("edges")).first()["edges"]
    edges = np.unique(np.array(edges or [], dtype=np.int64))
    shared = spark.sparkContext.broadcast((lengths, edges))
    blocks = tokens.mapInArrow(_packing(shared), "shard int, " + BLOCK)
    ordered = blocks.repartition("shard").sortWithinPartitions("shard", "doc_id", "bits")
    numbered = ordered.mapInArrow(_numbering, "shard int, first long, " + BLOCK)
    numbered.write.option("compression", "none").partitionBy("shard").parquet(f"{folder}/blocks")


BLOCK = "doc_id long, n_tokens long, bits binary, checkpoints binary"


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (number of ids of all rows before it) and ids (little-endian 32-bit integers)."""
    lengths = np.zeros(1 << MAX_BITS, dtype=np.uint8)
    for row in spark.read.schema("id int, bits int").parquet(f"{folder}/codebook").collect():
        lengths[row["id"]] = row["bits"]
    blocks = spark.read.schema("shard int, first long, " + BLOCK).parquet(f"{folder}/blocks")
    # One row per shard: their sums are few, whatever the number of documents.
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = shards.select("shard", before.alias("before"))
    ids = blocks.mapInArrow(
        _unpacking(spark.sparkContext.broadcast(lengths)), "doc_id long, shard int, first long, ids binary"
    )
    return ids.join(F.broadcast(shards), "shard").select("doc_id", (F.col("before") + F.col("first")).alias("start"), "ids")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
