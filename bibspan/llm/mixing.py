"""Mixing sources to target weights by a low-discrepancy schedule of equal blocks of words.

The words of a source, its documents in a shuffled order, make up one stream that is read as often
as the source's target asks for.  The stream is cut into blocks of equal length.  The slots of
the mix are the points of the van der Corput sequence, mapped through the cumulated numbers of
blocks of all sources: slot t belongs to the source whose interval holds the bits of t in
reverse.  So every stretch of the mix holds the sources in their shares, and each source gets
exactly as many slots as it has blocks.  The k-th slot of a source takes its k-th block.

Everything is DataFrame work.  Running sums are taken in two levels, within ranges of a
bounded number of rows and over the sums of the ranges, so that no source, however large, has
to pass through one task.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bibspan.operators.sizing import broadcast_if_small, written

WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
BLOCK_WORDS = 512
# Rows of a range of a running sum, and copies of a row that are shuffled as one document.
RANGE_ROWS = 20_000
MOST_COPIES = 1000
SLOT_BITS = 16
WORD = r"[^\x20\x09-\x0D]+"


@dataclass
class Mix:
    """The sources with their targets, the documents in stream order, and what the slots take."""

    sources: DataFrame
    documents: DataFrame
    schedule: DataFrame


def running_sum(df: DataFrame, group: list[str], span: str, order: list[str], value: str, name: str) -> DataFrame:
    """`df` with a column `name`: the sum of `value` over the rows of the group that come before.

    Rows are in the order of `span` and, within it, of `order`.  A task holds the rows of one
    span; of a whole group only the sums of its spans meet.
    """
    earlier = Window.partitionBy(*group).orderBy(span).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*group, span).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*group, span).agg(F.sum(value).alias("sum"))
    sums = sums.select(*group, span, F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("before"))
    joined = df.join(broadcast_if_small(written(sums, "spans")), [*group, span])
    total = F.col("before") + F.coalesce(F.sum(value).over(inside), F.lit(0))
    return joined.withColumn(name, total).drop("before")


def counted_rows(docs: DataFrame) -> DataFrame:
    """Rows without their texts; rows of equal doc_id, source and text are one, with their number."""
    text = F.col("text").cast("string")
    size = F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")
    narrow = docs.select("doc_id", "source", size.alias("size"), F.coalesce(F.md5(text), F.lit("")).alias("digest"))
    return narrow.groupBy("doc_id", "source", "size", "digest").agg(F.count(F.lit(1)).alias("copies"))


def numbered_sources(rows: DataFrame, weights=WEIGHTS) -> DataFrame:
    """Sources in code-point order, null last, with a number from 0, a weight, words and rows."""
    sums = rows.groupBy("source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count(F.lit(1)).alias("n_rows")
    )
    # Sorted ranges, the place in the range below the number of the range: no single task sorts all.
    place = F.monotonically_increasing_id()
    ordered = sums.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    placed = ordered.withColumn("place", place).withColumn("one", F.lit(1).cast("long"))
    placed = written(placed.withColumn("span", F.shiftright("place", 33)), "sources")
    numbered = running_sum(placed, [], "span", ["place"], "one", "number")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    return numbered.select("number", "source", weight.alias("weight"), "source_size", "n_rows")


def with_targets(sources: DataFrame, most: int = MOST_PASSES) -> DataFrame:
    """Sources with the words the mix shall take: all words by weight, at most `most` times the source's.

    What a source cannot take is shared again by weight until none is above its limit.  Only
    sums over the sources come to the driver.
    """
    limit = F.col("source_size") * most
    whole = sources.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights")).first()
    words, weights = whole["words"] or 0, whole["weights"] or 0
    left_words, left_weights, n_above = words, weights, 0
    while True:
        share = F.col("weight") * F.lit(left_words) / F.lit(max(left_weights, 1))
        above = share > limit
        found = sources.where(above).agg(F.sum(limit).alias("words"), F.sum("weight").alias("weights"), F.count(F.lit(1)).alias("n")).first()
        if found["n"] == n_above:
            return sources.withColumn("target", F.when(above, limit.cast("double")).otherwise(share))
        n_above, left_words, left_weights = found["n"], words - found["words"], weights - found["weights"]


def _blocks(sources: DataFrame, block: int) -> DataFrame:
    """Sources with the whole words they give, their number of blocks, and the blocks of sources before."""
    limit = F.col("source_size") * MOST_PASSES
    taken = F.least(F.round("target").cast("long"), limit)
    sized = sources.withColumn("words", taken).withColumn("blocks", F.ceil(F.col("words") / F.lit(block)).cast("long"))
    return running_sum(sized.withColumn("span", F.expr(f"number div {RANGE_ROWS}")), [], "span", ["number"], "blocks", "first_block").drop("span")


def slots(sources: DataFrame) -> DataFrame:
    """All slots of the mix: slot, number of the source, and which of the source's blocks it takes."""
    n_blocks = sources.agg(F.sum("blocks")).first()[0] or 0
    bits = max(int(n_blocks).bit_length(), 1)
    step = 1 << SLOT_BITS
    starts = sources.where("blocks > 0").select(
        "number", "first_block", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1, F.lit(step).cast("long"))).alias("from")
    )
    until = F.least(F.col("from") + step, F.col("blocks")) - 1
    points = starts.repartition("number", "from").select("number", "first_block", F.explode(F.sequence("from", until)).alias("point"))
    reversed_bits = F.reverse(F.lpad(F.bin(F.col("first_block") + F.col("point")), bits, "0"))
    at = points.select("number", F.conv(reversed_bits, 2, 10).cast("long").alias("slot"), F.lit(1).cast("long").alias("one"))
    spread = written(at.withColumn("span", F.shiftright("slot", SLOT_BITS)), "slots")
    return running_sum(spread, ["number"], "span", ["slot"], "one", "block").select("slot", "number", "block")


def _streams(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents in the shuffled order of their source, with the place of their first word in its stream."""
    pieces = F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {MOST_COPIES}"))
    parted = rows.select("*", F.explode(pieces).alias("part"))
    copies = F.least(F.col("copies") - F.col("part") * MOST_COPIES, F.lit(MOST_COPIES))
    place = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "digest", F.col("part").cast("string")))
    known = sources.select(F.col("source").alias("own"), "number", "n_rows")
    placed = parted.select("doc_id", "source", "digest", "part", "size", copies.alias("copies"), place.alias("place")).join(
        broadcast_if_small(known), F.col("source").eqNullSafe(F.col("own"))
    )
    # The first digits of the place pick one of the source's ranges, in order.
    spans = F.expr(f"n_rows div {RANGE_ROWS} + 1")
    span = F.shiftright(F.conv(F.substring("place", 1, 7), 16, 10).cast("long") * spans, 28)
    sized = placed.withColumn("span", span).withColumn("own_words", F.col("size") * F.col("copies")).drop("own", "n_rows", "source")
    return running_sum(sized, ["number"], "span", ["place", "doc_id", "digest"], "own_words", "start").drop("span")


def mixed(docs: DataFrame, weights=WEIGHTS, block: int = BLOCK_WORDS) -> Mix:
    """A mix of the sources of `docs`, of as many words as they have together.

    `docs` has doc_id, text and source; other columns do not matter, whatever their names.
    Sources, in code-point order with null last, weigh as `weights` say, over and over.  None gives more
    than three times its words, so no document is taken more than three times.  A null text
    has no words; documents without words are in `documents` and in no slot.  Rows of equal
    doc_id, source and text are one document, as long as all of them together, in parts of at
    most 1,000 rows.  The order of a source is that of a digest, so a second run gives the same
    mix.  An empty table gives an empty mix.

    `schedule` has one row per piece of a document in a slot: slot, number of the source, block,
    which pass over the source it is, doc_id, digest and part of the document, where the piece starts
    in it, and its words.
    """
    rows = written(counted_rows(docs), "mix-rows")
    targets = written(with_targets(written(numbered_sources(rows, weights), "numbered")), "targets")
    sources = written(_blocks(targets, block), "source-blocks")
    documents = written(_streams(rows, sources), "streams")
    wanted = broadcast_if_small(sources.select("number", "words", "source_size"))
    begin = F.col("pass") * F.col("source_size") + F.col("start")
    passes = documents.where("own_words > 0").join(wanted, "number").select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(MOST_PASSES - 1).cast("long"))).alias("pass")
    )
    ranges = passes.select(
        "number", "doc_id", "digest", "part", "pass", begin.alias("begin"),
        F.least(begin + F.col("own_words"), F.col("words")).alias("end"),
    ).where("begin < end")
    cut = ranges.select("*", F.explode(F.sequence(F.expr(f"begin div {block}"), F.expr(f"(end - 1) div {block}"))).alias("block"))
    first = F.greatest(F.col("begin"), F.col("block") * block)
    last = F.least(F.col("end"), (F.col("block") + 1) * block)
    pieces = cut.select(
        "number", "block", "pass", "doc_id", "digest", "part", (first - F.col("begin")).alias("first_word"), (last - first).alias("words")
    )
    schedule = slots(sources).join(pieces, ["number", "block"])
    return Mix(sources, documents, schedule)


def taken_words(mix: Mix) -> DataFrame:
    """One row per row of the documents: doc_id, size, source_size, target, and the words the mix takes of it.

    Of equal rows each takes the same, give or take one word.
    """
    key = ["number", "doc_id", "digest", "part"]
    none = mix.documents.select(*key, "size", "copies", F.lit(0).cast("long").alias("words"))
    used = mix.schedule.select(*key, F.lit(None).cast("long").alias("size"), F.lit(None).cast("long").alias("copies"), "words")
    totals = none.unionByName(used).groupBy(*key).agg(F.max("size").alias("size"), F.max("copies").alias("copies"), F.sum("words").alias("words"))
    each = totals.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    own = F.expr("words div copies + if(copy <= words % copies, 1, 0)").cast("long")
    sources = broadcast_if_small(mix.sources.select("number", "source_size", "target"))
    return each.join(sources, "number").select("doc_id", "size", "source_size", "target", own.alias("taken"))
