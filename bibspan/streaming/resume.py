"""Resumable matching of items as an incremental stream.

The ids of items that have been dealt with are keyed state of the stream: a micro-batch looks its own ids up in the
state store, whatever the number of results there are.  Results are appended.  Only where the
state cannot know them are saved results consulted: by the first batch after a restart, which may repeat one that was
appended but not yet recorded as done, and, in a stream with a new checkpoint, results that were there before it.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from bibspan.operators.linkage import unprocessed
from bibspan.sources.sinks import append_results

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def saved_results(spark: SparkSession, out: str) -> DataFrame | None:
    """What has been appended so far, None if nothing has."""
    try:
        return spark.read.parquet(out)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None


def match_new_items(items: DataFrame, match, out: str, checkpoint: str) -> StreamingQuery:
    """Run `match` over the items that have arrived, append its rows to `out`, then stop.

    `items` is a streaming DataFrame with ITEM_ID; `match` maps a batch of items to
    results with item_id.  An item that arrives again is not matched again, also if it had no result.
    """
    spark = items.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    before = saved_results(spark, out)
    started: list[int] = []

    def append(batch: DataFrame, batch_id: int) -> None:
        if not started:
            started.append(batch_id)
        known = None
        if batch_id == started[0]:
            known = saved_results(batch.sparkSession, out)
        elif started[0] == 0:
            known = before
        append_results(match(batch if known is None else unprocessed(batch, known)), out)

    return (
        items.dropDuplicates(["ITEM_ID"])
        .writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
