"""Session settings the jobs rely on, and the shared folder for written intermediate tables."""

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

# Adaptive execution sees real sizes at run time: it merges small shuffle partitions,
# turns joins with a small side into broadcasts and splits hot join partitions.  The
# forced skew handling keeps the split even where it costs another shuffle.
# A task holds a batch for Python in both processes, outside the heap, so batches of long texts stay small.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
    "spark.sql.session.timeZone": "UTC",
}


def configured(spark: SparkSession) -> SparkSession:
    for name, value in RUNTIME_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, named by the cluster in spark.checkpoint.dir.

    Only a local master, where one machine does everything, may go without the setting.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="bibspan-")
        spark.conf.set("spark.checkpoint.dir", folder)
        return folder
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


_RUN = uuid.uuid4().hex
_run_folders: set[str] = set()


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder, in the folder of this run."""
    run = f"{shared_folder(spark)}/bibspan/run-{_RUN}"
    _run_folders.add(run)
    return f"{run}/{name}-{uuid.uuid4().hex}"


@atexit.register
def clear_run_folders() -> None:
    """Remove the intermediate tables of this run, and of no other, when its program ends.

    A program that is killed leaves them; the folder of a run bears its own identifier.
    """
    from bibspan.sources.archive import filesystem_of

    while _run_folders:
        try:
            filesystem, name = filesystem_of(_run_folders.pop())
            filesystem.delete_dir(name)
        except OSError:
            pass  # nothing was written, or the store is gone
