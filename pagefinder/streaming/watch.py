"""A folder watched as a stream.

``watch`` indexes new files in micro-batches, by Spark's own file source, which knows paths, not versions.  ``follow`` knows
versions: new, changed and deleted files, so the store's ``cache.current`` is the index of the folder as it is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import cache, index
from ..sources import documents
from ..sources.files import supported
from ..sources.shared import tidy, written


def watch(spark: SparkSession, folder: str, store: str, checkpoint: str, build: Callable[[DataFrame], DataFrame] = index.build, **trigger) -> StreamingQuery:
    """Starts a query that writes blocks of arriving files to the cache at ``store``; of a batch that is
    repeated after a failure, ``cache.load`` takes the last writing."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)
    write = lambda batch, _: cache.store(build(supported(batch)), store)
    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def follow(spark: SparkSession, folder: str, store: str, checkpoint: str, snapshots: str, build: Callable[[DataFrame], DataFrame] = index.build, **trigger) -> StreamingQuery:
    """Starts a query that keeps the store up with a folder: reads new and changed files, and marks what they replace, and what is deleted, as gone.

    ``build`` gets a listing without content, so files are opened by path.  A batch repeated after a failure stores the same again, which ``cache.load`` counts once.
    """
    documents.register(spark)
    changes = spark.readStream.format("document_changes").option("path", folder).option("snapshots", snapshots).load()

    def apply(batch: DataFrame, _: int) -> None:
        with tidy(spark):
            batch = written(batch, "changes")  # read for either kind of change
            old = batch.where("previous is not null").select(cache.cache_key(F.col("path"), F.col("previous")).alias("cache_key"))
            cache.store(build(batch.where("change <> 'deleted'").select("path", "modificationTime", "length", "suffix")), store)
            cache.mark_gone(old, store)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
