"""Incremental index: blocks as Parquet, keyed by path, time of change and format version."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import delete, exists

VERSION = "v10"


def cache_key(path: Column, modified: Column, version: str = VERSION) -> Column:
    return F.md5(F.concat_ws("|", path, modified.cast("string"), F.lit(version)))


def hits(files: DataFrame, cached: DataFrame) -> DataFrame:
    """Files whose blocks are cached and free of OCR errors."""
    return files.join(_whole(cached), "cache_key", "left_semi")


def misses(files: DataFrame, cached: DataFrame) -> DataFrame:
    """Files to be read: new, changed, or with an OCR error last time."""
    return files.join(_whole(cached), "cache_key", "left_anti")


def _whole(cached: DataFrame) -> DataFrame:
    """Keys without errors, of blocks or of a store's ``keys``."""
    if "n_errors" in cached.columns:
        return cached.where("n_errors = 0").select("cache_key")
    if "ocr_error" not in cached.columns:
        return cached.select("cache_key").distinct()
    return cached.groupBy("cache_key").agg(F.count("ocr_error").alias("_n")).where("_n = 0").select("cache_key")


def store(blocks: DataFrame, path: str) -> None:
    """Appends blocks with cache_key and modified, under a stamp of this call; ``load`` takes the last stamp of each key.

    Files of the store are as many as the tasks that wrote them, whatever the number of keys.  A write that fails and is
    repeated, as a stream's batch may be, leaves no key twice.  Each call has a folder of its own, and its keys apart from its texts, so that to find out what is
    stored reads no text.
    """
    stamp = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    blocks.write.parquet(f"{path}/{_BLOCKS}/stored={stamp}")
    spark = blocks.sparkSession
    rows = spark.read.schema(blocks.schema).parquet(f"{path}/{_BLOCKS}/stored={stamp}")
    rows.groupBy("cache_key").agg(*(c.alias(k) for k, c in _partial_sums(rows.columns).items())).write.parquet(f"{path}/{_KEYS}/stored={stamp}")  # what has no keys yet, after a failure, is not seen


_BLOCKS, _KEYS, _GONE = "blocks", "keys", "gone"
_KEY_COLUMNS = "cache_key string, n_errors long, file string, n_blocks long, n_text_blocks long, n_scanned_blocks long, n_ocr_done long, stored string"


def _partial_sums(columns: list[str]) -> dict[str, Column]:
    """What reports need to know of a file, so that they need not read its blocks again."""
    out = {"n_errors": F.count("ocr_error") if "ocr_error" in columns else F.lit(0).cast("long")}
    if {"file", "text", "scanned", "block_ord"} <= set(columns):
        real, scan, text = F.col("block_ord") >= 0, F.col("scanned"), F.col("text") != ""
        out |= {"file": F.max("file"), "n_blocks": F.count_if(real), "n_text_blocks": F.count_if(real & ~scan & text), "n_scanned_blocks": F.count_if(real & scan), "n_ocr_done": F.count_if(real & scan & text)}
    return out


def keys(spark: SparkSession, path: str) -> DataFrame:
    """(cache_key, stored, n_errors, and sums of the file's blocks): the last writing of each key of a store."""
    every = spark.read.schema(_KEY_COLUMNS).parquet(f"{path}/{_KEYS}")
    return every.groupBy("cache_key").agg(F.max_by(F.struct(*(c for c in every.columns if c != "cache_key")), "stored").alias("k")).select("cache_key", "k.*")


def current_keys(spark: SparkSession, path: str) -> DataFrame:
    """``keys`` without those that were marked as gone after they were stored."""
    known = keys(spark, path)
    if not exists(spark, f"{path}/{_GONE}"):
        return known
    gone = spark.read.schema("cache_key string, gone string").parquet(f"{path}/{_GONE}").groupBy("cache_key").agg(F.max("gone").alias("gone"))
    return known.join(gone, "cache_key", "left").where("gone is null or gone < stored").drop("gone")


#: Keys of replaced blocks that are sent to all tasks; more are joined by a shuffle.
MOST_STALE = 1_000_000


def load(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of a store as they were written last for each cache_key.

    Only keys are shuffled: blocks stay where they are, but for those whose key was written again later.  These are counted, and sent to all tasks if they are few.
    """
    every = spark.read.schema(_KEY_COLUMNS).parquet(f"{path}/{_KEYS}").select("cache_key", "stored")
    last = keys(spark, path).select("cache_key", F.col("stored").alias("last"))
    stale = every.join(last, "cache_key").where("stored < last").select("cache_key", "stored")
    stamps = [r.stored for r in every.select("stored").distinct().collect()]  # one a call of ``store``
    blocks = spark.read.parquet(f"{path}/{_BLOCKS}").withColumn("stored", F.col("stored").cast("string")).where(F.col("stored").isin(stamps))
    n = stale.limit(MOST_STALE + 1).count()
    if n:
        blocks = blocks.join(F.broadcast(stale) if n <= MOST_STALE else stale, ["cache_key", "stored"], "left_anti")
    return blocks.drop("stored")


def mark_gone(keys_gone: DataFrame, path: str) -> None:
    """Notes keys whose files have changed or are gone, under the time of this call."""
    stamp = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    keys_gone.select("cache_key").distinct().write.parquet(f"{path}/{_GONE}/gone={stamp}")


def current(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of a store without those of keys that were marked as gone after they were stored.

    Only keys are shuffled, as in ``load``.
    """
    blocks = load(spark, path)
    dead = keys(spark, path).join(current_keys(spark, path), "cache_key", "left_anti").select("cache_key")
    n = dead.limit(MOST_STALE + 1).count()
    return blocks if not n else blocks.join(F.broadcast(dead) if n <= MOST_STALE else dead, "cache_key", "left_anti")


def compact(spark: SparkSession, path: str, live: DataFrame | None = None) -> None:
    """Rewrites a store to the last blocks of each key, and deletes the calls that it replaces.

    Keys marked as gone go, and with ``live`` (cache_key) all that are not in it.  New blocks are complete before the old ones are deleted, so that a
    failure in between leaves a store that loads the same.
    """
    old = [r.stored for r in keys(spark, path).select("stored").union(spark.read.schema("stored string").parquet(f"{path}/{_KEYS}")).distinct().collect()]
    blocks = current(spark, path)
    store(blocks if live is None else blocks.join(live.select("cache_key").distinct(), "cache_key", "left_semi"), path)
    for stamp in old:
        for part in (_KEYS, _BLOCKS):
            delete(spark, f"{path}/{part}/stored={stamp}")
    delete(spark, f"{path}/{_GONE}")


def entries(cached: DataFrame) -> DataFrame:
    return cached.agg(F.count_distinct("cache_key").alias("n_entries"))


def clear(spark: SparkSession, path: str) -> None:
    """Removes what ``store`` wrote, and nothing else that lies in the folder."""
    for part in (_KEYS, _BLOCKS, _GONE):
        delete(spark, f"{path}/{part}")
