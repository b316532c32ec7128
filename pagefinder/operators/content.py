"""Files told by what is in them, so that one that was moved or sent again is not read again.

A new file is compared with stored ones step by step: by length, which the listing says; then by a digest of its first and last
bytes; then by one of the whole file.  Each step is a join of those that were equal so far, so a file of a length of its own is never opened for this.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_name
from ..sources.shared import FileOpener, exists, open_file, written

#: Bytes of each end, and of a read of the whole.
END, READ = 4096, 1 << 20
_DIGESTS = "cache_key string, length long, ends string, whole string"


def _ends(file, length: int) -> str:
    digest = hashlib.md5(file.read(END))
    file.seek(max(0, length - END))
    digest.update(file.read(END))
    return digest.hexdigest()


def _whole(file) -> str:
    digest = hashlib.sha256()
    while part := file.read(READ):
        digest.update(part)
    return digest.hexdigest()


def with_digests(files: DataFrame, ends: bool, whole: bool, opener: FileOpener = open_file) -> DataFrame:
    """Adds ``ends`` and ``whole`` where asked for, to rows with path and length; both are null for a file that can't be read."""
    names = [n for n, want in (("ends", ends), ("whole", whole)) if want]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = {n: [] for n in names}
            for path, length in zip(batch.path, batch.length, strict=True):
                try:
                    with opener(path) as file:
                        found = {"ends": _ends(file, length)} if ends else {}
                        if whole:
                            file.seek(0)
                            found["whole"] = _whole(file)
                except Exception:  # it is read as a new file, and its error told there
                    found = {}
                for n in names:
                    out[n].append(found.get(n))
            yield batch.assign(**out)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields] + [f"{n} string" for n in names])
    return files.mapInPandas(run, schema)


def remember(files: DataFrame, store: str, opener: FileOpener = open_file) -> None:
    """Notes digests of files (cache_key, path, length) that were read into a store."""
    stamp = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    with_digests(files.select("cache_key", "path", "length"), True, True, opener).drop("path").where("whole is not null").write.parquet(f"{store}/digests/noted={stamp}")


def known(spark: SparkSession, store: str) -> DataFrame | None:
    """(cache_key, length, ends, whole) of a store."""
    return spark.read.schema(_DIGESTS).parquet(f"{store}/digests") if exists(spark, f"{store}/digests") else None


def same_as_stored(files: DataFrame, stored: DataFrame, opener: FileOpener = open_file) -> DataFrame:
    """(cache_key, path, modificationTime, length, same_as) of files whose content is that of a stored key; the smallest such key.

    Each step is written before the next, so a file is opened once a step.
    """
    by_length = files.select("cache_key", "path", "modificationTime", "length").join(stored.select("length").distinct(), "length", "left_semi")
    by_ends = written(with_digests(by_length, True, False, opener), "by-ends").join(stored.select("length", "ends").distinct(), ["length", "ends"], "left_semi")
    whole = written(with_digests(by_ends, False, True, opener), "by-whole")
    least = stored.groupBy("length", "ends", "whole").agg(F.min("cache_key").alias("same_as"))
    return whole.join(least, ["length", "ends", "whole"]).select("cache_key", "path", "modificationTime", "length", "same_as")


def copies(blocks: DataFrame, same: DataFrame) -> DataFrame:
    """Blocks of stored keys under the names of files that have the same content; only blocks of these keys are moved."""
    names = same.select(F.col("cache_key").alias("_key"), F.col("path").alias("_path"), F.col("modificationTime").alias("_modified"), F.col("same_as").alias("cache_key"))
    moved = blocks.where(F.col("ocr_error").isNull()).join(names, "cache_key")
    info = F.when(F.col("render_info").isNotNull(), F.col("render_info").withField("pdf_path", F.col("_path")))
    moved = moved.withColumns({"render_info": info, "cache_key": F.col("_key"), "path": F.col("_path"), "file": base_name(F.col("_path")), "modified": F.col("_modified")})
    return moved.drop("_key", "_path", "_modified")
