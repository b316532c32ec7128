"""Tables written into the folder that driver and executors share, and files opened where a task runs."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession

#: path -> the file, seekable, to be read as a stream.
FileOpener = Callable[[str], BinaryIO]


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset and all runs in one process (``local[...]``), a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pagefinder-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/pagefinder"


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def opened_folder(folder: str):
    """A store that pyarrow knows, and the folder's path there, for tasks."""
    from pyarrow import fs

    if folder.startswith("file:") or "://" not in folder:
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder)


def written(df: DataFrame, tag: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back: what made it runs once, and an executor lost later costs nothing of it."""
    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _made.append(path)
    return out


#: Where tables are that ``written`` made and nothing deleted yet.
_made: list[str] = []


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that were written inside; results that read them must have been stored by then."""
    before = len(_made)
    try:
        yield
    finally:
        for path in _made[before:]:
            delete(spark, path)
        del _made[before:]


def open_file(path: str) -> BinaryIO:
    """A file by the path that Spark's listing gave, opened in the task that reads it.

    Local and mounted folders by the operating system, other stores by what pyarrow knows (hdfs, s3, gs, abfs); a caller with another store brings an opener.
    """
    if path.startswith("file:"):
        return open("/" + path[5:].lstrip("/"), "rb")
    if "://" not in path:
        return open(path, "rb")
    from pyarrow import fs

    store, where = fs.FileSystem.from_uri(path)
    return store.open_input_file(where)
