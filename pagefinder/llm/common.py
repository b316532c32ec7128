"""Shared pieces: durable intermediate tables, text tokenisation, Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases A-Z and turns every ASCII byte that is no letter or digit into a blank; bytes of
#: other characters (0x80 up) stay, so splitting the result gives words of UTF-8 text.
WORD_TABLE = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)


def words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 text after lower-casing A-Z."""
    return text.translate(WORD_TABLE).split()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a folder of our own where it is unset
    and driver and executors are one process (``local[...]``); elsewhere that would be no shared folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pagefinder-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def materialize(df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back.

    This cuts lineage: what was computed is read again after an executor is lost, and values that
    depend on how rows were dealt to tasks (row ids, chunk ids) are fixed from here on.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pagefinder/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _stored[out] = path
    if _scopes:
        _scopes[-1].append(out)
    return out


#: Where tables made by ``materialize`` are.
_stored: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: Tables of each open ``scratch``.
_scopes: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Deletes at its end what ``materialize`` wrote inside, but for what the function it gives was asked to write and keep."""
    mine: list[DataFrame] = []
    _scopes.append(mine)

    def keep(df: DataFrame, tag: str) -> DataFrame:
        out = materialize(df, tag)
        mine.pop()
        if len(_scopes) > 1:
            _scopes[-2].append(out)  # an operator inside another one: the outer one's to delete
        return out

    try:
        yield keep
    finally:
        _scopes.remove(mine)
        discard(*mine)


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by ``materialize`` that nothing reads any more; others are left alone."""
    for df in tables:
        if path := _stored.pop(df, None):
            context = df.sparkSession.sparkContext
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    """How many parts a shuffle of this session makes."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def utf8(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow string column as UTF-8 bytes; null gives an empty text."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def lengths(column: pa.Array) -> list[int]:
    """Bytes of each text of an Arrow string column; null has none."""
    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Cuts 0..len(sizes) into runs of at most ``most`` in total, or of one item that is larger."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of links (a, b) that already connect everything all links connect."""
    root = list(range(n))
    kept = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        while root[y] != y:
            root[y] = root[root[y]]
            y = root[y]
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append(k)
    return np.array(kept, dtype=np.int64)


def with_rid(docs: DataFrame) -> DataFrame:
    """(rid, row): every row under an id of its own, all its columns as they are in a struct.

    Written, so that the ids are the same whenever it is read; a row is told from all others by ``rid``,
    whatever ids repeat or are null, and no column of the caller's can clash.
    """
    return materialize(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")), "rows")


def bucket5(column: str = "doc_id"):
    """crc32 of the id as text, modulo 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5


#: Rows of fixed width that may be broadcast, about 30 MB as a hash table; counted before each use.
MOST_BROADCAST_ROWS = 1_000_000


def sized_broadcast(df: DataFrame, most: int = MOST_BROADCAST_ROWS, rows: DataFrame | None = None) -> DataFrame:
    """Marks a written table of a few fixed-width columns for broadcast if it has at most ``most`` rows.

    Beyond that the join is left to a shuffle, which adaptive execution splits where keys are skewed.
    ``rows``: the table to be counted, where ``df`` holds its rows in arrays.
    """
    counted = df if rows is None else rows
    return F.broadcast(df) if counted.limit(most + 1).count() <= most else df.hint("merge")


#: What workers keep between tasks, by name: how to empty it.
caches: dict[str, Callable[[], bool]] = {}


def only_cache(name: str = "") -> None:
    """At a task's start: workers are reused, so tables that other operators left in this one go."""
    if any([clear() for key, clear in caches.items() if key != name]):
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # a C library without it
            pass
