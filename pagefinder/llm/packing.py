"""Best-fit packing of token sequences, by exact complements of lengths first.

Only the histogram of piece lengths is planned on the driver: it has ``capacity`` entries whatever
the corpus.  The plan is a list of patterns (lengths that share a sequence, and how many such
sequences); pieces then take their places by their rank among pieces of equal length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import MOST_WORDS, encoder
from .common import lengths, materialize, only_cache, slices

CAPACITY = 2048
#: Rows of one length that are ranked together.
RANK_ROWS = 20_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Complements:
    """Which lengths, in stock, sum to a gap exactly: one, two or three of them."""

    def __init__(self, stock: np.ndarray):
        self.stock = stock

    def pair(self, gap: int, high: int | None = None) -> tuple[int, int] | None:
        """The pair a >= b of sum ``gap`` with the longest a (at most ``high``)."""
        low = -(-gap // 2)
        high = min(gap - 1, len(self.stock) - 1, high or gap)
        if high < low:
            return None
        a = np.arange(high, low - 1, -1)
        ok = (self.stock[a] > 0) & (self.stock[gap - a] > np.where(a == gap - a, 1, 0))
        k = int(np.argmax(ok))
        return (int(a[k]), gap - int(a[k])) if ok[k] else None

    def find(self, gap: int) -> tuple[int, ...] | None:
        if gap < len(self.stock) and self.stock[gap] > 0:
            return (gap,)
        if two := self.pair(gap):
            return two
        for a in np.flatnonzero(self.stock[: min(gap - 1, len(self.stock))])[::-1].tolist():
            if 3 * a < gap:
                break
            self.stock[a] -= 1
            two = self.pair(gap - a, a)
            self.stock[a] += 1
            if two:
                return (a, *two)
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in order of place, number of sequences) that use every piece once.

    The longest piece left opens a sequence.  If one, two or three lengths in stock fill the gap
    exactly they are taken; else the longest that fits goes in (best fit) and the search goes on
    with the smaller gap.  A pattern is repeated as often as the stock allows, so the number of
    patterns, and the driver's work, depends on the number of distinct lengths alone.
    """
    stock = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not in 1..{capacity}")
        stock[length] = n
    index, out = Complements(stock), []
    top = capacity
    while True:
        while top and not stock[top]:
            top -= 1
        if not top:
            return out
        taken = [top]
        stock[top] -= 1
        gap = capacity - top
        while gap:
            more = index.find(gap)
            if more is None:
                fits = np.flatnonzero(stock[: gap + 1])
                if not len(fits):
                    break
                more = (int(fits[-1]),)
            for x in more:
                stock[x] -= 1
            taken += more
            gap -= sum(more)
        kinds, uses = np.unique(taken, return_counts=True)
        again = int((stock[kinds] // uses).min())
        stock[kinds] -= again * uses
        out.append((tuple(taken), 1 + again))


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """By length and first rank: the sequence of that rank, and the offset there."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for lengths, n in patterns:
        offset = 0
        for x in lengths:
            rows.append((x, used.get(x, 0), base, offset))
            used[x] = used.get(x, 0) + n
            offset += x
        base += n
    rows.sort()
    a = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return {"key": (a[:, 0] << 45) | a[:, 1], "rank": a[:, 1], "sequence": a[:, 2], "offset": a[:, 3]}


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, vocabulary: str | None = None, most_words: int = MOST_WORDS) -> DataFrame:
    """Documents as pieces: ids of the whole text, then ``end_id``; only longer ones are cut."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache("pieces")
        end = np.uint32(end_id).tobytes()
        for batch in batches:
            for i, j in slices(lengths(batch.column(1)), 2_000_000):
                ids, texts = (batch.column(c).slice(i, j - i).to_pylist() for c in (0, 1))
                rows = []
                for doc, raw in zip(ids, encoder(vocabulary, most_words).encode(texts), strict=True):
                    raw += end
                    for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                        some = raw[at : at + 4 * capacity]
                        rows.append((doc, k, at // 4, len(some) // 4, zlib.crc32(some)))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, vocabulary: str | None = None, most_words: int = MOST_WORDS) -> DataFrame:
    """A row a piece: where it starts in its document, and its sequence and offset there.

    Every document has at least its end id, so null and empty texts give a piece of one token.
    Rows of equal or null doc_id are packed apart; other columns are not read.  Pieces of one length may be any share of the input: they are ranked in
    groups of about ``RANK_ROWS``, dealt by the hash of a number that each piece gets when it is written, so groups are even whatever ids repeat.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, capacity, end_id, vocabulary, most_words).withColumn("_i", F.monotonically_increasing_id()), "pieces")
    counts = {r.length: r["count"] for r in cut.groupBy("length").count().collect()}  # at most capacity rows
    at = spark.sparkContext.broadcast(places(plan(counts, capacity)))
    groups = max(1, -(-max(counts.values(), default=1) // RANK_ROWS))
    cut = cut.withColumn("_g", F.pmod(F.xxhash64("_i"), F.lit(groups)))
    sizes = cut.groupBy("length", "_g").agg(F.count("*").alias("_n"))
    before = sizes.select("length", "_g", (F.sum("_n").over(Window.partitionBy("length").orderBy("_g")) - F.col("_n")).alias("_before"))
    ranked = cut.withColumn("_r", F.row_number().over(Window.partitionBy("length", "_g").orderBy("_i")) - 1)
    ranked = ranked.join(before, ["length", "_g"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_r") + F.col("_before")).alias("rank"))

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = at.value
        for b in batches:
            rank = b.column(5).to_numpy()
            row = np.searchsorted(p["key"], (b.column(3).to_numpy() << 45) | rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(p["sequence"][row] + rank - p["rank"][row]), pa.array(p["offset"][row])], names=[*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(seat, PIECES + ", sequence_id long, offset long")


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
