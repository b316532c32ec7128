"""An inverted index of character trigrams, for locating without a scan.

Blocks are written in the order of files, in segments of some thousand.  For each trigram of a segment there is a
posting: which blocks of the segment have it, as ascending numbers in gaps, and how often at most one block does.  Postings lie in
buckets of trigrams, sorted.  A query reads the buckets of its words' trigrams only.  The rarest trigrams of a word are intersected, and
the word is looked for in the blocks that are left (``locate``).  The greatest counts bound the score of a segment, so
that segments that cannot be in the result are never read (``locate_top``).

A trigram is a number, three code points of 21 bits.  Words of one or two characters have none; queries with such words scan the blocks of the index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.keywords import keywords
from . import locate as plain

#: Blocks of a segment (two bytes count them), folders of postings, trigrams of a word that are intersected.
SEGMENT_BLOCKS, BUCKETS, RAREST = 4096, 64, 3
#: Characters whose trigrams are counted in one go, and of blocks whose postings are made together.
_PIECE, _SLICE = 1 << 20, 8 << 20
#: Segments that a query names in its filter; more are found by the join alone.
MOST_NAMED = 10_000
MOST_BROADCAST = 1_000_000

_POSTINGS = "segment long, gram long, n int, most int, gaps binary"


def word_grams(word: str) -> list[int]:
    """The distinct trigrams of a word."""
    return sorted({ord(a) << 42 | ord(b) << 21 | ord(c) for a, b, c in zip(word, word[1:], word[2:], strict=False)})


def _text_grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of a text and their counts, a long text piece by piece."""
    grams, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for begin in range(0, max(1, len(text) - 2), _PIECE):
        points = np.frombuffer(text[begin : begin + _PIECE + 2].encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        if len(points) < 3:
            break
        found, n = np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:], return_counts=True)
        if not len(grams):
            grams, counts = found, n
        else:
            grams, at = np.unique(np.concatenate([grams, found]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n])).astype(np.int64)
    return grams, counts


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of blocks (segment, at, text) that come in order; a segment may have several for a trigram, of different blocks."""
    segment, held, size = None, [], 0
    for batch in batches:
        for s, at, text in zip(*(batch.column(c).to_pylist() for c in ("segment", "at", "text")), strict=True):
            if held and (s != segment or size > _SLICE):
                yield _posting_rows(segment, held)
                held, size = [], 0
            segment = s
            held.append((at, *_text_grams(text)))
            size += len(text)
    if held:
        yield _posting_rows(segment, held)


def _posting_rows(segment: int, held: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    gram = np.concatenate([g for _, g, _ in held])
    count = np.concatenate([c for _, _, c in held])
    at = np.repeat(np.array([a for a, _, _ in held], dtype=np.int64), [len(g) for _, g, _ in held])
    order = np.lexsort((at, gram))
    gram, count, at = gram[order], count[order], at[order]
    grams, first = np.unique(gram, return_index=True)
    ends = np.append(first, len(gram))
    gaps = np.diff(at, prepend=0)
    gaps[first] = at[first]
    most = np.maximum.reduceat(count, first) if len(first) else count
    lists = pa.BinaryArray.from_buffers(pa.binary(), len(grams), [None, pa.py_buffer((2 * ends).astype(np.int32)), pa.py_buffer(gaps.astype("<u2"))])
    columns = [pa.array(np.full(len(grams), segment, np.int64)), pa.array(grams), pa.array(np.diff(ends).astype(np.int32)), pa.array(np.minimum(most, 2**31 - 1).astype(np.int32)), lists]
    return pa.RecordBatch.from_arrays(columns, ["segment", "gram", "n", "most", "gaps"])


def build(blocks: DataFrame, path: str, segment_blocks: int = SEGMENT_BLOCKS, buckets: int = BUCKETS) -> None:
    """Writes an index of ``blocks`` (file, page, chapter, text, block_ord, perhaps file_ord) to a new folder.

    Texts are shuffled once, by ranges of file and place; then each task makes postings of its own blocks, and only postings are shuffled, to their buckets.
    No task holds more than a slice of a segment, however frequent a trigram is.  Null texts count as empty.
    """
    if not 0 < segment_blocks <= 1 << 16:
        raise ValueError("a segment has 1 to 65536 blocks")
    spark = blocks.sparkSession
    order = [c for c in ("file_ord", "file", "block_ord") if c in blocks.columns]
    columns = [c for c in ("file_ord", "file", "page", "chapter", "text", "block_ord") if c in blocks.columns]
    rows = blocks.select(*columns).withColumn("text", F.coalesce("text", F.lit(""))).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.withColumn("_i", F.monotonically_increasing_id())
    within = F.col("_i").bitwiseAND((1 << 33) - 1)
    segment = F.shiftright("_i", 33) * F.lit(1 << 33) + F.floor(within / segment_blocks)
    rows = rows.withColumn("segment", segment.cast("long")).withColumn("at", (within % segment_blocks).cast("int")).drop("_i")
    rows.write.partitionBy("segment").parquet(f"{path}/blocks")
    written = _blocks(spark, path)
    postings = written.select("segment", "at", "text").sortWithinPartitions("segment", "at").mapInArrow(_postings, _POSTINGS)
    postings = postings.withColumn("bucket", F.pmod("gram", F.lit(buckets)).cast("int"))
    postings.repartitionByRange("bucket", "gram", "segment").sortWithinPartitions("bucket", "gram", "segment").write.partitionBy("bucket").parquet(f"{path}/postings")
    written.groupBy("segment", "file").agg(F.count("*").alias("n_blocks")).write.parquet(f"{path}/files")
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{path}/about")


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/blocks").withColumn("segment", F.col("segment").cast("long"))


def postings(spark: SparkSession, path: str, grams: list[int]) -> DataFrame:
    """Postings of some trigrams: reads their buckets only, and there the row groups that may have them."""
    buckets = spark.read.parquet(f"{path}/about").first().buckets
    known = spark.read.schema(f"{_POSTINGS}, bucket int").parquet(f"{path}/postings")
    return known.where(F.col("bucket").isin(sorted({g % buckets for g in grams}))).where(F.col("gram").isin(grams)).drop("bucket")


def candidates(spark: SparkSession, path: str, words: list[str], rarest: int = RAREST) -> DataFrame | None:
    """(segment, at) of blocks that have the rarest trigrams of any word; None if no block can have one.

    Frequencies of the words' trigrams come to the driver, a number each; lists of blocks are intersected segment by segment.
    """
    grams = {w: word_grams(w) for w in words}
    every = sorted({g for gs in grams.values() for g in gs})
    often = {r.gram: r.n for r in postings(spark, path, every).groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    chosen = [sorted(gs, key=often.get)[:rarest] for gs in grams.values() if all(g in often for g in gs)]
    if not chosen:
        return None

    def intersect(rows: pa.Table) -> pa.Table:
        lists: dict[int, list[np.ndarray]] = {}
        for gram, gaps in zip(rows.column("gram").to_pylist(), rows.column("gaps").to_pylist(), strict=True):
            lists.setdefault(gram, []).append(np.cumsum(np.frombuffer(gaps, dtype="<u2"), dtype=np.int64))
        whole = {g: np.concatenate(x) for g, x in lists.items()}
        none, found = np.empty(0, np.int64), []
        for gs in chosen:
            at = whole.get(gs[0], none)
            for g in gs[1:]:
                at = np.intersect1d(at, whole.get(g, none))
            found.append(at)
        at = np.unique(np.concatenate(found))
        return pa.table({"segment": pa.array(np.full(len(at), rows.column("segment")[0].as_py(), np.int64)), "at": pa.array(at.astype(np.int32))})

    wanted = postings(spark, path, sorted({g for gs in chosen for g in gs}))
    return wanted.select("segment", "gram", "gaps").groupBy("segment").applyInArrow(intersect, "segment long, at int")


def locate(spark: SparkSession, path: str, query: str, limit: int = plain.MOST_RESULTS) -> DataFrame:
    """What ``locate.locate`` finds in the indexed blocks, from candidates only.

    A query with a word of one or two characters scans all blocks, as these words have no trigram.  Segments without a candidate are not
    read, unless more than ``MOST_NAMED`` have some.
    """
    words, blocks = keywords(query), _blocks(spark, path)
    if any(len(w) < 3 for w in words):
        return plain.locate(blocks, query, limit)
    found = candidates(spark, path, words) if words else None
    if found is None:
        return plain.locate(blocks.where("false"), query, limit)
    touched = found.groupBy("segment").agg(F.count("*").alias("n")).limit(MOST_NAMED + 1).collect()
    if len(touched) <= MOST_NAMED:
        blocks = blocks.where(F.col("segment").isin([r.segment for r in touched]))
        if sum(r.n for r in touched) <= MOST_BROADCAST:
            found = F.broadcast(found)
    return plain.locate(blocks.join(found, ["segment", "at"], "left_semi"), query, limit)


def segment_bounds(spark: SparkSession, path: str, words: list[str]) -> DataFrame:
    """(segment, bound): no block of the segment has a higher score; segments without any of the words are left out.

    A word occurs in a block no more often than each of its trigrams does.
    """
    grams = [(w, g, len(gs)) for w in words for gs in [word_grams(w)] for g in gs]
    of = F.broadcast(spark.createDataFrame(grams, "word string, gram long, n_grams int"))  # of the query
    most = postings(spark, path, sorted({g for _, g, _ in grams})).groupBy("segment", "gram").agg(F.max("most").alias("most"))
    per = most.join(of, "gram").groupBy("segment", "word", "n_grams").agg(F.count("*").alias("n"), F.min("most").alias("most"))
    return per.where("n = n_grams").groupBy("segment").agg(F.sum(F.col("most").cast("long")).alias("bound"))


#: Segments that are read first, and most at a time; each time twice as many.
FIRST_WAVE, MOST_WAVE = 4, 2048


def locate_top(spark: SparkSession, path: str, query: str, limit: int = plain.MOST_RESULTS, first_wave: int = FIRST_WAVE, report: dict[str, int] | None = None) -> DataFrame:
    """What ``locate.locate`` finds, reading segments by falling bound and stopping as soon as none that is left can change the result.

    A segment is left unread if its bound is below the best block of each file it has, and below the last row of a full result; or, if the result is full of files' best blocks, below the last of them.
    At most twice ``limit`` rows are kept between reads, so the result is made of rows on the driver.  ``report`` gets the
    numbers of segments with hits (n_segments) and of those that were read (n_read).  Words without trigrams: as in ``locate``.
    """
    words, blocks = keywords(query), _blocks(spark, path)
    if not words or any(len(w) < 3 for w in words):
        return plain.locate(blocks, query, limit)
    todo = segment_bounds(spark, path, words).join(spark.read.parquet(f"{path}/files").select("segment", "file"), "segment").persist()
    try:
        kept: list[Row] = []
        read, wave, last = 0, first_wave, None
        while True:
            rest = todo if last is None else todo.where((F.col("bound") < last[0]) | ((F.col("bound") == last[0]) & (F.col("segment") > last[1])))
            chosen = _open_segments(rest, kept, limit).groupBy("segment").agg(F.max("bound").alias("bound")).orderBy(F.desc("bound"), "segment").limit(wave).collect()
            if not chosen:
                break
            hits = plain.locate(blocks.where(F.col("segment").isin([r.segment for r in chosen])), query, limit)
            kept = _merged(kept + hits.collect(), limit)
            read, wave, last = read + len(chosen), min(2 * wave, MOST_WAVE), (chosen[-1].bound, chosen[-1].segment)
        if report is not None:
            report.update(n_segments=todo.select("segment").distinct().count(), n_read=read)
    finally:
        todo.unpersist()
    return spark.createDataFrame(kept, plain.locate(blocks, query, limit).schema)


def _open_segments(todo: DataFrame, kept: list[Row], limit: int) -> DataFrame:
    """Rows (segment, file, bound) that may still change a result of so many rows; equal scores may, by their places."""
    if len(kept) < limit:
        return todo
    enter = F.col("bound") >= kept[-1].score
    if kept[-1].rank_in_file == 1:  # full of files' best blocks
        return todo.where(enter)
    best = [(r.file, r.score) for r in kept if r.rank_in_file == 1]
    known = F.broadcast(todo.sparkSession.createDataFrame(best, "file string, best long"))  # ``limit`` rows at most
    return todo.join(known, "file", "left").where(enter | F.col("best").isNull() | (F.col("bound") >= F.col("best")))


def _merged(rows: list[Row], limit: int) -> list[Row]:
    """The first ``limit`` rows of results of different blocks, ranked anew: a row of the whole result is in that of its own blocks."""
    place = lambda r: tuple(r[c] for c in ("file_ord", "block_ord") if c in r)
    seen: dict[str, int] = {}
    ranked = []
    for r in sorted(rows, key=lambda r: (-r.score, place(r))):
        seen[r.file] = seen.get(r.file, 0) + 1
        ranked.append(Row(**{**r.asDict(), "rank_in_file": seen[r.file]}))
    return sorted(ranked, key=lambda r: (r.rank_in_file > 1, -r.score, place(r)))[:limit]
