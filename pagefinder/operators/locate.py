"""Locating: blocks scored by keyword occurrences, the best block of every file first.

Blocks are pre-filtered by a cheap ``contains``, cut to their snippet before anything is shuffled,
and limited within each file before the exchange (a row beyond the limit in its own file cannot be
in the result), so what moves is bounded by files, tasks and the limit, not by hits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.keywords import keywords
from ..functions.text import contains_any, score

# Fixed values.
MOST_RESULTS, SNIPPET, REASON = 500, 600, "关键词命中"


def scored(blocks: DataFrame, words: list[str]) -> DataFrame:
    """Blocks with at least one of the words, with ``score``."""
    return blocks.where((F.col("text") != "") & contains_any(F.col("text"), words)).withColumn("score", score(F.col("text"), words))


def _place(rows: DataFrame) -> list[str]:
    """What breaks ties: the order of files, where the index has one, and the place in the file."""
    return [c for c in ("file_ord", "block_ord") if c in rows.columns]


def _ranked(hits: DataFrame, keys: list[str], limit: int) -> DataFrame:
    rank = Window.partitionBy(*keys, "file").orderBy(F.desc("score"), *_place(hits))
    return hits.withColumn("rank_in_file", F.row_number().over(rank)).where(F.col("rank_in_file") <= limit)


def locate(blocks: DataFrame, query: str, limit: int = MOST_RESULTS, seen: Observation | None = None) -> DataFrame:
    """(file, page, page_label, chapter, snippet, reason, score, rank_in_file, block_ord) in order of rank; file_ord too if blocks have it.

    ``report.ranked`` numbers these rows by ``rank_in_file``, score and place.

    A query without keywords finds nothing.  Page is null for blocks without pages; page_label has a dash then.
    ``seen`` counts blocks, scans with and without text, and candidates while the query runs; it keeps the
    filter from the scan, so it is off unless it is given.
    """
    words = keywords(query)
    place = _place(blocks)
    if seen is not None:
        scan, text = F.col("scanned"), F.coalesce(F.col("text") != "", F.lit(False))
        blocks = blocks.observe(seen, F.count("*").alias("n_blocks"), F.count_if(scan & text).alias("n_scanned_with_text"), F.count_if(scan & ~text).alias("n_scanned_no_text"), F.count_if(text & contains_any(F.col("text"), words)).alias("n_candidates"))
    hits = scored(blocks, words).select("file", "page", "chapter", F.substring("text", 1, SNIPPET).alias("snippet"), "score", *place)
    best_first = _ranked(hits, [], limit).orderBy(F.col("rank_in_file") > 1, F.desc("score"), *place).limit(limit)
    return best_first.select("file", F.col("page").cast("string").alias("page"), F.coalesce(F.col("page").cast("string"), F.lit("—")).alias("page_label"), "chapter", "snippet", F.lit(REASON).alias("reason"), "score", "rank_in_file", *place)


def locate_many(blocks: DataFrame, queries: dict[int, str], limit: int = MOST_RESULTS) -> DataFrame:
    """(query_id, result_rank, file, page, score, block_ord) for several queries in one scan of the blocks.

    Each block is scored for all queries as columns of one projection, then kept for those it has hits for.
    """
    place = _place(blocks)
    known = {i: w for i, q in queries.items() if (w := keywords(q))}
    per = F.array(*(F.struct(F.lit(i).alias("query_id"), score(F.col("text"), w).alias("score")) for i, w in known.items())) if known else F.array().cast("array<struct<query_id:int,score:bigint>>")
    every = sorted({w for ws in known.values() for w in ws})
    hits = blocks.where((F.col("text") != "") & contains_any(F.col("text"), every))
    hits = hits.select("file", "page", *place, F.explode(F.filter(per, lambda x: x["score"] > 0)).alias("h")).select("h.*", "file", "page", *place)
    order = Window.partitionBy("query_id").orderBy(F.col("rank_in_file") > 1, F.desc("score"), *place)
    out = _ranked(hits, ["query_id"], limit).withColumn("result_rank", F.row_number().over(order)).where(F.col("result_rank") <= limit)
    return out.select("query_id", "result_rank", "file", "page", "score", *place)
