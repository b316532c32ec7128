"""Summaries of an index and of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .locate import scored


def index_status(blocks: DataFrame) -> DataFrame:
    """One row: blocks, text blocks and files, scanned blocks and files, and how many scans have text."""
    text = ~F.col("scanned") & (F.col("text") != "")
    return blocks.agg(
        F.count("*").alias("n_blocks"),
        F.count_if(text).alias("n_text_blocks"),
        F.count_distinct(F.when(text, F.col("file"))).alias("n_text_files"),
        F.count_if("scanned").alias("n_scanned_blocks"),
        F.count_distinct(F.when(F.col("scanned"), F.col("file"))).alias("n_scanned_files"),
        F.count_if(F.col("scanned") & (F.col("text") != "")).alias("n_ocr_done"),
    )


def scanned_files(blocks: DataFrame) -> DataFrame:
    done = F.count_if(F.col("text") != "").alias("n_ocr_done")
    return blocks.where("scanned").groupBy("file").agg(F.count("*").alias("n_pages"), done).orderBy("file")


def ocr_errors(blocks: DataFrame) -> DataFrame:
    return blocks.where("ocr_error is not null").select("file", "page", "ocr_error")


def file_hits(blocks: DataFrame, words: list[str]) -> DataFrame:
    """(file, n_hits, first_ord): most hits first, ties by first appearance: by the order of files, where blocks have it, then by the place in the file."""
    place = [c for c in ("file_ord", "block_ord") if c in blocks.columns]
    per = scored(blocks, words).groupBy("file").agg(F.sum("score").alias("n_hits"), F.min(F.struct(*place)).alias("first"))
    return per.orderBy(F.desc("n_hits"), "first").select("file", "n_hits", F.col("first.block_ord").alias("first_ord"))


def group_results(results: DataFrame) -> DataFrame:
    """(file, n_hits, pages, first_rank) of ranked results, in order of first appearance."""
    rows = F.sort_array(F.collect_list(F.struct("result_rank", F.coalesce("page", F.lit("—")).alias("page"))))
    out = results.groupBy("file").agg(rows.alias("r"), F.min("result_rank").alias("first_rank"))
    return out.select("file", F.size("r").cast("long").alias("n_hits"), F.array_join(F.transform("r", lambda x: x["page"]), "、").alias("pages"), "first_rank").orderBy("first_rank")


def totals(results: DataFrame) -> DataFrame:
    return results.agg(F.count_distinct("file").alias("n_files"), F.count("*").alias("n_results"))


def with_rank(results: DataFrame, order: list[Column]) -> DataFrame:
    """Adds result_rank to an ordered, limited result."""
    return results.withColumn("result_rank", F.row_number().over(Window.orderBy(*order)))


def ranked(results: DataFrame) -> DataFrame:
    """Adds result_rank to what ``locate`` found, whose rows are limited."""
    place = [F.col(c) for c in ("file_ord", "block_ord") if c in results.columns]
    return with_rank(results, [F.col("rank_in_file") > 1, F.desc("score"), *place])


def kept_status(keys: DataFrame) -> DataFrame:
    """``index_status`` of a store, from the sums that ``cache.store`` made of each file's blocks.

    ``keys``: ``cache.current_keys``, or those of a listing.  A file that was added, changed or deleted is a key more or less; blocks
    of files that have not changed are not read, and a name that several files have counts once, as long as one of them has such blocks.
    """
    some = lambda n: F.count_distinct(F.when(F.col(n) > 0, F.col("file")))
    total = lambda n: F.coalesce(F.sum(n), F.lit(0))
    return keys.agg(
        total("n_blocks").alias("n_blocks"),
        total("n_text_blocks").alias("n_text_blocks"),
        some("n_text_blocks").alias("n_text_files"),
        total("n_scanned_blocks").alias("n_scanned_blocks"),
        some("n_scanned_blocks").alias("n_scanned_files"),
        total("n_ocr_done").alias("n_ocr_done"),
    )


def kept_scanned_files(keys: DataFrame) -> DataFrame:
    """``scanned_files`` of a store, from the same sums."""
    return keys.where("n_scanned_blocks > 0").groupBy("file").agg(F.sum("n_scanned_blocks").alias("n_pages"), F.sum("n_ocr_done").alias("n_ocr_done")).orderBy("file")
