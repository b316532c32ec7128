"""Raw pages and paragraphs to blocks: page classes, chapters carried forward, sections folded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import base_name, detect_chapter, is_garbled, strip
from ..schema import NO_CHAPTER, OCR_DPI
from . import runs

# Fixed values.
SCANNERS = ("scan", "twain", "wia", "naps2", "iris", "abbyy", "scansnap", "canoscan", "epson scan", "hp scan")
SAMPLE_PAGES, SAMPLE_TEXT = 3, 50
LEAST_TEXT, LEAST_TEXT_BESIDE_IMAGES = 10, 400


def pdf_classes(pages: DataFrame, path: str = "path") -> DataFrame:
    """(path, pdf_class): scanned, digital or mixed, by the producer and the first three pages."""
    return pages.groupBy(path).agg(*(c.alias(k) for k, c in _flags().items())).select(path, _kind().alias("pdf_class"))


def _flags() -> dict[str, Column]:
    """What a file's class depends on, as aggregates over its pages."""
    early = F.col("page_idx") < SAMPLE_PAGES
    return {
        "_producer": F.max(F.lower(F.coalesce("producer", F.lit("")))),
        "_has_text": F.bool_or(early & (F.length(strip(F.coalesce("raw_text", F.lit("")))) >= SAMPLE_TEXT)),
        "_has_images": F.bool_or(early & (F.col("n_images") > 0)),
    }


def _kind() -> Column:
    scanner = F.lit(False)
    for s in SCANNERS:
        scanner = scanner | F.contains("_producer", F.lit(s))
    text, images = (F.coalesce(c, F.lit(False)) for c in ("_has_text", "_has_images"))
    return F.when(scanner | (images & ~text), "scanned").when(images & text, "mixed").otherwise("digital")


def is_scanned_page(text: Column, has_text_block: Column) -> Column:
    """For a page of a mixed file, on its stripped text."""
    n = F.length(text)
    return (n < LEAST_TEXT) | ((n < LEAST_TEXT_BESIDE_IMAGES) & ~has_text_block) | is_garbled(text)


def carry_chapter(pages: DataFrame, path: str = "path", order: str = "page_idx", rows: int | None = None) -> DataFrame:
    """Adds ``chapter``: the last heading of a text page up to here; pages to be scanned don't set it.

    A file's pages are in one task; with ``rows``, so many of them, and a file of any length is shared by tasks (``runs``).
    """
    carried = pages.withColumn("_own_chapter", F.when(~F.col("scanned"), detect_chapter(F.col("text"))))
    if rows is not None:
        out = runs.carry_last(carried, path, order, "_own_chapter", "chapter", rows)
    else:
        so_far = Window.partitionBy(path).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        out = carried.withColumn("chapter", F.last("_own_chapter", ignorenulls=True).over(so_far))
    return out.withColumn("chapter", F.coalesce("chapter", F.lit(NO_CHAPTER))).drop("_own_chapter")


def page_blocks(pages: DataFrame, rows: int | None = None) -> DataFrame:
    """Blocks of raw pages.  A page with text has a text block; a page to be scanned has none and says how to render it.

    A file that could not be read is one block without text or page, with ocr_error.  With ``rows`` no task has more pages of a file than that; ``pages`` should
    be a table then, as it is read several times.
    """
    text = strip(F.coalesce("raw_text", F.lit("")))
    if rows is not None:
        kinds = pdf_classes(pages)
        known = pages.withColumn("page_idx", F.coalesce("page_idx", F.lit(0))).withColumn("_no_page", F.col("error").isNotNull()).join(kinds, "path").withColumn("text", text)
    else:
        # classes by windows, not by a join with an aggregate: the reader runs once, and one shuffle serves classes and chapters
        file = Window.partitionBy("path")
        known = pages.withColumns({k: c.over(file) for k, c in _flags().items()}).withColumn("pdf_class", _kind()).withColumn("text", text).withColumn("_no_page", F.lit(False))
    scanned = F.when(F.col("error").isNotNull(), False).when(F.col("pdf_class") == "scanned", True).when(F.col("pdf_class") == "digital", False).otherwise(is_scanned_page(F.col("text"), F.coalesce("has_text_block", F.lit(False))))
    known = carry_chapter(known.withColumn("scanned", scanned), rows=rows).withColumn("page_idx", F.when(~F.col("_no_page"), F.col("page_idx")))
    info = F.when(F.col("scanned"), F.struct(F.col("path").alias("pdf_path"), "page_idx", F.lit(OCR_DPI).alias("dpi")))
    return known.select(base_name(F.col("path")).alias("file"), "path", (F.col("page_idx") + 1).alias("page"), "chapter", F.when(F.col("scanned"), "").otherwise(F.col("text")).alias("text"), "scanned", info.alias("render_info"), F.col("error").alias("ocr_error"), F.coalesce("page_idx", F.lit(0)).cast("long").alias("block_ord"))


def fold_sections(paragraphs: DataFrame, path: str = "path", rows: int | None = None) -> DataFrame:
    """(path, section, chapter, text): a heading opens a section and is its first line; blank paragraphs go.

    With ``rows``, a file's paragraphs are numbered and joined so many at a time, and a section is put together of such parts.
    """
    return _fold(paragraphs.withColumn("error", F.lit(None).cast("string")), path, rows).drop("error")


def _fold(paragraphs: DataFrame, path: str, rows: int | None = None) -> DataFrame:
    """``fold_sections``, with the ``error`` of files that have nothing else."""
    text = strip(F.coalesce("text", F.lit("")))
    some = paragraphs.withColumn("text", text).where("text <> '' or error is not null")
    heading = F.coalesce(F.lower(F.coalesce("style", F.lit(""))).startswith("heading"), F.lit(False)) | detect_chapter(F.col("text")).isNotNull()
    some = some.withColumn("_h", heading).withColumn("para_idx", F.coalesce("para_idx", F.lit(0)))
    if rows is not None:
        some = runs.count_up_to(some.withColumn("_n", F.col("_h").cast("int")), path, "para_idx", "_n", "section", rows)
    else:
        some = some.withColumn("section", F.sum(F.col("_h").cast("int")).over(Window.partitionBy(path).orderBy("para_idx"))).withColumn("_run", F.lit(0).cast("long"))
    parts = some.groupBy(path, "section", "_run").agg(F.sort_array(F.collect_list(F.struct("para_idx", "text", "_h"))).alias("_p"), F.max("error").alias("error"))
    parts = parts.select(path, "section", "_run", F.col("_p")[0].alias("_first"), F.array_join(F.transform("_p", lambda x: x["text"]), "\n").alias("text"), "error")
    if rows is not None:
        whole = parts.groupBy(path, "section").agg(F.min(F.struct("_run", "_first")).alias("_f"), F.sort_array(F.collect_list(F.struct("_run", "text"))).alias("_p"), F.max("error").alias("error"))
        parts = whole.select(path, "section", F.col("_f._first").alias("_first"), F.array_join(F.transform("_p", lambda x: x["text"]), "\n").alias("text"), "error")
    first = F.col("_first")
    return parts.select(path, "section", F.when(first["_h"], F.substring(first["text"], 1, 60)).otherwise(NO_CHAPTER).alias("chapter"), "text", "error")


def section_blocks(paragraphs: DataFrame, rows: int | None = None) -> DataFrame:
    """Blocks of paragraphs; a file that could not be read is one block without text, with ocr_error.  ``rows``: as in ``fold_sections``."""
    folded = _fold(paragraphs, "path", rows)
    none = "struct<pdf_path:string,page_idx:int,dpi:int>"
    return folded.select(base_name(F.col("path")).alias("file"), "path", F.lit(None).cast("int").alias("page"), "chapter", "text", F.lit(False).alias("scanned"), F.lit(None).cast(none).alias("render_info"), F.col("error").alias("ocr_error"), F.col("section").cast("long").alias("block_ord"))
