"""OCR of blocks that need it, by an engine the caller brings; the rules around it are columns."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, ExitStack

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import detect_chapter
from ..sources.shared import written

#: (pdf path, page index, dpi) -> [(text, confidence)] a line.
OcrEngine = Callable[[str, int, int], list[tuple[str, float]]]
#: pdf path -> an open file, (page index, dpi) -> [(text, confidence)] a line.
PdfOpener = Callable[[str], AbstractContextManager[Callable[[int, int], list[tuple[str, float]]]]]
#: What a task has to read, in pages of usual cost; a longer file is shared by several tasks.
PAGES_A_TASK = 64
LINES = "array<struct<text:string,conf:double>>"
#: Pages whose texts are held at once, whatever Spark's batches hold.
PAGES_AT_ONCE = 64


def lines_text(lines: Column) -> Column:
    """Lines that are not empty, joined by newlines."""
    return F.array_join(F.transform(F.filter(lines, lambda x: x["text"] != ""), lambda x: x["text"]), "\n")


def lines_confidence(lines: Column) -> Column:
    """Mean confidence of lines that are not empty; 1 if there is none."""
    kept = F.filter(lines, lambda x: x["text"] != "")
    total = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x["conf"])
    return F.when(F.size(kept) > 0, total / F.size(kept)).otherwise(F.lit(1.0))


def override_chapter(chapter: Column, ocr_text: Column) -> Column:
    """A heading that OCR found names its own page only."""
    return F.coalesce(detect_chapter(ocr_text), chapter)


def _by_file(opener: PdfOpener, files: ExitStack) -> OcrEngine:
    """An engine that keeps the file of the page before open, and what went wrong with it."""
    now: dict[str, object] = {"path": None}

    def read(path: str, page_idx: int, dpi: int) -> list[tuple[str, float]]:
        if path != now["path"]:
            files.close()
            now.update(path=path, page=None, error=None)
            try:
                now["page"] = files.enter_context(opener(path))
            except Exception as e:
                now["error"] = e
        if now["error"] is not None:
            raise now["error"]
        return now["page"](page_idx, dpi)

    return read


def in_shares(pages: DataFrame, order: list[str], cost: Column, share: float = PAGES_A_TASK) -> DataFrame:
    """Rows in partitions of about ``share`` cost each, every one a run of the order.

    Rows are ranged and written, which fixes their places; costs are summed by range and within each range, so a row's place in the whole sum is known without a
    task that sees all; and that says which partition it belongs to.  A partition is over its share by one row's cost at most.
    """
    ranged = pages.withColumn("_cost", cost.cast("double")).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = written(ranged.withColumn("_i", F.monotonically_increasing_id()), "pages-in-order").withColumn("_p", F.shiftright("_i", 33))
    sums = ranged.groupBy("_p").agg(F.sum("_cost").alias("_sum"))
    total = sums.agg(F.sum("_sum")).first()[0] or 0.0
    before = sums.select("_p", F.coalesce(F.sum("_sum").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_before"))
    within = Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    done = F.col("_before") + F.coalesce(F.sum("_cost").over(within), F.lit(0.0))
    tasks = max(1, math.ceil(total / share))
    task = F.least(F.floor(done * tasks / (total or 1.0)), F.lit(tasks - 1)).cast("int")
    dealt = ranged.join(F.broadcast(before), "_p").withColumn("_task", task)  # a row a range
    return dealt.repartitionById(tasks, "_task").sortWithinPartitions(*order).select(*pages.columns)


def page_by_page(batches: Iterator[pa.RecordBatch], read: OcrEngine) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``PAGES_AT_ONCE`` pages with ``ocr_error`` set and ``_lines`` added."""
    for whole in batches:
        for at in range(0, whole.num_rows, PAGES_AT_ONCE):
            batch = whole.slice(at, PAGES_AT_ONCE)
            found, errors = [], []
            for info in batch.column("render_info").to_pylist():
                try:
                    lines = read(info["pdf_path"], int(info["page_idx"]), int(info["dpi"]))
                    found.append([{"text": t, "conf": float(c)} for t, c in lines])
                    errors.append(None)
                except Exception as e:
                    found.append([])
                    errors.append(f"{type(e).__name__}: {e}")
            place = batch.schema.get_field_index("ocr_error")
            text = batch.schema.field(place).type
            columns = [*batch.columns, pa.array(found, pa.list_(pa.struct([("text", text), ("conf", pa.float64())])))]
            columns[place] = pa.array(errors, text)
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "_lines"])


def recognise(blocks: DataFrame, engine: OcrEngine | None = None, opener: PdfOpener | None = None, cost: Column | None = None) -> DataFrame:
    """Fills text, chapter, ocr_conf and ocr_error of scanned blocks without text; ``scanned`` stays.

    Only these blocks go through Python, one page at a time, so an image is all that a task holds; an engine's error is
    that page's.  Other blocks keep all their columns, ocr_conf included, and no text of theirs leaves Spark.  ``blocks`` is read for either kind, so what is dear to
    make should be written first (``index.build`` does).  With an ``opener``, pages are put in order of
    file and page and cut into runs of about equal ``cost`` (of a block; default 1), ``PAGES_A_TASK`` each, so that neither a large file nor a dear one is one task's; a
    file is opened once a run, and one that won't open is the error of its pages.
    """
    if (engine is None) == (opener is None):
        raise ValueError("give an engine or an opener")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ExitStack() as files:
            yield from page_by_page(batches, engine or _by_file(opener, files))

    need = F.coalesce(F.col("scanned") & (F.col("text") == ""), F.lit(False))
    if "ocr_conf" not in blocks.columns:
        blocks = blocks.withColumn("ocr_conf", F.lit(None).cast("double"))
    todo = blocks.where(need)
    if opener is not None:
        keyed = todo.withColumns({"_path": F.col("render_info.pdf_path"), "_page": F.col("render_info.page_idx")})
        todo = in_shares(keyed, ["_path", "_page"], F.lit(1) if cost is None else cost).drop("_path", "_page")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in todo.schema.fields)
    done = todo.mapInArrow(run, f"{schema}, _lines {LINES}")
    done = done.withColumn("text", lines_text(F.col("_lines"))).withColumn("chapter", override_chapter(F.col("chapter"), F.col("text")))
    done = done.withColumn("ocr_conf", F.when(F.col("ocr_error").isNull(), lines_confidence(F.col("_lines")))).drop("_lines")
    return blocks.where(~need).unionByName(done)
