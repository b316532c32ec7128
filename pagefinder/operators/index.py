"""An index from files: cached blocks where nothing changed, read ones otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..schema import NO_CHAPTER
from ..sources import files as source
from ..sources.shared import FileOpener, exists, open_file, tidy, written
from . import blocks as rules
from . import content
from .cache import cache_key, hits, misses
from .cache import keys as cache_keys
from .cache import load as cache_load
from .cache import store as cache_store
from .ocr import OcrEngine, PdfOpener, recognise
from .runs import ROWS

_NO_BLOCK = -1


def file_order(files: DataFrame) -> DataFrame:
    """(path, file_ord): numbers that grow with the path, with gaps; no task sees more than its range of paths."""
    names = files.select("path").distinct()
    return names.repartitionByRange("path").sortWithinPartitions("path").select("path", F.monotonically_increasing_id().alias("file_ord"))


def refresh(files: DataFrame, cached: DataFrame, pdf_reader: source.PdfReader | None = None, convert: source.DocConverter | None = None, ocr: OcrEngine | None = None, opener: PdfOpener | None = None, open_file: FileOpener = open_file) -> DataFrame:
    """The whole index of ``files``: cached blocks of files that have not changed, and fresh ones of the others.

    Blocks of files that are gone, or of earlier versions, are left out; ``cached`` is what ``cache.load`` gives.  Only the listing is compared; files to be read are opened by
    path, so one that has not changed is never opened.  ``update`` does the same for a store, and writes only what is new.
    """
    keyed = _keyed(files)
    kept = cached.join(hits(keyed.select("cache_key"), cached), "cache_key", "left_semi").drop("file_ord")
    fresh = build(files, pdf_reader, convert, ocr, cached, opener, open_file=open_file).drop("file_ord")
    return kept.unionByName(fresh, allowMissingColumns=True).join(file_order(files), "path")


def update(files: DataFrame, store: str, pdf_reader: source.PdfReader | None = None, convert: source.DocConverter | None = None, ocr: OcrEngine | None = None, opener: PdfOpener | None = None, seen: Observation | None = None, open_file: FileOpener = open_file, by_content: bool = False) -> DataFrame:
    """Brings the store up to ``files`` and gives their index, with file_ord.

    Reads keys of the store, opens what is missing there, and appends just that; files that are gone drop out of the index, and out of the store with
    ``cache.compact``.  ``seen`` counts what was opened.  A first run is the case of an empty store.  ``by_content``: files that were moved or sent again are known by
    their digests, and take over stored blocks instead of being read (``content``).
    """
    spark = files.sparkSession
    stored = cache_keys(spark, store) if exists(spark, f"{store}/keys") else None
    with tidy(spark):
        if not by_content:
            cache_store(build(files, pdf_reader, convert, ocr, stored, opener, seen, open_file).drop("file_ord"), store)
        else:
            todo = written(_keyed(files) if stored is None else misses(_keyed(files), stored), "todo")
            digests, same = content.known(spark, store), None
            if digests is not None:
                whole = digests.join(stored.where("n_errors = 0").select("cache_key"), "cache_key", "left_semi")
                same = written(content.same_as_stored(todo, whole, open_file), "same")
                todo = todo.join(same.select("cache_key"), "cache_key", "left_anti")
            fresh = build(todo.select(*source.LISTING), pdf_reader, convert, ocr, None, opener, seen, open_file).drop("file_ord")
            if same is not None:
                fresh = fresh.unionByName(content.copies(cache_load(spark, store), same), allowMissingColumns=True)
                content.remember(same, store, open_file)
            cache_store(fresh, store)
            content.remember(todo, store, open_file)
    now = cache_load(spark, store)
    mine = _keyed(files).select("cache_key", "path").join(file_order(files), "path").drop("path")
    return now.join(mine, "cache_key")


def _keyed(files: DataFrame) -> DataFrame:
    """The listing, without content, under cache keys."""
    return source.listed(files).withColumn("cache_key", cache_key(F.col("path"), F.col("modificationTime")))


def build(files: DataFrame, pdf_reader: source.PdfReader | None = None, convert: source.DocConverter | None = None, ocr: OcrEngine | None = None, cached: DataFrame | None = None, opener: PdfOpener | None = None, seen: Observation | None = None, open_file: FileOpener = open_file) -> DataFrame:
    """Blocks of files (of ``sources.files``) that ``cached`` doesn't hold, with cache_key, modified and file_ord.

    ``cached``: blocks or keys of a store.  With it the files to be read are found in the listing and opened by path; without it Spark loads the contents as it lists.
    A file that can't be read, or that there is no reader or converter for, is one block without text whose ocr_error says why; it
    is read again next time.  A file that was read and has no blocks is one row without text whose block_ord is -1, so that
    the cache knows it; ``blocks_of`` leaves those out.  ``seen`` counts files, blocks and errors as they are made,
    for progress reports.  What was read is written to the shared folder before it goes on, so that files are read once, and files of any
    length are shared by tasks after that.
    """
    keyed = _keyed(files)
    if cached is None:
        todo, keys = files, keyed
    else:
        todo = keys = misses(keyed, cached)
    paragraphs = written(source.read_paragraphs(todo, convert, open_file), "paragraphs")
    pages = written(source.read_pages(todo, pdf_reader, open_file), "pages")
    out = rules.section_blocks(paragraphs, ROWS).unionByName(rules.page_blocks(pages, ROWS))
    out = recognise(out, ocr, opener) if ocr is not None or opener is not None else out.withColumn("ocr_conf", F.lit(None).cast("double"))
    none = {"file": rules.base_name(F.col("path")), "chapter": F.lit(NO_CHAPTER), "text": F.lit(""), "scanned": F.lit(False), "block_ord": F.lit(_NO_BLOCK)}
    keys = keys.select("path", "cache_key", F.col("modificationTime").alias("modified"))
    out = keys.join(out, "path", "left").withColumns({c: F.coalesce(F.col(c), v) for c, v in none.items()})
    if seen is not None:
        out = out.observe(seen, F.approx_count_distinct("path").alias("n_files"), F.count_if(F.col("block_ord") != _NO_BLOCK).alias("n_blocks"), F.count("ocr_error").alias("n_errors"))
    return out.join(file_order(files), "path")


def blocks_of(index: DataFrame) -> DataFrame:
    """An index without the rows of files that have no blocks."""
    return index.where(F.col("block_ord") != _NO_BLOCK)
