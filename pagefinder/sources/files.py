"""Files as raw pages and paragraphs.

``binaryFile`` lists; suffixes are matched after the scan, whatever their case.  It skips names
that begin with ``_`` or ``.``.  A listing without content costs no file's opening: readers then open, in their tasks, the files
that are left by path, as streams.  Content that Spark loads serves files up to ``MOST_BYTES``; larger ones are opened by path as well.
A file that cannot be read gives one row with ``error`` set, and the others go on.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from typing import BinaryIO
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import suffix
from ..schema import RAW_PAGES, RAW_PARAGRAPHS
from .shared import FileOpener, open_file

SUPPORTED = (".pdf", ".docx", ".doc")
#: Files above this are not loaded into a row but opened by path.
MOST_BYTES = 512 * 1024 * 1024
#: Paragraphs of small files go to Spark together, as soon as there are so many rows or characters.
FRAME_ROWS, FRAME_CHARS = 4096, 4_000_000
LISTING = ["path", "modificationTime", "length", "suffix"]
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

#: (path, content) -> (producer, [(text, number of images, has text blocks)]) a page.
PdfReader = Callable[[str, bytes], tuple[str, list[tuple[str, int, bool]]]]
#: The content of a .doc as .docx, or None.
DocConverter = Callable[[bytes], bytes | None]


def scan_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Supported files of a folder and its subfolders; the folder must exist."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not (fs.exists(where) and fs.getFileStatus(where).isDirectory()):
        raise NotADirectoryError(folder)
    return supported(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder))


def scan_paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Supported files of a list; the others are left out."""
    known = [p for p in paths if p.lower().endswith(SUPPORTED)]
    if not known:
        return spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary, suffix string")
    return supported(spark.read.format("binaryFile").load(known))


def supported(files: DataFrame, path: str = "path") -> DataFrame:
    return files.withColumn("suffix", suffix(F.col(path))).where(F.col("suffix").isin(*SUPPORTED))


def listed(files: DataFrame) -> DataFrame:
    """Files without content: Spark reads a content only where a plan needs it."""
    return files.select(*LISTING)


def _handed(files: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(path, suffix, content) of some kinds of files; content is null for those to be opened by path."""
    known = files.where(F.col("suffix").isin(*kinds))
    by_path = known.select("path", "suffix", F.lit(None).cast("binary").alias("content"))
    if "content" not in files.columns:
        return by_path
    small = known.where(F.col("length") <= MOST_BYTES).select("path", "suffix", "content")
    return small.unionByName(known.where(F.col("length") > MOST_BYTES).select("path", "suffix", F.lit(None).cast("binary").alias("content")))


def _paragraph_text(p: ElementTree.Element) -> str:
    """Text of a paragraph's own runs: text boxes have paragraphs of their own, and fallbacks say the same again."""
    out, todo = [], [p]
    while todo:
        x = todo.pop()
        if x.tag == f"{_W}t":
            out.append(x.text or "")
        elif x.tag == f"{_W}tab" and not x.attrib:
            out.append("\t")
        elif x.tag in (f"{_W}br", f"{_W}cr"):
            out.append("\n")
        elif x.tag not in _OWN_TEXT:
            todo.extend(reversed(x))
    return "".join(out)


_OWN_TEXT = (f"{_W}txbxContent", "{http://schemas.openxmlformats.org/markup-compatibility/2006}Fallback")


def docx_paragraphs(content: bytes | BinaryIO) -> list[tuple[str, str]]:
    """(text, style name) of the body's paragraphs; tables, headers, footnotes and text boxes are not read.

    A file is read as a stream: the archive's other parts (images) are never loaded, and paragraphs go as soon as they are read.
    """
    with zipfile.ZipFile(io.BytesIO(content) if isinstance(content, bytes) else content) as z:
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = s.find(f"{_W}name")
                names[s.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else ""
        out, above = [], []
        with z.open("word/document.xml") as xml:
            for event, x in ElementTree.iterparse(xml, ("start", "end")):
                if event == "start":
                    above.append(x)
                    continue
                above.pop()
                if x.tag == f"{_W}p" and above and above[-1].tag == f"{_W}body":
                    style = x.find(f"{_W}pPr/{_W}pStyle")
                    key = style.get(f"{_W}val") if style is not None else ""
                    out.append((_paragraph_text(x), names.get(key, key) or ""))
                if above and above[-1].tag == f"{_W}body":
                    above[-1].remove(x)
    return out


def _in_frames(files: Iterator[list[tuple]]) -> Iterator[pd.DataFrame]:
    """The files' rows (path, para_idx, text, style, error) in frames: making and sending one costs more than reading a small file."""
    out, chars = [], 0

    def frame() -> pd.DataFrame:
        return pd.DataFrame(out, columns=["path", "para_idx", "text", "style", "error"]).astype({"para_idx": "Int32"})

    for rows in files:
        out.extend(rows)
        chars += sum(len(r[2] or "") for r in rows)
        if len(out) >= FRAME_ROWS or chars >= FRAME_CHARS:
            yield frame()
            out, chars = [], 0
    if out:
        yield frame()


def read_paragraphs(files: DataFrame, convert: DocConverter | None = None, opener: FileOpener = open_file) -> DataFrame:
    """Paragraphs of .docx files, and of .doc files that are .docx inside or that ``convert`` turns into it.

    A .doc that is no .docx inside and that ``convert`` gives nothing for, or that there is no ``convert`` for, is an error, so that it is tried again when
    there is one; a conversion that fails is that file's error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _in_frames(rows_of(batches))

    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
        for batch in batches:
            for path, kind, content in zip(batch.path, batch.suffix, batch.content, strict=True):
                rows, error = [], None
                try:
                    if content is not None:
                        rows = docx_paragraphs(content)
                    else:
                        with opener(path) as file:
                            rows = docx_paragraphs(file)
                except Exception as e:  # any damage of one file is that file's error
                    error = f"{type(e).__name__}: {e}"
                    if kind == ".doc":
                        rows, error = converted(path, content)
                yield [(path, i, t, s, None) for i, (t, s) in enumerate(rows)] + ([(path, None, None, None, error)] if error else [])

    def converted(path: str, content: bytes | None) -> tuple[list[tuple[str, str]], str | None]:
        try:
            if convert is None:
                return [], "no converter for .doc files"
            if content is None:
                with opener(path) as file:
                    content = file.read()
            other = convert(content)
            return ([], "no converter for .doc files") if other is None else (docx_paragraphs(other), None)
        except Exception as e:  # nor does a damaged or failed conversion stop the others
            return [], f"{type(e).__name__}: {e}"

    return _handed(files, (".docx", ".doc")).mapInPandas(run, RAW_PARAGRAPHS)


def read_pages(files: DataFrame, reader: PdfReader | None, opener: FileOpener = open_file) -> DataFrame:
    """Raw pages of .pdf files by a reader that the caller brings; rules apply to them as columns later.

    Without a reader every PDF is an error, so that it is read when there is one.
    """
    if reader is None:
        missing = files.where(F.col("suffix") == ".pdf").select("path", F.lit("no reader for .pdf files").alias("error"))
        none = files.sparkSession.createDataFrame([], RAW_PAGES)
        return none.unionByName(missing, allowMissingColumns=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch.path, batch.content, strict=True):
                try:
                    if content is None:
                        with opener(path) as file:
                            content = file.read()
                    producer, pages = reader(path, content)
                    out = [(path, producer, i, t, n, b, None) for i, (t, n, b) in enumerate(pages)]
                except Exception as e:
                    out = [(path, None, None, None, None, None, f"{type(e).__name__}: {e}")]
                frame = pd.DataFrame(out, columns=["path", "producer", "page_idx", "raw_text", "n_images", "has_text_block", "error"])
                yield frame.astype({"page_idx": "Int32", "n_images": "Int32", "has_text_block": "boolean"})

    return _handed(files, (".pdf",)).mapInPandas(run, RAW_PAGES)
