"""Documents as a data source of Spark, in batch and as a stream of a folder's versions.

``spark.read.format("documents")`` gives raw paragraphs and pages of a folder's files.  Files are dealt to partitions by their bytes; filters on the listing (path,
suffix, length, modificationTime) are applied before any file is opened, and each file is opened where its partition is read, as a stream.

``spark.readStream.format("document_changes")`` gives what happens to a folder: new, changed and deleted files.  Its offsets number snapshots of the
listing, (path, time of change, length), which lie beside the checkpoint; a batch is the difference of two of them, so it is the same when it is repeated after a
failure.
"""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import datasource as api

from .files import SUPPORTED, DocConverter, PdfReader, docx_paragraphs
from .shared import FileOpener, open_file, opened_folder

#: Bytes of files that a partition has at least, unless it is the last one.
PARTITION_BYTES = 64 << 20
UTC = datetime.timezone.utc


@dataclass(frozen=True)
class Found:
    """A file of a listing; ``modified`` in milliseconds, as Spark's own listing has it."""

    path: str
    modified: int
    length: int

    @property
    def suffix(self) -> str:
        name = self.path.rsplit("/", 1)[-1]
        return "." + name.rsplit(".", 1)[1].lower() if "." in name else ""

    @property
    def time(self) -> datetime.datetime:
        return datetime.datetime.fromtimestamp(self.modified / 1000, UTC)


def list_files(folder: str) -> list[Found]:
    """Supported files of a folder and its subfolders by path, with paths as Spark writes them; names that begin with ``_`` or ``.`` are skipped."""
    from pyarrow import fs

    local = folder.startswith("file:") or "://" not in folder
    store, base = opened_folder(folder)
    head = "file:" if local else folder.split("://", 1)[0] + "://"
    if store.get_file_info(base).type != fs.FileType.Directory:
        raise NotADirectoryError(folder)
    out = []
    for info in store.get_file_info(fs.FileSelector(base, recursive=True)):
        inside = info.path[len(base.rstrip("/")) :].strip("/").split("/")
        if info.is_file and info.path.lower().endswith(SUPPORTED) and not any(x[0] in "_." for x in inside):
            out.append(Found(head + info.path, info.mtime_ns // 1_000_000, info.size))
    return sorted(out, key=lambda f: f.path)


@dataclass
class FilePartition(api.InputPartition):
    files: tuple[Found, ...]


def by_bytes(files: list[Found], most: int = PARTITION_BYTES) -> list[FilePartition]:
    """Files in runs of about so many bytes; a larger file has a run of its own."""
    out: list[list[Found]] = []
    size = most
    for f in sorted(files, key=lambda f: -f.length):
        if size + f.length > most:
            out.append([])
            size = 0
        out[-1].append(f)
        size += f.length
    return [FilePartition(tuple(x)) for x in out]


DOCUMENTS = "path string, modificationTime timestamp, length long, suffix string, idx int, text string, style string, producer string, n_images int, has_text_block boolean, error string"
_LISTING: dict[str, Callable[[Found], Any]] = {"path": lambda f: f.path, "suffix": lambda f: f.suffix, "length": lambda f: f.length, "modificationTime": lambda f: f.time}
_TESTS: dict[type, Callable[[Any, Any], bool]] = {
    api.EqualTo: lambda a, b: a == b,
    api.EqualNullSafe: lambda a, b: a == b,
    api.In: lambda a, b: a in b,
    api.GreaterThan: lambda a, b: a > b,
    api.GreaterThanOrEqual: lambda a, b: a >= b,
    api.LessThan: lambda a, b: a < b,
    api.LessThanOrEqual: lambda a, b: a <= b,
    api.StringStartsWith: lambda a, b: a.startswith(b),
    api.StringEndsWith: lambda a, b: a.endswith(b),
    api.StringContains: lambda a, b: b in a,
}


def listing_test(f: api.Filter) -> Callable[[Found], bool] | None:
    """A filter as a test of a listed file, or None if it is about something else."""
    if isinstance(f, api.Not):
        inner = listing_test(f.child)
        return None if inner is None else lambda x: not inner(x)
    column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
    if column not in _LISTING:
        return None
    get = _LISTING[column]
    if isinstance(f, api.IsNotNull):
        return lambda x: True
    if isinstance(f, api.IsNull):
        return lambda x: False
    if type(f) not in _TESTS:
        return None
    same, value = _TESTS[type(f)], getattr(f, "value", None)
    if isinstance(value, datetime.datetime) and value.tzinfo is None:
        value = value.astimezone(UTC)
    return lambda x: same(get(x), f.value if value is None else value)


def documents_source(pdf_reader: PdfReader | None = None, convert: DocConverter | None = None, opener: FileOpener = open_file) -> type[api.DataSource]:
    """The source ``documents``, with the caller's readers; ``register`` it with a session."""

    class Reader(api.DataSourceReader):
        def __init__(self, options: dict[str, str]):
            self.folder = options["path"]
            self.bytes = int(options.get("partitionBytes", PARTITION_BYTES))
            self.tests: list[Callable[[Found], bool]] = []

        def pushFilters(self, filters: list[api.Filter]) -> Iterator[api.Filter]:
            for f in filters:
                test = listing_test(f)
                if test is None:
                    yield f  # Spark's to apply
                else:
                    self.tests.append(test)

        def partitions(self) -> list[FilePartition]:
            return by_bytes([f for f in list_files(self.folder) if all(t(f) for t in self.tests)], self.bytes) or [FilePartition(())]

        def read(self, partition: FilePartition) -> Iterator[tuple]:
            for f in partition.files:
                head = (f.path, f.time, f.length, f.suffix)
                try:
                    rows = self.rows(f)
                except Exception as e:  # a file's error is a row
                    rows = [(None,) * 6 + (f"{type(e).__name__}: {e}",)]
                for r in rows:
                    yield (*head, *r)

        def rows(self, f: Found) -> list[tuple]:
            if f.suffix == ".pdf":
                if pdf_reader is None:
                    raise LookupError("no reader for .pdf files")
                with opener(f.path) as file:
                    producer, pages = pdf_reader(f.path, file.read())
                return [(i, t, None, producer, n, b, None) for i, (t, n, b) in enumerate(pages)]
            with opener(f.path) as file:
                try:
                    found = docx_paragraphs(file)
                except Exception:
                    if f.suffix != ".doc":
                        raise
                    file.seek(0)
                    other = convert(file.read()) if convert else None
                    if other is None:
                        raise LookupError("no converter for .doc files") from None
                    found = docx_paragraphs(other)
            return [(i, t, s, None, None, None, None) for i, (t, s) in enumerate(found)]

    class Documents(api.DataSource):
        @classmethod
        def name(cls) -> str:
            return "documents"

        def schema(self) -> str:
            return DOCUMENTS

        def reader(self, schema) -> api.DataSourceReader:
            return Reader(self.options)

    return Documents


def register(spark: SparkSession, pdf_reader: PdfReader | None = None, convert: DocConverter | None = None, opener: FileOpener = open_file) -> None:
    """Makes ``documents`` and ``document_changes`` known to a session, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(documents_source(pdf_reader, convert, opener))
    spark.dataSource.register(DocumentChanges)


# --- versions of a folder ---

CHANGES = "change string, path string, modificationTime timestamp, length long, suffix string, previous timestamp"


@dataclass
class ChangePartition(api.InputPartition):
    rows: tuple[tuple[str, Found, int | None], ...]


def differences(old: list[Found], new: list[Found]) -> list[tuple[str, Found, int | None]]:
    """(change, file, time of the version before) between two listings."""
    before = {f.path: f for f in old}
    now = {f.path for f in new}
    out = [("new" if f.path not in before else "changed", f, before[f.path].modified if f.path in before else None) for f in new if before.get(f.path) != f]
    return out + [("deleted", f, f.modified) for f in old if f.path not in now]


class DocumentChanges(api.DataSource):
    """Options: path, the folder; snapshots, a folder for the listings that offsets mean, kept as long as the checkpoint."""

    @classmethod
    def name(cls) -> str:
        return "document_changes"

    def schema(self) -> str:
        return CHANGES

    def streamReader(self, schema) -> api.DataSourceStreamReader:
        return ChangeReader(self.options["path"], self.options["snapshots"])


class ChangeReader(api.DataSourceStreamReader):
    """Offsets are the names of snapshots; the first one, empty, has none."""

    def __init__(self, folder: str, snapshots: str):
        self.folder, self.snapshots = folder, snapshots

    def _store(self):
        return opened_folder(self.snapshots)

    def _load(self, name: str) -> list[Found]:
        if not name:
            return []
        store, base = self._store()
        with store.open_input_stream(f"{base}/{name}.json") as f:
            return [Found(*json.loads(line)) for line in f.read().splitlines()]

    def initialOffset(self) -> dict:
        return {"snapshot": ""}

    def latestOffset(self) -> dict:
        """The snapshot that the folder is in: the last one if nothing has changed since, or a new one, written before its name is given away."""
        store, base = self._store()
        store.create_dir(base, recursive=True)
        now = list_files(self.folder)
        last = getattr(self, "last", "")
        if (last or not now) and self._load(last) == now:
            return {"snapshot": last}
        name = uuid.uuid4().hex
        with store.open_output_stream(f"{base}/{name}.json") as f:
            f.write("\n".join(json.dumps([x.path, x.modified, x.length]) for x in now).encode())
        self.last = name
        return {"snapshot": name}

    def partitions(self, start: dict, end: dict) -> list[ChangePartition]:
        changes = differences(self._load(start["snapshot"]), self._load(end["snapshot"]))
        return [ChangePartition(tuple(changes[k : k + 10_000])) for k in range(0, len(changes), 10_000)]

    def read(self, partition: ChangePartition) -> Iterator[tuple]:
        for change, f, previous in partition.rows:
            yield change, f.path, f.time, f.length, f.suffix, None if previous is None else datetime.datetime.fromtimestamp(previous / 1000, UTC)

    def commit(self, end: dict) -> None:
        """Older snapshots are not read again; the last committed one is what the next batch starts from, and one before it what a repeated batch does."""
        store, base = self._store()
        from pyarrow import fs

        keep = {end["snapshot"], getattr(self, "last", ""), getattr(self, "committed", "")}
        self.committed = end["snapshot"]
        for info in store.get_file_info(fs.FileSelector(base, allow_not_found=True)) if len(keep) == 3 else []:
            if info.base_name.removesuffix(".json") not in keep:
                store.delete_file(info.path)
