"""Documents as a data source, and a folder's versions as a stream."""

import os
import zipfile

import pytest

from pagefinder.operators import cache, index, report
from pagefinder.sources import documents
from pagefinder.sources import files as source
from pagefinder.streaming.watch import follow

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(path, *paragraphs):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')


def counting(log):
    def opener(path):  # local, so that workers need not import this file
        with open(log, "a") as f:
            f.write(path.rsplit("/", 1)[1] + "\n")
        return open(path.removeprefix("file:"), "rb")

    return opener


def make_reader():
    def reader(path, content):
        return "w", [(t, 0, True) for t in content.decode().split("|")]

    return reader


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    for k in range(6):
        docx(tmp_path / f"in/sub/d{k}.docx", f"one {k}", "two " * (k + 1))
    (tmp_path / "in/P.PDF").write_bytes(b"first page|second page")
    (tmp_path / "in/old.doc").write_bytes(b"no zip")
    (tmp_path / "in/_skip.docx").write_bytes(b"x")
    (tmp_path / "in/note.txt").write_text("x")
    return tmp_path


def test_batch(spark, folder):
    log = folder / "opened"
    log.write_text("")
    documents.register(spark, make_reader(), opener=counting(str(log)))
    read = spark.read.format("documents").option("partitionBytes", "500").load(str(folder / "in"))
    listed = {(r.path, r.length, r.modificationTime) for r in source.scan_folder(spark, str(folder / "in")).select("path", "length", "modificationTime").collect()}
    rows = read.collect()
    assert {(r.path, r.length, r.modificationTime) for r in rows} == listed and read.rdd.getNumPartitions() > 2
    assert sorted((r.idx, r.text) for r in rows if r.suffix == ".pdf") == [(0, "first page"), (1, "second page")]
    assert [r.error for r in rows if r.suffix == ".doc"] == ["LookupError: no converter for .doc files"]
    whole = {(r.path, r.para_idx, r.text) for r in source.read_paragraphs(source.scan_folder(spark, str(folder / "in"))).where("error is null").collect()}
    assert {(r.path, r.idx, r.text) for r in rows if r.suffix == ".docx"} == whole
    assert sorted(log.read_text().split()) == sorted(["P.PDF", "old.doc", *(f"d{k}.docx" for k in range(6))])


def test_filters_open_only_what_is_left(spark, folder):
    log = folder / "opened"
    documents.register(spark, make_reader(), opener=counting(str(log)))
    read = spark.read.format("documents").load(str(folder / "in"))
    for condition, opened in (("suffix = '.pdf'", ["P.PDF"]), ("length > 1000000", []), ("path like '%/d3.docx'", ["d3.docx"]), ("suffix in ('.doc', '.x') and text is null", ["old.doc"]), ("modificationTime > timestamp'2999-01-01'", [])):
        log.write_text("")
        got = read.where(condition).collect()
        assert sorted(set(log.read_text().split())) == opened and {r.path.rsplit("/", 1)[1] for r in got} == set(opened), condition


def test_versions_of_a_folder(spark, folder):
    where = {k: str(folder / k) for k in ("store", "check", "snapshots")}

    def now():
        q = follow(spark, str(folder / "in"), where["store"], where["check"], where["snapshots"])
        q.awaitTermination(120)
        assert q.exception() is None
        return sorted((r.file, r.text) for r in cache.current(spark, where["store"]).where("ocr_error is null").collect())

    assert [f for f, _ in now()] == [f"d{k}.docx" for k in range(6)]
    docx(folder / "in/sub/d0.docx", "changed")
    os.utime(folder / "in/sub/d0.docx", (5, 5))
    (folder / "in/sub/d1.docx").unlink()
    docx(folder / "in/d9.docx", "later")
    got = now()  # goes on from the checkpoint
    assert got[0] == ("d0.docx", "changed") and [f for f, _ in got] == ["d0.docx", "d2.docx", "d3.docx", "d4.docx", "d5.docx", "d9.docx"]
    assert now() == got
    docx(folder / "in/sub/d1.docx", "back")
    got = now()
    assert ("d1.docx", "back") in got
    keys, blocks = cache.current_keys(spark, where["store"]), index.blocks_of(cache.current(spark, where["store"]))
    assert report.kept_status(keys).collect() == report.index_status(blocks).collect() and report.kept_status(keys).first().n_text_files == 7
    assert not any("/blocks/" in f for f in report.kept_status(keys).inputFiles())
    cache.compact(spark, where["store"])
    assert sorted((r.file, r.text) for r in cache.load(spark, where["store"]).where("ocr_error is null").collect()) == got


def test_differences():
    old = [documents.Found("a", 1, 5), documents.Found("b", 1, 5), documents.Found("c", 1, 5)]
    new = [documents.Found("a", 1, 5), documents.Found("b", 2, 5), documents.Found("d", 1, 5)]
    assert [(c, f.path, p) for c, f, p in documents.differences(old, new)] == [("changed", "b", 1), ("new", "d", None), ("deleted", "c", 1)]
    parts = documents.by_bytes([documents.Found(str(k), 0, 10) for k in range(7)] + [documents.Found("big", 0, 500)], 30)
    assert [len(p.files) for p in parts] == [1, 3, 3, 1]


def test_moved_files_are_not_read_again(spark, folder):
    """Copies take over stored blocks: no parse, and only files of a known length are opened at all."""
    log = folder / "parsed"

    def reader(path, content):
        with open(log, "a") as f:
            f.write(path.rsplit("/", 1)[1] + "\n")
        return "w", [(t, 0, True) for t in content.decode().split("|")]

    def update():
        log.write_text("")
        got = index.update(source.scan_folder(spark, str(folder / "in")), str(folder / "store"), reader, open_file=counting(str(folder / "opened")), by_content=True)
        return sorted((r.file, r.page, r.text) for r in got.where("ocr_error is null").collect()), log.read_text().split()

    (folder / "opened").write_text("")
    (folder / "in/Q.pdf").write_bytes(b"first page|second pagf")  # as long as the other one
    first, parsed = update()
    assert sorted(parsed) == ["P.PDF", "Q.pdf"]
    (folder / "in/P.PDF").rename(folder / "in/sub/moved.pdf")
    (folder / "in/sub/again.pdf").write_bytes(b"first page|second page")
    (folder / "in/R.pdf").write_bytes(b"first page|second pagg")
    (folder / "opened").write_text("")
    later, parsed = update()
    assert parsed == ["R.pdf"]
    rename = {"P.PDF": "moved.pdf"}
    want = [(rename.get(f, f), p, t) for f, p, t in first] + [("again.pdf", k + 1, t) for k, t in enumerate(["first page", "second page"])] + [("R.pdf", k + 1, t) for k, t in enumerate(["first page", "second pagg"])]
    assert sorted(later, key=str) == sorted(want, key=str)
    assert {"Q.pdf", "d1.docx"}.isdisjoint((folder / "opened").read_text().split())
    assert update()[1] == []


def test_small_files_share_frames(monkeypatch):
    from pagefinder.sources import files

    rows = [[(f"{k}.docx", 0, f"text {k}", "", None)] for k in range(1000)] + [[("bad.docx", None, None, None, "BadZipFile: no")], []]
    frames = list(files._in_frames(iter(rows)))
    assert len(frames) == 1 and len(frames[0]) == 1001 and frames[0].error.notna().sum() == 1
    monkeypatch.setattr(files, "FRAME_CHARS", 40)
    frames = list(files._in_frames(iter(rows)))
    assert len(frames) > 100 and [p for f in frames for p in f.path] == [r[0] for x in rows for r in x]


def test_pages_go_on_few_at_a_time():
    import pyarrow as pa

    from pagefinder.operators import ocr

    info = [{"pdf_path": f"p{k}", "page_idx": k, "dpi": 300} for k in range(1000)]
    whole = pa.RecordBatch.from_pydict({"page": list(range(1000)), "ocr_error": pa.array([None] * 1000, pa.string()), "render_info": info})
    seen = []

    def engine(path, page, dpi):
        seen.append(page)
        if page == 7:
            raise ValueError("torn")
        return [(path, 0.5)]

    parts = ocr.page_by_page(iter([whole]), engine)
    first = next(parts)
    assert len(seen) == first.num_rows <= ocr.PAGES_AT_ONCE
    rows = [r for b in (first, *parts) for r in b.to_pylist()]
    assert [r["page"] for r in rows] == list(range(1000)) and rows[7]["ocr_error"] == "ValueError: torn" and rows[7]["_lines"] == []
    assert all(r["_lines"] == [{"text": r["render_info"]["pdf_path"], "conf": 0.5}] and r["ocr_error"] is None for r in rows if r["page"] != 7)
