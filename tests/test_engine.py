import os
import sys
import types
import zipfile

import numpy as np

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from pagefinder.operators import cache, config, index, locate, ocr, polish, report
from pagefinder.functions.image import deskew, skew
from pagefinder.sources import convert, models, pdf
from pagefinder.sources import files as source
from pagefinder.streaming.watch import watch

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(path, paragraphs):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    docx(tmp_path / "in/sub/c.DOCX", ["intro", "1 Scope", "steel and steel"])
    (tmp_path / "in/broken.docx").write_bytes(b"no zip")
    docx(tmp_path / "in/blank.docx", [" "])
    (tmp_path / "in/B.PDF").write_bytes(b"page one steel and more words that make it a page of text|")
    (tmp_path / "in/e.txt").write_text("steel")
    return tmp_path


def make_reader():
    def reader(path, content):  # local, so that workers need not import this file
        return "w", [(t, 0 if t else 1, bool(t)) for t in content.decode().split("|")]

    return reader


def blocks(spark, rows):
    return spark.createDataFrame([(f, i + 1, "c", t, i) for i, (f, t) in enumerate(rows)], "file string, page int, chapter string, text string, block_ord long")


def logged_opener(log):
    def opener(path):  # local, so that workers need not import this file
        with open(log, "a") as f:
            f.write(path.rsplit("/", 1)[1] + "\n")
        return open(path.removeprefix("file:"), "rb")

    return opener


def test_large_files_are_opened_by_path(spark, folder, monkeypatch):
    files = source.scan_folder(spark, str(folder / "in"))
    reader, want = make_reader(), None
    for most in (source.MOST_BYTES, 1):
        monkeypatch.setattr(source, "MOST_BYTES", most)
        got = sorted((r.path, r.block_ord, r.text, r.ocr_error) for r in index.build(files, reader).collect())
        want = want or got
    assert got == want and any("steel and steel" in r[2] for r in got)


def test_unchanged_files_are_not_opened(spark, folder):
    store, log = str(folder / "cache"), folder / "opened"
    how = {"pdf_reader": make_reader(), "open_file": logged_opener(str(log))}
    scan = lambda: source.scan_folder(spark, str(folder / "in"))
    (folder / "in/broken.docx").unlink()
    first = index.update(scan(), store, **how).collect()
    assert {r.path.rsplit("/", 1)[1] for r in first} == {"c.DOCX", "B.PDF", "blank.docx"} and len(first) == 5
    log.write_text("")
    files = scan()
    second = index.update(files, store, **how)
    assert log.read_text() == "" and sorted(second.collect()) == sorted(first)
    plan = index.build(files, cached=cache.keys(spark, store), **how)._jdf.queryExecution().sparkPlan().toString()
    scans = [x for x in plan.splitlines() if "FileScan binaryFile" in x]
    assert scans and not any("content#" in x.split("Batched")[0] for x in scans)
    docx(folder / "in/sub/c.DOCX", ["changed"])
    os.utime(folder / "in/sub/c.DOCX", (1, 1))
    (folder / "in/B.PDF").unlink()
    got = index.update(scan(), store, **how)
    assert log.read_text().split() == ["c.DOCX"] and sorted(r.text for r in got.collect()) == ["", "changed"]
    loaded = cache.load(spark, store)
    assert loaded.where("text = 'changed'").count() == 1 and "Join" not in loaded._jdf.queryExecution().optimizedPlan().toString()
    cache.compact(spark, store, got)
    assert sorted(r.text for r in cache.load(spark, store).collect()) == ["", "changed"]
    assert sorted(r.text for r in index.update(scan(), store, **how).collect()) == ["", "changed"] and log.read_text().split() == ["c.DOCX"]


def test_files_without_reader_are_tried_again(spark, folder):
    (folder / "in/old.doc").write_bytes(b"old")
    store = str(folder / "cache")
    scan = source.scan_folder(spark, str(folder / "in"))
    got = {r.file: r.ocr_error for r in index.update(scan, store).collect() if r.ocr_error}
    assert got["B.PDF"] == "no reader for .pdf files" and got["old.doc"] == "no converter for .doc files" and len(got) == 3
    docx(folder / "as.docx", ["from old"])
    content = (folder / "as.docx").read_bytes()
    later = index.update(scan, store, make_reader(), lambda old: content)
    assert {r.text for r in later.where("file = 'old.doc'").collect()} == {"from old"} and later.where("file = 'B.PDF'").count() == 2
    cache.compact(spark, store)
    assert {r.text for r in cache.load(spark, store).where("file = 'old.doc'").collect()} == {"from old"}


def test_text_boxes(tmp_path):
    box = "<w:txbxContent><w:p><w:r><w:t>inside</w:t></w:r></w:p></w:txbxContent>"
    mc = "http://schemas.openxmlformats.org/markup-compatibility/2006"
    body = f'<w:p><w:r><w:t>before</w:t></w:r><w:r><mc:AlternateContent xmlns:mc="{mc}"><mc:Choice>{box}</mc:Choice><mc:Fallback>{box}<w:t>again</w:t></mc:Fallback></mc:AlternateContent></w:r><w:r><w:t> after</w:t><w:br/><w:tab/><w:t>x</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p/>'
    with zipfile.ZipFile(tmp_path / "t.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
    want = [("before after\n\tx", ""), ("", "")]
    assert source.docx_paragraphs((tmp_path / "t.docx").read_bytes()) == want
    with open(tmp_path / "t.docx", "rb") as file:
        assert source.docx_paragraphs(file) == want


def test_recognise_leaves_the_rest(spark):
    """Blocks that need no OCR keep their confidence, don't enter Python, and no task gets them all."""
    rows = [(f"f{k % 3}", k % 5 == 0, "" if k % 10 == 0 else f"text {k}", (f"f{k % 3}", k, 300) if k % 5 == 0 else None, "c", None, 0.9 if k % 2 else None) for k in range(4000)]
    b = spark.createDataFrame(rows, "file string, scanned boolean, text string, render_info struct<pdf_path:string,page_idx:int,dpi:int>, chapter string, ocr_error string, ocr_conf double").repartition(8)

    def opener(path):
        from contextlib import contextmanager

        @contextmanager
        def opened():
            yield lambda page_idx, dpi: [(f"read {page_idx}", 0.25)]

        return opened()

    got = ocr.recognise(b, opener=opener)
    done = {r.text: r.ocr_conf for r in got.collect()}
    assert len(done) == 4000 and done["read 40"] == 0.25 and done["text 41"] == 0.9 and done["text 42"] is None and sum(t.startswith("read") for t in done) == 400
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert max(sizes) < 1000


def test_index_and_cache(spark, folder):
    files = source.scan_folder(spark, str(folder / "in"))
    assert {r.suffix for r in files.select("suffix").collect()} == {".docx", ".pdf"}
    assert source.scan_paths(spark, [f"{folder}/in/B.PDF", f"{folder}/in/e.txt"]).count() == 1
    with pytest.raises(NotADirectoryError):
        source.scan_folder(spark, str(folder / "none"))
    errors = source.read_paragraphs(files).where("error is not null").collect()
    assert [r.path.rsplit("/", 1)[1] for r in errors] == ["broken.docx"]
    reader = make_reader()
    seen = Observation()
    built = index.build(files, reader, ocr=lambda *_: [("第九章 steel", 0.5)], seen=seen)
    rows = {(r.file, r.page): r for r in built.collect()}
    assert seen.get == {"n_files": 4, "n_blocks": 5, "n_errors": 1}
    assert rows["B.PDF", 1].text.startswith("page one steel") and not rows["B.PDF", 1].scanned
    assert rows["B.PDF", 2].scanned and rows["B.PDF", 2].chapter == "第九章 steel" and rows["B.PDF", 2].ocr_conf == 0.5
    sections = sorted((r.block_ord, r.chapter, r.text) for r in built.where("file = 'c.DOCX'").collect())
    assert [s[1:] for s in sections] == [("（未识别章节）", "intro"), ("1 Scope", "1 Scope\nsteel and steel")]
    store = str(folder / "cache")
    cache.store(built, store)
    cached = cache.load(spark, store)
    cached.cache().count()
    # a file with an error is read again, the others are not
    assert [(r.file, r.text, r.ocr_error is not None) for r in index.build(files, reader, cached=cached).collect()] == [("broken.docx", "", True)]
    assert cache.entries(cached).first().n_entries == 4
    assert [(r.file, r.block_ord) for r in built.where("file = 'blank.docx'").collect()] == [("blank.docx", -1)]
    assert index.blocks_of(built).where("file = 'blank.docx'").count() == 0
    orders = [r.file_ord for r in built.select("path", "file_ord").distinct().orderBy("path").collect()]
    assert orders == sorted(set(orders)) and len(orders) == 4
    whole = index.refresh(files, cached, reader)
    assert sorted((r.path, r.text) for r in whole.collect()) == sorted((r.path, r.text) for r in built.collect())
    cache.store(built, store)  # once more: each key counts once
    assert cache.load(spark, store).count() == built.count()
    docx(folder / "in/sub/c.DOCX", ["changed"])
    os.utime(folder / "in/sub/c.DOCX", (1, 1))
    files = source.scan_folder(spark, str(folder / "in"))
    assert [r.text for r in index.build(files, reader, cached=cached).where("ocr_error is null").collect()] == ["changed"]
    assert sorted(r.text for r in index.refresh(files, cached, reader).where("file like 'c.%'").collect()) == ["changed"]
    (folder / "cache/mine.txt").write_text("stays")
    cache.clear(spark, store)
    assert (folder / "cache/mine.txt").exists() and not list((folder / "cache").glob("part-*"))


def test_failed_conversion(spark, folder):
    (folder / "in/old.doc").write_bytes(b"no zip")

    def convert(content):
        raise RuntimeError("no converter here")

    got = source.read_paragraphs(source.scan_folder(spark, str(folder / "in")), convert).where("path like '%old.doc'").collect()
    assert [r.error for r in got] == ["RuntimeError: no converter here"]
    assert "MapInPandas" in (plan := index.rules.page_blocks(source.read_pages(source.scan_folder(spark, str(folder / "in")), make_reader()))._jdf.queryExecution().optimizedPlan().toString()) and plan.count("MapInPandas") == 1


def test_page_rules(spark):
    """Short, garbled and scanned pages, which the tables don't hold."""
    long, odd = "text " * 100, "§" * 25
    rows = [("a", "Writer", 0, long, 1, True), ("a", "Writer", 1, "x" * 9, 0, True), ("a", "Writer", 2, "x" * 399, 0, False), ("a", "Writer", 3, "x" * 399, 0, True), ("a", "Writer", 4, odd + "abc" * 2, 0, True), ("b", "ScanSnap Manager", 0, long, 0, True), ("c", None, 0, "", 2, None), ("d", None, 0, "", 0, None)]
    pages = spark.createDataFrame([(*r, None) for r in rows], source.RAW_PAGES)
    got = {(r.path, r.page): r.scanned for r in index.rules.page_blocks(pages).collect()}
    assert got == {("a", 1): False, ("a", 2): True, ("a", 3): True, ("a", 4): False, ("a", 5): True, ("b", 1): True, ("c", 1): True, ("d", 1): False}


def test_stream(spark, folder):
    q = watch(spark, str(folder / "in"), str(folder / "store"), str(folder / "check"))
    q.awaitTermination(60)
    assert cache.load(spark, str(folder / "store")).where("text like '%steel%'").count() == 1


def test_locate(spark):
    b = blocks(spark, [("f1", "aa " * 8), ("f2", "aa aa aa"), ("f1", "aa " * 9), ("f3", ""), ("f4", "none")])
    got = locate.locate(b, "aa").collect()
    assert [(r.file, r.score) for r in got] == [("f1", 9), ("f2", 3), ("f1", 8)]
    assert locate.locate(b, "在哪里").count() == 0
    many = blocks(spark, [(f"f{i % 3}", "k" + "x" * 700) for i in range(501)])
    got = locate.locate(many, "k").collect()
    assert len(got) == 500 and {len(r.snippet) for r in got} == {600} and [r.block_ord for r in got] == list(range(500))
    batch = locate.locate_many(b, {1: "aa", 2: "none", 3: "在哪里"}).collect()
    assert sorted((r.query_id, r.file, r.score) for r in batch) == [(1, "f1", 8), (1, "f1", 9), (1, "f2", 3), (2, "f4", 1)]


def test_reports_and_polish(spark):
    b = blocks(spark, [("f1", "aa"), ("f2", "aa aa"), ("f1", "aa aa aa")])
    assert [(r.file, r.n_hits) for r in report.file_hits(b, ["aa"]).collect()] == [("f1", 4), ("f2", 2)]
    ranked = report.with_rank(locate.locate(b, "aa"), [F.desc("score")])
    assert [(r.file, r.pages) for r in report.group_results(ranked).collect()] == [("f1", "3、1"), ("f2", "2")]
    asked = polish.prompts(ranked, "aa").where("file = 'f2'").first()
    assert asked.prompt.endswith("【第2页 c】\naa aa") and "找到了 1 处" in asked.prompt
    answers = polish.polish(ranked, "aa", lambda m, t: iter(["say ", "aa"])).collect()
    assert all(not r.failed and "<b>aa</b>" in r.answer for r in answers)

    def broken(m, t):
        raise RuntimeError

    assert all(r.failed and "<b>aa</b>" in r.answer for r in polish.polish(ranked, "aa", broken).collect())


def test_ocr_rules(spark):
    rows = [([("a", 0.5), ("", 0.0), ("b", 1.0)],), ([],), ([("", 0.2)],)]
    d = spark.createDataFrame(rows, f"l {ocr.LINES}").select(ocr.lines_text(F.col("l")).alias("t"), ocr.lines_confidence(F.col("l")).alias("c"))
    assert [tuple(r) for r in d.collect()] == [("a\nb", 0.75), ("", 1.0), ("", 1.0)]


def test_opener(spark, tmp_path):
    """A file is opened once for all its pages; one that won't open is the error of its own pages."""
    log = str(tmp_path / "opened")

    def opener(path):  # local, so that workers need not import this file
        from contextlib import contextmanager

        @contextmanager
        def opened():
            with open(log, "a") as f:
                f.write(path + "\n")
            if path == "bad":
                raise OSError("no such file")
            yield lambda page_idx, dpi: [(f"{path} {page_idx} {dpi}", 1.0)]

        return opened()

    rows = [(p, True, "", (p, i, 300), "c", None) for p in ("a", "b", "bad") for i in range(5)] + [("a", False, "plain", None, "c", None)]
    b = spark.createDataFrame(rows, "file string, scanned boolean, text string, render_info struct<pdf_path:string,page_idx:int,dpi:int>, chapter string, ocr_error string")
    got = ocr.recognise(b, opener=opener).collect()
    assert sorted(r.text for r in got if r.text) == sorted([f"{p} {i} 300" for p in "ab" for i in range(5)] + ["plain"])
    assert [r.ocr_error for r in got if r.file == "bad"] == ["OSError: no such file"] * 5
    assert sorted(open(log).read().split()) == ["a", "b", "bad"]
    with pytest.raises(ValueError):
        ocr.recognise(b)


def test_ocr_shares_by_cost(spark, tmp_path):
    """A file of 3000 pages beside 600 small ones, some pages dear: no task has much more than the mean, and files are opened once a run."""
    rows = [("big", True, "", ("big", k, 300), "c", None, 1.0) for k in range(3000)] + [(f"s{f}", True, "", (f"s{f}", k, 300), "c", None, 5.0 if f % 9 == 0 else 1.0) for f in range(600) for k in range(2)]
    b = spark.createDataFrame(rows, "file string, scanned boolean, text string, render_info struct<pdf_path:string,page_idx:int,dpi:int>, chapter string, ocr_error string, dear double").repartition(6)
    log = str(tmp_path / "opened")

    def opener(path):
        from contextlib import contextmanager

        @contextmanager
        def opened():
            with open(log, "a") as f:
                f.write(path + "\n")
            yield lambda page_idx, dpi: [(f"{path} {page_idx}", 1.0)]

        return opened()

    got = ocr.recognise(b, opener=opener, cost=F.col("dear")).withColumn("p", F.spark_partition_id()).collect()
    assert len({r.text for r in got}) == len(rows) == 4200
    sums = {}
    for r in got:
        sums[r.p] = sums.get(r.p, 0) + r.dear
    mean = sum(sums.values()) / len(sums)
    assert len(sums) == -(-sum(r[6] for r in rows) // ocr.PAGES_A_TASK) and max(sums.values()) <= mean + 5
    assert len(open(log).read().split()) <= 601 + len(sums)


def page_image(angle):
    """Dark bars on a light page, turned by an angle."""
    y, x = np.mgrid[0:400, 0:400] - 200.0
    a = np.radians(angle)
    across, down = x * np.cos(a) + y * np.sin(a), y * np.cos(a) - x * np.sin(a)
    ink = (np.abs(across) < 150) & (np.abs(down) < 60) & (down % 20 < 10)
    return np.repeat(np.where(ink, 20, 235).astype(np.uint8)[..., None], 3, axis=2)


def test_deskew():
    for angle in (-20, -3, 0.2, 4, 30):
        image = page_image(angle)
        assert abs(skew(image) - angle) < 0.4
        level = deskew(image)
        assert level.shape == image.shape and abs(skew(level)) < 0.5
    level = page_image(0)
    assert deskew(level) is level and skew(np.full((9, 9, 3), 255, np.uint8)) == 0 and skew(np.zeros((0, 0), np.uint8)) == 0


def test_pdf_library(monkeypatch):
    """With a stand-in for the library, which is absent here."""

    class Page:
        def get_text(self, kind):
            return {"blocks": [{"type": 1}, {"type": 0, "lines": [{"spans": [{"text": " steel "}]}]}]} if kind == "dict" else "steel"

        def get_images(self, full):
            return [1, 2]

        def get_pixmap(self, dpi, alpha):
            image = page_image(4)
            return types.SimpleNamespace(samples=image.tobytes(), height=400, width=400)

    class Doc(list):
        metadata = {"producer": "w"}

        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

    monkeypatch.setitem(sys.modules, "fitz", types.SimpleNamespace(open=lambda stream, filetype: Doc([Page()])))
    assert pdf.read_pdf("a.pdf", b"x") == ("w", [("steel", 2, True)])
    made = []
    opener = pdf.page_opener(lambda: made.append(1) or (lambda image: [("level", abs(skew(image)))]), lambda path: b"x")
    for _ in range(2):
        with opener("a.pdf") as page:
            assert page(0, 300)[0][0] == "level" and page(0, 300)[0][1] < 0.5
    assert made == [1]


def test_office_converter(tmp_path, monkeypatch):
    monkeypatch.setenv("PATH", str(tmp_path))
    assert convert.office_converter(b"old") is None
    program = tmp_path / "soffice"
    program.write_text('#!/bin/sh\n/bin/mkdir -p "$6" && /bin/cp "$7" "$6/in.docx"\n')
    program.chmod(0o755)
    assert convert.office_converter(b"old") == b"old"
    program.write_text("#!/bin/sh\nexit 3\n")
    assert convert.office_converter(b"old") is None


def test_models():
    seen = []
    get = lambda url, headers: seen.append((url, headers)) or b'{"data": [{"id": "m2"}, {"id": "m1"}]}'
    assert models.list_models("http://host/v1/", "k", get) == ["m1", "m2"]
    assert seen == [("http://host/v1/models", {"Authorization": "Bearer k"})]
    with pytest.raises(RuntimeError, match="no list of models"):
        models.list_models("http://host", "k", lambda *_: b"no json")


def test_file_order_and_counts(spark):
    rows = [("f2", 1, "c", "aa", False, 2, 0), ("f1", 1, "c", "aa", False, 1, 7), ("f1", 2, "c", "", True, 1, 8), ("f3", 1, "c", "none", True, 3, 0)]
    b = spark.createDataFrame(rows, "file string, page int, chapter string, text string, scanned boolean, file_ord long, block_ord long")
    seen = Observation()
    assert [r.file for r in locate.locate(b, "aa", seen=seen).collect()] == ["f1", "f2"]
    assert seen.get == {"n_blocks": 4, "n_scanned_with_text": 1, "n_scanned_no_text": 1, "n_candidates": 2}
    assert [(r.result_rank, r.file) for r in locate.locate_many(b, {1: "aa"}).collect()] == [(1, "f1"), (2, "f2")]


def test_settings_file(spark, tmp_path):
    path = f"file://{tmp_path}/config.json"
    assert config.read(spark, path) == config.DEFAULTS
    config.save(spark, path, {"model": " m ", "cache_dir": f"file://{tmp_path}/other"})
    got = config.read(spark, path)
    assert got["model"] == "m" and got["api_key"] == ""
    assert config.cache_folder(spark, got, f"file://{tmp_path}/own").endswith("/other") and (tmp_path / "other").is_dir()
    config.save(spark, path, {**got, "cache_dir": ""})
    assert config.cache_folder(spark, config.read(spark, path), f"file://{tmp_path}/own").endswith("/own")


def test_config():
    assert config.load("{bad") == config.DEFAULTS
    assert config.load('{"model": "m"}')["model"] == "m" and not config.is_configured(config.load(None))
    assert '"a": "x"' in config.dump({"a": " x "})
