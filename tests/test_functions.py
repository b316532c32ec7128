import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagefinder.functions import text as T
from pagefinder.functions.keywords import keywords, keywords_column
from pagefinder.operators import blocks as B

QUERIES = [
    ("大地测量", ["大地测量"]),
    ("大地测量和电磁波测距", ["大地测量", "电磁波测距"]),
    ("防腐涂料在哪个文件", ["防腐涂料"]),
    ("防腐涂料的单价在哪个文件、第几页第几章", ["防腐涂料", "单价"]),
    ("C30 混凝土 与 C30", ["C30", "混凝土"]),
    ("在哪里", []),
    ("the THE éaument", ["the", "THE", "aument"]),
    ("中国 以及 a.b-c_d%", ["国", "a.b-c_d%"]),
]
HEADINGS = [
    ("第三章 总则", True), ("第 12 条 x", True), ("第〇章", False), ("第两章", False), ("第二十篇", False), ("一、范围", True), ("一 范围", True), ("十", False), ("12、foo", False),
    ("一、" + "x" * 41, False), ("1 Scope", True), ("1.1 Scope", True), ("2024 annual report", True), ("1. Scope", False), ("1.1. Scope", False), ("3 " + "x" * 41, True), ("3 " + "x" * 42, False),
    ("１ 全角", True), ("1　全角空格", True), ("ordinary\n1 Scope", False), ("\n \n 1 Scope \nmore", True), ("", False),
]


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", make(F.col("v")).alias("o")).collect()
    return [r.o for r in sorted(rows)]


def test_keywords(spark):
    assert [keywords(q) for q, _ in QUERIES] == [k for _, k in QUERIES]
    assert column(spark, [q for q, _ in QUERIES], keywords_column) == [k for _, k in QUERIES]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="和与以及并且或者在哪个文件里国ab.% é、", max_size=14), min_size=20, max_size=40))
def test_keyword_forms_agree(spark, queries):
    assert column(spark, queries, keywords_column) == [keywords(q) for q in queries]


def test_headings(spark):
    got = column(spark, [h for h, _ in HEADINGS], T.detect_chapter)
    assert [g is not None for g in got] == [x for _, x in HEADINGS]
    assert column(spark, ["第三章 " + "长" * 80], T.detect_chapter) == [("第三章 " + "长" * 80)[:60]]


def test_garbled(spark):
    assert column(spark, ["§" * 19, "§" * 20, "abcde" + "§" * 15, "abcd" + "§" * 16, "", None], T.is_garbled) == [False, True, False, True, False, False]


def test_scanned_pages(spark):
    rows = [("x" * 9, False, True), ("x" * 10, False, True), ("x" * 399, False, True), ("x" * 400, False, False), ("x" * 10, True, False), ("§" * 500, True, True)]
    got = spark.createDataFrame(rows, "t string, b boolean, want boolean").select("want", B.is_scanned_page(F.col("t"), F.col("b")).alias("o")).collect()
    assert all(r.o == r.want for r in got)


def test_pdf_classes(spark):
    text, rows = "x" * 50, []
    for path, producer, pages in [("scanner", "ScanSnap Manager", [(text, 0)]), ("digital", "w", [(text, 0)]), ("scanned", "w", [("", 1)]), ("mixed", None, [(text, 0), ("", 1)]), ("neither", "w", [("", 0)]), ("late", "w", [(text, 0)] * 3 + [("", 1)])]:
        rows += [(path, producer, i, t, n) for i, (t, n) in enumerate(pages)]
    got = B.pdf_classes(spark.createDataFrame(rows, "path string, producer string, page_idx int, raw_text string, n_images int"))
    assert {r.path: r.pdf_class for r in got.collect()} == {"scanner": "scanned", "digital": "digital", "scanned": "scanned", "mixed": "mixed", "neither": "digital", "late": "digital"}


@pytest.mark.parametrize(("text", "word", "n"), [("aaaa", "aa", 2), ("", "x", 0), ("𝒳a𝒳", "𝒳", 2), ("防腐涂料", "涂料", 1)])
def test_count(spark, text, word, n):
    assert column(spark, [text], lambda c: T.count_of(c, word)) == [n] == [text.count(word)]


def test_highlight(spark):
    mark = T.HIGHLIGHT.format("a$")
    assert column(spark, ["x a$ **a$** y"], lambda c: T.highlight(c, ["a$"])) == [f"x {mark} {mark} y"]
    assert column(spark, ["<i> ab a"], lambda c: T.highlight_safe(c, ["a", "ab"])) == [f"&lt;i&gt; {T.HIGHLIGHT.format('ab')} {T.HIGHLIGHT.format('a')}"]


def test_carry_and_fold(spark):
    pages = [("p", 0, "第一章 A", False), ("p", 1, "plain", False), ("p", 2, "二、not read", True), ("p", 3, "二、B", False), ("p", 4, "", True)]
    got = B.carry_chapter(spark.createDataFrame(pages, "path string, page_idx int, text string, scanned boolean")).orderBy("page_idx")
    assert [r.chapter for r in got.collect()] == ["第一章 A", "第一章 A", "第一章 A", "二、B", "二、B"]
    paragraphs = [("d", 0, "intro", ""), ("d", 1, "1 One", ""), ("d", 2, "text", ""), ("d", 3, "  ", ""), ("d", 4, "2 Two", ""), ("d", 5, "Styled", "Heading 2")]
    got = B.fold_sections(spark.createDataFrame(paragraphs, "path string, para_idx int, text string, style string")).orderBy("section").collect()
    assert [(r.chapter, r.text) for r in got] == [("（未识别章节）", "intro"), ("1 One", "1 One\ntext"), ("2 Two", "2 Two"), ("Styled", "Styled")]


def test_strip_is_python_s(spark):
    """For every character of the basic plane, at both ends and inside."""
    rows = [(c + "a" + c + "b" + c,) for c in map(chr, range(1, 0x10000)) if not "\ud800" <= c <= "\udfff"]
    d = spark.createDataFrame(rows, "t string")
    assert [r.t for r in d.select("t", T.strip(F.col("t")).alias("s")).collect() if r.s != r.t.strip()] == []
