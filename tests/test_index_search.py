"""Locating by index, segment by segment and for tables of queries, against the plain scan."""

import random
import re

import pytest

from pagefinder.functions.keywords import keywords
from pagefinder.operators import locate, query_table, substring_index

SCHEMA = "file string, page int, chapter string, text string, file_ord long, block_ord long, n_hits int, segment string"


def corpus(n=900, seed=6):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 6))) for _ in range(120)] + ["中文字符", "防腐涂料", "aaaa", "a.b%c", "𝔘𝔫𝔦"]
    rows = []
    for k in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 30, 60])))
        if k % 97 == 0:
            text = rng.choice(["aaaaaaa " * 9, None, "", "ab", "x" * 300_000 + "needle" + "y" * 900_000])
        f = rng.choice(["big", "big", f"f{k % 40}"])
        rows.append((f, k, "c", text, len(f) + sum(map(ord, f)), k, 1, "s"))
    return rows, words


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rows, words = corpus()
    blocks = spark.createDataFrame(rows, SCHEMA).repartition(6).cache()
    path = f"file://{tmp_path_factory.mktemp('index')}/of"
    substring_index.build(blocks, path, segment_blocks=32, buckets=16)
    return blocks, words, path


def test_indexed_equals_scan(spark, built):
    blocks, words, path = built
    rng = random.Random(1)
    queries = ["needle", "aaaa 和 aaaaaaa", "absent words", "防腐涂料在哪里", "ab", ""]
    queries += [" ".join(rng.sample(words, rng.randint(1, 3))) for _ in range(4)]
    for q in queries:
        want = [tuple(r) for r in locate.locate(blocks, q, 40).collect()]
        assert [tuple(r) for r in substring_index.locate(spark, path, q, 40).collect()] == want, q
        assert [tuple(r) for r in substring_index.locate_top(spark, path, q, 40).collect()] == want, q


def test_reads_what_it_needs(spark, built):
    _, words, path = built
    gram = substring_index.word_grams("needle")
    found = substring_index.postings(spark, path, gram)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(gram" in plan
    plan = substring_index.locate(spark, path, "needle")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*segment", plan)  # of the blocks' scan
    seen = {}
    substring_index.locate_top(spark, path, next(w for w in words if len(w) > 4), 3, first_wave=1, report=seen)
    assert 0 < seen["n_read"] < seen["n_segments"]


def test_long_texts_piece_by_piece(monkeypatch):
    text = "abcab" * 50 + "中文字"
    whole = substring_index._text_grams(text)
    monkeypatch.setattr(substring_index, "_PIECE", 7)
    cut = substring_index._text_grams(text)
    assert whole[0].tolist() == cut[0].tolist() and whole[1].tolist() == cut[1].tolist()


@pytest.mark.parametrize("block_chars", [1 << 20, 60])
def test_table_of_queries(spark, built, block_chars):
    blocks, words, _ = built
    rng = random.Random(2)
    queries = {k: " ".join(rng.sample(words, rng.randint(1, 4))) for k in range(12)} | {50: "在哪里", 51: "", 52: "aaaa aa a", 53: None}
    table = spark.createDataFrame(list(queries.items()), "query_id long, query string")
    got = {}
    for r in query_table.locate_table(blocks, table, 30, block_chars).collect():
        got.setdefault(r.query_id, []).append((r.result_rank, r.file, r.page, r.score))
    for k, q in queries.items():
        want = locate.locate(blocks, q or "", 30).collect() if keywords(q or "") else []
        assert sorted(got.get(k, [])) == [(i + 1, r.file, int(r.page), r.score) for i, r in enumerate(want)], q


def test_plans_do_not_grow_with_queries(spark, built):
    blocks, words, _ = built
    size = []
    for n in (10, 10_000):
        table = spark.createDataFrame([(k, f"{words[k % 120]} w{k}") for k in range(n)], "query_id long, query string")
        size.append(len(query_table.locate_table(blocks, table)._jdf.queryExecution().optimizedPlan().toString()))
    assert abs(size[0] - size[1]) < 200
