"""Importance resampling against its rule in plain Python, with awkward rows."""

import random

import pytest

from pagefinder.llm import resample

SCHEMA = "doc_id long, text string, batch long, at int, feature string, rank long"


def corpus(seed=5, n=80):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdef") for _ in range(rng.randint(1, 5))) for _ in range(200)]
    line = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    texts = [line(rng.randint(1, 60)) for _ in range(n)]
    texts += [texts[0], texts[0], texts[0].upper(), None, "", " \n\t ", "a-b_c A", "Ünïcode ß 中文字符 " * 9, line(40_000)]
    return list(enumerate(texts)), [line(50), None, "", "a b c", texts[3]]


@pytest.fixture(scope="module")
def tables(spark):
    rows, target = corpus()
    docs = spark.createDataFrame([(d, t, 1, 2, "x", 7) for d, t in rows], SCHEMA).repartition(3)
    return rows, target, docs, spark.createDataFrame([(t, 5) for t in target], "text string, doc_id long")


@pytest.mark.parametrize(("low", "high", "percent"), [(1, 1, 10), (1, 3, 50), (2, 2, 100)])
def test_rule(tables, low, high, percent):
    rows, target, docs, bench = tables
    got = {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in resample.resample(docs, bench, low, high, 50, percent, 5).collect()}
    assert got == resample.brute_force(rows, target, low, high, 50, percent, 5)


def test_long_texts_in_pieces():
    text = ("word other " * 500 + "中文 " * 300).encode()
    for low, high in ((1, 1), (1, 3), (2, 4)):
        whole = sorted(x for run in resample.features(text, low, high) for x in run)
        assert sorted(x for run in resample.features(text, low, high, most=37) for x in run) == whole


def test_empty_tables(spark, tables):
    rows, _, docs, bench = tables
    assert resample.resample(docs.where("false"), bench).count() == 0
    got = {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in resample.resample(docs, bench.where("false")).collect()}
    assert got == resample.brute_force(rows, [])


def test_repeated_and_null_ids(spark):
    text = " ".join("abcdefghijklmnopqrstuvwxyz")
    docs = spark.createDataFrame([(None, text), (None, text), (4, text), (4, text), (4, "short")], "doc_id long, text string")
    got = resample.resample(docs, docs, percent=100).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4] and len(got) == 5


def test_leaves_only_its_result(spark, tables):
    from pagefinder.llm.common import shared_dir

    _, _, docs, bench = tables
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/pagefinder")
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = lambda: {s.getPath().getName() for s in fs.listStatus(where)} if fs.exists(where) else set()
    before = names()
    resample.resample(docs, bench).count()
    assert [n.split("-")[0] for n in names() - before] == ["resampled"]
