"""Reports kept with a store, and answers kept in a ledger."""

import pytest
from pyspark.sql import functions as F

from pagefinder.operators import cache, locate, polish, report


def results(spark, texts):
    rows = [(f, k + 1, "c", t, k) for k, (f, t) in enumerate(texts)]
    b = spark.createDataFrame(rows, "file string, page int, chapter string, text string, block_ord long")
    return report.ranked(locate.locate(b, "aa"))


def counting(log, broken=()):
    def chat(messages, temperature):  # local, so that workers need not import this file
        text = messages[1]["content"]
        with open(log, "a") as f:
            f.write("call\n")
        if any(b in text for b in broken):
            raise RuntimeError("no answer")
        yield "said "
        yield text[-2:]

    return chat


def test_each_prompt_is_asked_once(spark, tmp_path):
    log, ledger = tmp_path / "log", str(tmp_path / "ledger")
    log.write_text("")
    found = results(spark, [("f1", "aa 1"), ("f2", "aa 2"), ("f3", "aa 3 bad")])
    first = {r.file: (r.answer, r.failed) for r in polish.polish(found, "aa", counting(log, ["bad"]), ledger).collect()}
    assert [f for f, (_, failed) in sorted(first.items()) if failed] == ["f3"] and log.read_text().count("call") == 3
    again = {r.file: (r.answer, r.failed) for r in polish.polish(found, "aa", counting(log, ["bad"]), ledger).collect()}
    assert again == first and log.read_text().count("call") == 4  # the failed one only
    more = results(spark, [("f1", "aa 1"), ("f9", "aa 9")])
    polish.polish(more, "aa", counting(log), ledger).collect()
    assert log.read_text().count("call") == 5
    polish.polish(more, "aa", counting(log), ledger, model="other").collect()
    assert log.read_text().count("call") == 7


def test_failed_task_asks_nothing_twice(spark, tmp_path):
    """A run that dies after some calls has their answers noted; the next run asks the rest."""
    log, ledger = tmp_path / "log", str(tmp_path / "ledger")
    log.write_text("")
    rows = spark.createDataFrame([(f"aa {k}",) for k in range(6)], "prompt string").coalesce(1)
    whole = counting(log)

    def dies(messages, temperature):
        if messages[1]["content"] == "aa 4":
            raise SystemExit  # no error of the model: the worker goes
        return whole(messages, temperature)

    with pytest.raises(Exception):
        polish.answers(rows, dies, ledger)
    before = log.read_text().count("call")
    assert 0 < before < 6
    got = {r.answer for r in polish.answers(rows, whole, ledger).collect()}
    assert got == {f"said  {k}" for k in range(6)} and log.read_text().count("call") == 6


def test_kept_reports(spark, tmp_path):
    store = str(tmp_path / "store")
    columns = "cache_key string, file string, text string, scanned boolean, block_ord long, ocr_error string"
    put = lambda rows: cache.store(spark.createDataFrame(rows, columns), store)
    put([("k1", "a", "x", False, 0, None), ("k1", "a", "", True, 1, None), ("k2", "a", "y", True, 0, None), ("k3", "b", "", False, -1, None)])
    put([("k4", "c", "z", False, 0, None), ("k2", "a", "", True, 0, "e")])
    cache.mark_gone(spark.createDataFrame([("k4",), ("k9",)], "cache_key string"), store)
    put([("k5", "d", "w", True, 0, None)])
    for _ in range(2):
        now = cache.current(spark, store)
        blocks, keys = now.where("block_ord >= 0"), cache.current_keys(spark, store)
        assert {r.cache_key for r in now.collect()} == {"k1", "k2", "k3", "k5"}
        assert report.kept_status(keys).collect() == report.index_status(blocks).collect()
        assert report.kept_scanned_files(keys).collect() == report.scanned_files(blocks).collect()
        assert {r.cache_key for r in cache.misses(spark.createDataFrame([(k,) for k in ("k1", "k2", "k7")], "cache_key string"), keys).collect()} == {"k2", "k7"}
        cache.compact(spark, store)
    assert cache.entries(cache.current(spark, store)).first().n_entries == 4 and cache.current_keys(spark, store).where(F.col("n_errors") > 0).count() == 1
