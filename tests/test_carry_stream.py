"""Pages that arrive in any order, against the batch form."""

import os
import random
import time

import pytest

from pagefinder.operators.blocks import carry_chapter
from pagefinder.streaming.carry import carry_chapters

PAGES = "path string, page_idx long, text string, scanned boolean"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def test_a_page_that_never_comes(rocks, tmp_path):
    """After the patience is over the waiting pages leave without it, and it is marked when it comes later."""
    put = lambda rows: rocks.createDataFrame(rows, PAGES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    put([("f", 0, "1 First", False), ("f", 2, "plain", False), ("f", 3, "2 Next", False)])
    read = rocks.readStream.schema(PAGES).parquet(f"{tmp_path}/in")
    q = carry_chapters(read, patience_ms=1).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").trigger(processingTime="1 second").start(f"{tmp_path}/out")

    def rows(n):
        for _ in range(120):
            time.sleep(0.5)
            got = rocks.read.schema("page_idx long, chapter string, complete boolean").parquet(f"{tmp_path}/out").collect() if os.path.isdir(f"{tmp_path}/out/_spark_metadata") else []
            if len(got) >= n:
                break
        return sorted(tuple(r) for r in got)

    try:
        assert rows(3) == [(0, "1 First", True), (2, "1 First", False), (3, "2 Next", False)]
        put([("f", 1, "plain", False), ("f", 4, "plain", False)])
        assert rows(5) == [(0, "1 First", True), (1, "2 Next", False), (2, "1 First", False), (3, "2 Next", False), (4, "2 Next", True)]
    finally:
        q.stop()


def test_any_order_equals_batch(rocks, tmp_path):
    rng = random.Random(8)
    rows = [(f"f{f}", k, rng.choice(["第%d章 x" % k, "plain", "", "1 Scope"]), rng.random() < 0.3) for f in range(4) for k in range(30)]
    want = {(r.path, r.page_idx, r.chapter) for r in carry_chapter(rocks.createDataFrame(rows, PAGES)).collect()}
    rng.shuffle(rows)
    for k in range(4):  # four batches, the same page in two of them
        rocks.createDataFrame(rows[k * 30 : k * 30 + 33], PAGES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    read = rocks.readStream.schema(PAGES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = carry_chapters(read).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start(f"{tmp_path}/out")
    q.awaitTermination(300)
    assert q.exception() is None and len(q.recentProgress) >= 4
    got = rocks.read.parquet(f"{tmp_path}/out").collect()
    whole = {(r.path, r.page_idx, r.chapter) for r in got if r.complete}
    assert whole == want and len([r for r in got if r.complete]) == len(rows)
