"""What operators leave in the shared folder, and rows whose ids tell nothing."""

import os

import pytest
from pyspark.sql import functions as F

from pagefinder.llm import decontaminate, packing
from pagefinder.llm.common import shared_dir
from pagefinder.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def left(spark):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/pagefinder")
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {s.getPath().getName() for s in fs.listStatus(where)} if fs.exists(where) else set()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", [*QUERIES, "pipeline"])
def test_only_results_are_left(spark, name):
    import corpus_pipeline

    before = left(spark)
    rows = (corpus_pipeline.run if name == "pipeline" else QUERIES[name])(spark, SF)
    assert rows.count() > 0 and len(left(spark) - before) <= 1


def test_packing_of_null_ids(spark, monkeypatch):
    """All rows have a null id and one length: they are ranked in many groups, and every sequence is full."""
    monkeypatch.setattr(packing, "RANK_ROWS", 1000)
    docs = spark.range(60_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two").alias("text"))
    got = packing.pack(docs, capacity=12)
    n = got.first().length
    sizes = got.groupBy("sequence_id").agg(F.count("*").alias("n"), F.count_distinct("offset").alias("d"), F.max("offset").alias("last")).agg(F.count("*").alias("s"), F.sum("n").alias("n"), F.sum("d").alias("d"), F.max("last").alias("last")).first()
    each = 12 // n
    assert (sizes.n, sizes.d, sizes.s, sizes.last) == (60_000, 60_000, -(-60_000 // each), (each - 1) * n)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64(_i" in plan


def test_equal_items_come_once(spark, monkeypatch):
    built = []
    whole = decontaminate.Block.build.__func__
    monkeypatch.setattr(decontaminate.Block, "build", classmethod(lambda cls, rows, n: built.append(len(rows)) or whole(cls, rows, n)))
    bench = spark.range(20_000).select(F.lit(1).alias("item_id"), F.lit("the same words again").alias("text"))
    docs = spark.createDataFrame([(1, "say the same words again now"), (2, "else")], "doc_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontaminate.decontaminate(docs, bench).collect()} == {1: 4, 2: 0} and built == [1]
