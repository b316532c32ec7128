"""Scans run by run against windows: long files, borders, gaps, null keys."""

import random

import pytest
from pyspark.sql import functions as F

from pagefinder.operators import runs
from pagefinder.operators.blocks import carry_chapter, fold_sections, page_blocks
from pagefinder.schema import RAW_PAGES


def pages(spark, seed=3):
    rng = random.Random(seed)
    rows = []
    for path, n in (("long", 700), ("short", 3), (None, 40), ("edge", 16), ("none", 50)):
        for k in range(n):
            text = rng.choice(["第%d章 x" % k, "plain", "", "1 Scope"]) if path != "none" and rng.random() < 0.1 else "plain text"
            rows.append((path, k * (3 if path == "edge" else 1), text, rng.random() < 0.3, None, None))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "path string, page_idx long, text string, scanned boolean, style string, chapter string").repartition(5)


@pytest.mark.parametrize("rows", [1, 7, 16, 5000])
def test_equal_to_windows(spark, rows):
    df = pages(spark)
    of = lambda d: sorted(map(str, d.select("path", "page_idx", "text", "chapter").collect()))
    assert of(carry_chapter(df, rows=rows)) == of(carry_chapter(df))
    paragraphs = df.withColumnRenamed("page_idx", "para_idx").select("path", "para_idx", "text", "style")
    of = lambda d: sorted(map(str, d.select("path", "section", "chapter", "text").collect()))
    assert of(fold_sections(paragraphs, rows=rows)) == of(fold_sections(paragraphs))


def test_page_blocks(spark):
    rng = random.Random(1)
    rows = [(f"f{k % 3}", "scan" if k % 3 == 2 else "w", k // 3, rng.choice(["第一章 a", "text " * 30, "§" * 40, ""]), k % 2, bool(k % 5), None) for k in range(120)]
    rows.append(("bad", None, None, None, None, None, "broken"))
    df = spark.createDataFrame(rows, RAW_PAGES)
    of = lambda d: sorted(map(str, d.collect()))
    assert of(page_blocks(df, rows=4)) == of(page_blocks(df))


def test_one_long_file_over_many_tasks(spark):
    df = spark.range(1_000_000).select(F.lit("one").alias("path"), F.col("id").alias("page_idx"), F.when(F.col("id") % 9973 == 5, F.concat(F.lit("第"), F.col("id").cast("string"), F.lit("章"))).alias("own"))
    out = runs.carry_last(df, "path", "page_idx", "own", "chapter")
    want = F.when(F.col("page_idx") >= 5, F.concat(F.lit("第"), (F.col("page_idx") - F.pmod(F.col("page_idx") - 5, F.lit(9973))).cast("string"), F.lit("章")))
    sizes = out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.count_if(~F.col("chapter").eqNullSafe(want)).alias("wrong")).collect()
    assert sum(r.n for r in sizes) == 1_000_000 and sum(r.wrong for r in sizes) == 0 and max(r.n for r in sizes) < 500_000
