"""Scans over the ordered rows of a key, shared by many tasks however long the key is.

A key's rows are cut into runs of bounded length by their order.  Each run is summarised; summaries, a row a run, are
scanned by key; and what comes in from the runs before is applied to the rows of each run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a key that one task scans.
ROWS = 4096


def run_of(order: str, rows: int = ROWS) -> Column:
    """Which run a row is in, from its number in the key (of integers that needn't be dense)."""
    return F.floor(F.col(order) / rows).cast("long")


def _scan(df: DataFrame, key: str, order: str, rows: int, summary: Column, scanned: Column, inside: Column) -> DataFrame:
    """Rows with ``_own``, what the rows of their run say, and ``_before``, what the runs before say; null keys are a key."""
    cut = df.withColumn("_run", run_of(order, rows))
    earlier = Window.partitionBy(key).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    before = cut.groupBy(key, "_run").agg(summary.alias("_sum")).select(F.col(key).alias("_key"), F.col("_run").alias("_of"), scanned.over(earlier).alias("_before"))
    here = Window.partitionBy(key, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return cut.withColumn("_own", inside.over(here)).join(before, F.col(key).eqNullSafe(F.col("_key")) & F.col("_run").eqNullSafe(F.col("_of"))).drop("_key", "_of")


def carry_last(df: DataFrame, key: str, order: str, value: str, into: str, rows: int = ROWS) -> DataFrame:
    """Adds ``into``: the last ``value`` that is not null, up to and with each row.

    ``df`` is read twice, once for what each run hands on; it should be a table or cheap to make.  The order should have no ties.
    """
    last = F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order)))
    out = _scan(df, key, order, rows, last, F.last("_sum", ignorenulls=True), F.last(value, ignorenulls=True))
    return out.withColumn(into, F.coalesce("_own", "_before")).drop("_own", "_before", "_run")


def count_up_to(df: DataFrame, key: str, order: str, value: str, into: str, rows: int = ROWS) -> DataFrame:
    """Adds ``into``: the sum of ``value`` up to and with each row, and ``_run``; ``df`` is read twice."""
    out = _scan(df, key, order, rows, F.sum(value), F.sum("_sum"), F.sum(value))
    return out.withColumn(into, F.col("_own") + F.coalesce("_before", F.lit(0))).drop("_own", "_before")
