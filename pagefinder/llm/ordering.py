"""Global ranks and running sums without a task that sees everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions

#: Row numbers of ``monotonically_increasing_id`` within a partition take so many bits.
_BITS = 33


def numbered(rows: DataFrame, order: list[str | Column], sums: tuple[str, ...] = (), tag: str = "numbered") -> DataFrame:
    """Adds ``rank`` (long, from 0, in the order given) and, for each column of ``sums``, ``before_<column>``: its total over all earlier rows.

    Rows are range-partitioned by the order, sorted and written, which fixes their places; only one row a partition
    goes through a window without keys.  ``order`` must tell rows apart but for equal ones, which may take each other's places; a value that many
    rows share is cut between partitions at the next column of the order.
    """
    sort = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    fixed = materialize(sort.withColumn("_i", F.monotonically_increasing_id()), tag)
    part = fixed.withColumn("_p", F.shiftright("_i", _BITS))
    totals = part.groupBy("_p").agg(F.count("*").alias("_n"), *(F.sum(s).alias(f"_{s}") for s in sums))
    so_far = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    start = totals.select("_p", *(F.coalesce(F.sum(c).over(so_far), F.lit(0)).alias(f"_before{c}") for c in ("_n", *(f"_{s}" for s in sums))))
    if sums:
        within = Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
        part = part.withColumns({f"before_{s}": F.coalesce(F.sum(s).over(within), F.lit(0)) for s in sums})
    placed = part.join(F.broadcast(start), "_p")  # a row a partition
    placed = placed.withColumns({"rank": F.col("_before_n") + F.col("_i").bitwiseAND((1 << _BITS) - 1), **{f"before_{s}": F.col(f"before_{s}") + F.col(f"_before_{s}") for s in sums}})
    return placed.select(*rows.columns, "rank", *(f"before_{s}" for s in sums))


def running(rows: DataFrame, key: str, chunk: Column, order: str, sums: tuple[str, ...], backwards: bool = False) -> DataFrame:
    """Adds ``before_<column>`` for each of ``sums``: its total over the earlier rows of the same key (the later ones, if ``backwards``).

    ``chunk`` grows with ``order`` and cuts a key's rows into bounded runs, so that a key of any size is shared by many
    tasks: sums within a run, and sums of whole runs, a row each.  ``rows`` is read twice, so it should be written.
    """
    rows = rows.withColumn("_chunk", chunk)
    totals = rows.groupBy(key, "_chunk").agg(*(F.sum(s).alias(f"_{s}") for s in sums))
    by = lambda c: F.desc(c) if backwards else F.asc(c)
    so_far = Window.partitionBy(key).orderBy(by("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    start = totals.select(key, "_chunk", *(F.coalesce(F.sum(f"_{s}").over(so_far), F.lit(0)).alias(f"_before_{s}") for s in sums))
    within = Window.partitionBy(key, "_chunk").orderBy(by(order)).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumns({f"before_{s}": F.coalesce(F.sum(s).over(within), F.lit(0)) for s in sums}).join(start, [key, "_chunk"])
    return out.withColumns({f"before_{s}": F.col(f"before_{s}") + F.col(f"_before_{s}") for s in sums}).drop("_chunk", *(f"_before_{s}" for s in sums))
