"""Exact verification of candidate groups: sets of 64-bit hashes compared by Jaccard similarity.

Classes are moved as items (bytes), whatever is smaller: the set itself or the text it is made of;
``decode`` makes ascending distinct hashes of a list of items.

A group is a key and the classes that share it.  Its classes are verified in two steps.  First each
with the group's hub, the class that shares keys with most others (for copies of one original
the original, or the copy nearest to it): linear in the group.  What passed is united, so most groups
lie in one component.  Then, in groups that are still torn, classes of different components are
compared with each other in tiles of bounded size.  A tile returns a spanning forest of the links it
found, never the pairs themselves.  Only verified links are ever chained.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, forest, materialize, sized_broadcast
from .components import connected_components

#: Classes in one side of a tile, and members dealt together to a task.
TILE = 1024
DEAL = 4096


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of each left with each right set (places in ``sets``).

    Elements that many of the sets hold are multiplied as 0/1 matrices, a few thousand columns
    at a time; the others are paired one by one.
    """
    n = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), n)
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    l_at, r_at = np.full(len(sets), -1), np.full(len(sets), -1)
    l_at[left], r_at[right] = np.arange(len(left)), np.arange(len(right))
    out = np.zeros((len(left), len(right)), np.float32)
    common = held >= 12
    number = np.cumsum(common) - 1
    keep = common[column]
    r, c = row[keep], number[column[keep]]
    order = np.argsort(c, kind="stable")
    r, c = r[order], c[order]
    width = 4096
    for at in range(0, int(common.sum()), width):
        i, j = np.searchsorted(c, [at, at + width])
        x = np.zeros((len(sets), width), np.float32)
        x[r[i:j], c[i:j] - at] = 1
        out += x[left] @ x[right].T
    flat = out.ravel()
    order = np.argsort(column, kind="stable")
    begins = np.cumsum(held) - held
    for k in range(2, 12):
        cols = np.flatnonzero(held == k)
        for some in np.array_split(cols, max(1, len(cols) * k * k // 2_000_000)):
            if len(some):
                m = row[order[begins[some][:, None] + np.arange(k)]]
                a, b = np.repeat(m, k, axis=1).ravel(), np.tile(m, (1, k)).ravel()
                fine = (l_at[a] >= 0) & (r_at[b] >= 0)
                flat += np.bincount(l_at[a[fine]] * len(right) + r_at[b[fine]], minlength=len(flat))
    # a set is in both sides of a tile on the diagonal; elements only it holds don't matter to pairs
    return out


Decode = Callable[[list[bytes]], list[np.ndarray]]


def as_written(items: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in items]


def _with_hub(threshold: float, decode: Decode):
    """Links (a, b) of members with the hub that stands beside them; the hub's own row has cid = hub."""

    def run(table: pa.Table) -> pa.Table:
        hub, cid = table.column("hub").to_numpy(), table.column("cid").to_numpy()
        sets = decode(table.column("item").to_pylist())
        size = np.array([len(s) for s in sets])
        a, b = [], []
        order = np.lexsort((cid != hub, hub))
        for own in np.split(order, np.flatnonzero(np.diff(hub[order])) + 1):
            head, rest = own[0], own[cid[own] != hub[own]]
            if cid[head] != hub[head] or not len(rest):
                continue
            one = sets[head]
            rest = rest[np.minimum(size[rest], len(one)) >= threshold * np.maximum(size[rest], len(one))]
            if not len(rest):
                continue
            many = np.concatenate([sets[k] for k in rest])
            same = one[np.minimum(np.searchsorted(one, many), len(one) - 1)] == many
            shared = np.add.reduceat(same, np.cumsum(size[rest]) - size[rest])
            fine = rest[shared >= threshold * (size[rest] + len(one) - shared)]
            a.append(cid[fine])
            b.append(hub[fine])
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return pa.table({"a": join(a), "b": join(b)})

    return run


def _across(threshold: float, decode: Decode):
    """Links between components, found by comparing the two blocks of each tile."""

    def run(table: pa.Table) -> pa.Table:
        key, block, ti, tj, c = (table.column(x).to_numpy() for x in ("key", "block", "ti", "tj", "c"))
        sets = decode(table.column("item").to_pylist())
        a, b = [], []
        order = np.argsort(key, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            left, right = np.flatnonzero(block[own] == ti[own]), np.flatnonzero(block[own] == tj[own])
            if not len(left) or not len(right):
                continue
            size = np.array([len(sets[k]) for k in own], np.float64)
            both = overlaps([sets[k] for k in own], left, right).astype(np.float64)
            hit = both >= threshold * (size[left][:, None] + size[right][None] - both)
            hit &= c[own][left][:, None] != c[own][right][None]
            x, y = np.nonzero(hit)
            x, y = c[own][left[x]], c[own][right[y]]
            names, at = np.unique(np.concatenate([x, y]), return_inverse=True)
            tree = forest(len(names), at[: len(x)], at[len(x) :])
            a.append(x[tree])
            b.append(y[tree])
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return pa.table({"a": join(a), "b": join(b)})

    return run


def united(near: DataFrame, components: DataFrame) -> DataFrame:
    """(cid, c) with components that turned out to be one put together."""
    put = sized_broadcast(components.select(F.col("node").alias("c"), "component"))
    return materialize(near.join(put, "c", "left").select("cid", F.coalesce("component", "c").alias("c")), "united")


def tiles(rows: DataFrame, group: str, size: DataFrame, side: int, block_by: str = "cid") -> DataFrame:
    """Rows of each group dealt into blocks of about ``side``, once for each tile (ti, tj) they take part in."""
    dealt = rows.join(size.withColumn("nb", F.ceil(F.col("n") / side).cast("int")), group)
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(block_by), F.col("nb")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return dealt.withColumn("ti", F.least("block", "other")).withColumn("tj", F.greatest("block", "other"))


def hub_pairs(groups: DataFrame) -> DataFrame:
    """(hub, cid), written: each class with the hubs of its groups (key, cid)."""
    size = materialize(groups.groupBy("key").agg(F.count("*").alias("n")), "group-sizes")
    counted = groups.join(sized_broadcast(size), "key")
    score = materialize(counted.groupBy("cid").agg(F.sum("n").alias("score")), "scores")
    best = counted.join(sized_broadcast(score), "cid").groupBy("key").agg(F.max_by("cid", F.struct("score", "cid")).alias("hub"))
    return materialize(groups.join(best, "key").where("cid <> hub").select("hub", "cid").distinct(), "hub-pairs")


def unite_groups(groups: DataFrame, items: DataFrame, threshold: float, near: DataFrame | None = None, tile: int = TILE, decode: Decode = as_written) -> DataFrame:
    """(cid, c): for every class of ``groups`` (key, cid; written, distinct) its component of verified links.

    ``items``: (cid, item), written.  ``near``: components known before; groups within one of them
    are not looked at.  Keys and ids are longs.
    """
    mine = groups.select("cid").distinct()
    if near is None:
        near = materialize(mine.select("cid", F.col("cid").alias("c")), "near")
    else:
        near = materialize(mine.join(near, "cid", "full").select("cid", F.coalesce("c", "cid").alias("c")), "near")
        groups = torn(groups, near)
    pairs = hub_pairs(groups)
    parts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / DEAL).alias("parts"))
    dealt = pairs.join(parts, "hub").select("hub", "cid", F.pmod(F.xxhash64("cid"), F.col("parts")).alias("part"))
    heads = parts.select("hub", F.col("hub").alias("cid"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    together = dealt.union(heads).join(items, "cid")
    deals = max(1, pairs.count() // DEAL)
    found = together.select(F.pmod(F.xxhash64("hub", "part"), F.lit(deals)).alias("deal"), "hub", "cid", "item").groupBy("deal").applyInArrow(_with_hub(threshold, decode), "a long, b long")
    linked = connected_components(as_components(found, near))
    near = united(near, linked)

    still = torn(groups, near)
    size = materialize(still.groupBy("key").agg(F.count("*").alias("n")).where("n > 2"), "torn-sizes")
    rows = still.join(sized_broadcast(near), "cid").join(items, "cid").select("key", "cid", "c", "item")
    tile_rows = tiles(rows, "key", size, tile)
    total = size.agg(F.sum("n")).first()[0] or 0
    small = F.pmod(F.xxhash64("key"), F.lit(max(1, total // DEAL)))
    deal = F.when(F.col("nb") == 1, -1 - small).otherwise(F.xxhash64("key").bitwiseAND(F.lit((1 << 62) - 1)))
    found = tile_rows.select(deal.alias("deal"), "key", "block", "ti", "tj", "c", "item").groupBy("deal", "ti", "tj").applyInArrow(_across(threshold, decode), "a long, b long")
    return united(near, connected_components(found))


def torn(groups: DataFrame, near: DataFrame) -> DataFrame:
    """Groups that lie in more than one component."""
    placed = groups.join(sized_broadcast(near), "cid")
    keys = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    return materialize(groups.join(sized_broadcast(materialize(keys, "torn-keys")), "key", "left_semi"), "torn")


def as_components(links: DataFrame, near: DataFrame) -> DataFrame:
    at = lambda x: near.select(F.col("cid").alias(x), F.col("c").alias(f"{x}c"))
    return links.join(at("a"), "a").join(at("b"), "b").select(F.col("ac").alias("a"), F.col("bc").alias("b"))


def once(items: DataFrame, members: DataFrame) -> DataFrame:
    """Written items, one for each member; only where rows repeat are they dealt to be made distinct."""
    out = materialize(items, "items")
    if out.count() > members.count():
        first, out = out, materialize(out.dropDuplicates(["cid"]), "items")
        discard(first)
    return out
