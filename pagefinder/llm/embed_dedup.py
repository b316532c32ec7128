"""Near-duplicate vectors by sorted projection passes.

A pass gives every vector a code, the signs of its products with 126 random hyperplanes one after another, and puts the vectors in lexicographic
order of their codes.  Near vectors share long prefixes, so each is compared with its neighbours in that order, a bounded window on
either side.  Pairs of cosine ``threshold`` or more are verified in double precision and united across passes by distributed union-find.

What a pass can miss is known: all vectors that share more bits with a vector than the edges of its window do are in the window, and a pair at the
threshold agrees in m bits with probability (1 - angle / pi) ** m.  Every vector sums this up over passes, and leaves when a pair of
its own would have been missed in all of them with less than 1 - ``recall``.  In crowded regions more bits are shared and vectors stay longer; with each round of passes the
window is twice as wide, so any crowd is covered in the end.  A vector whose whole window is linked to it has found its
crowd and leaves too.  Nothing depends on the number of vectors as such.

Windows only serve to find components.  Links are then counted between all members of a component,
tile by tile, so no link inside a component is missed, however large the group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forest, materialize, scratch
from .components import connected_components

THRESHOLD = 0.9
#: Neighbours on either side in the first round, passes of a round, rows of a tile of a component.
WINDOW, PASSES, BLOCK = 256, 8, 1024
RECALL = 0.99
#: Windows in a range of the order that one task goes through; at its ends windows are cut.
WINDOWS_A_TASK = 32
#: Bits of half a code.
_BITS = 63


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    """Directions, in double precision; by the largest component first, so that no square over- or underflows."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype("<f8")
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _prepare(vectors: DataFrame, kind: str) -> DataFrame:
    """Row ids, and for vectors that can link their values, in the precision they come in, and a key of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows = []
            for v in batch.column(1).to_pylist():
                x = np.array([], kind) if v is None or any(c is None for c in v) else np.array(v, kind) + 0  # -0 is 0
                fine = len(x) > 0 and np.isfinite(x).all() and x.any()
                rows.append(x.tobytes() if fine else None)
            n = len(rows)
            columns = [pa.array(np.arange(made, made + n) + (task << 33)), batch.column(0), pa.array([None if r is None else xxhash.xxh3_128_digest(r) for r in rows], pa.binary()), pa.array(rows, pa.binary())]
            made += n
            yield pa.RecordBatch.from_arrays(columns, names=["rid", "vec_id", "key", "vec"])

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "rid long, vec_id long, key binary, vec binary")


def _codes(classes: DataFrame, first: int, passes: int, seed: int, kind: str) -> DataFrame:
    """A row a pass and class: (pass, dim, high, low, cid, vec); high and low are the halves of the code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.int64(1) << np.arange(_BITS - 1, -1, -1, dtype=np.int64)
        planes: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            vecs = batch.column(1).to_pylist()
            for size in sorted({len(v) for v in vecs}):
                own = [i for i, v in enumerate(vecs) if len(v) == size]
                x = _unit([vecs[i] for i in own], kind)
                if size not in planes:
                    planes[size] = [np.random.default_rng([seed, p]).standard_normal((x.shape[1], 2 * _BITS)) for p in range(first, first + passes)]
                part = batch.take(pa.array(own))
                for p, h in enumerate(planes[size]):
                    sign = (x @ h) > 0
                    same = [pa.array(np.full(len(own), v), pa.int32()) for v in (first + p, size)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(sign[:, :_BITS] @ weight), pa.array(sign[:, _BITS:] @ weight), part.column(0), part.column(1)], names=["pass", "dim", "high", "low", "cid", "vec"])

    return classes.select("cid", "vec").mapInArrow(run, "pass int, dim int, high long, low long, cid long, vec binary")


def shared_bits(codes: list[tuple[int, int]], other: tuple[int, int]) -> np.ndarray:
    """How many leading bits each code shares with another one."""
    high, low = other
    return np.array([_BITS - (a ^ high).bit_length() if a != high else 2 * _BITS - (b ^ low).bit_length() for a, b in codes])


def _blocks(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.Table]:
    """Runs of ``window`` rows of sorted batches, each of one pass and dimension."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        key = np.stack([batch.column("pass").to_numpy(), batch.column("dim").to_numpy()])
        cuts = [0, *(np.flatnonzero((np.diff(key) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            while begin < end:
                last = held[-1] if held else None
                if last is not None and (last.column("pass")[0], last.column("dim")[0]) != (batch.column("pass")[begin], batch.column("dim")[begin]):
                    yield pa.Table.from_batches(held)
                    held = []
                n = min(end - begin, window - sum(h.num_rows for h in held))
                held.append(batch.slice(begin, n))
                begin += n
                if sum(h.num_rows for h in held) == window:
                    yield pa.Table.from_batches(held)
                    held = []
    if held:
        yield pa.Table.from_batches(held)


class _Run:
    """A block of the order: its vectors, and what is known about each of them."""

    def __init__(self, table: pa.Table, kind: str):
        self.key = (table.column("pass")[0].as_py(), table.column("dim")[0].as_py())
        self.cid = table.column("cid").to_numpy()
        self.codes = list(zip(table.column("high").to_pylist(), table.column("low").to_pylist(), strict=True))
        self.x = _unit(table.column("vec").to_pylist(), kind)
        self.seen = np.zeros(len(self.cid), dtype=np.int64)  # neighbours compared, and linked
        self.near = np.zeros(len(self.cid), dtype=np.int64)


def _compare(a: _Run, b: _Run, threshold: float) -> list[tuple[int, int]]:
    """Links that connect all that the links between two blocks (or within one) connect."""
    hit = a.x @ b.x.T >= threshold
    if a is b:
        np.fill_diagonal(hit, False)
    a.seen += len(b.cid) - (a is b)
    a.near += hit.sum(axis=1)
    if a is not b:
        b.seen += len(a.cid)
        b.near += hit.sum(axis=0)
    left, right = np.nonzero(hit)
    if a is b:
        left, right = left[left < right], right[left < right]
    kept = forest(len(a.cid) + len(b.cid), left, right if a is b else right + len(a.cid))
    return list(zip(a.cid[left[kept]].tolist(), b.cid[right[kept]].tolist(), strict=True))


def _passes(window: int, threshold: float, kind: str):
    """Compares each block with itself and the next one: links (a, b), and for every vector (a, gain): minus the logarithm of what it may have missed."""
    agree = 1 - math.acos(min(1.0, threshold)) / math.pi

    def gains(before: _Run | None, run: _Run, after: _Run | None, starts: bool, ends: bool) -> np.ndarray:
        """``starts``, ``ends``: nothing of the pass is beyond the window on that side."""
        shared = np.full(len(run.cid), -1)
        if not starts:
            shared = np.maximum(shared, shared_bits(run.codes, (before or run).codes[0]))
        if not ends:
            shared = np.maximum(shared, shared_bits(run.codes, (after or run).codes[-1]))
        found = np.where(shared < 0, 1.0, agree ** (shared + 1.0))
        whole = (run.near == run.seen) & (run.seen > 0)
        return np.where((found >= 1) | whole, 1e9, -np.log1p(-np.minimum(found, 1 - 1e-12)))

    def rows(links: list[tuple[int, int]], run: _Run | None, gain: np.ndarray | None) -> pa.RecordBatch:
        a, b = zip(*links, strict=True) if links else ((), ())
        more = 0 if run is None else len(run.cid)
        return pa.RecordBatch.from_arrays([pa.array([*a, *(run.cid.tolist() if run else [])], pa.int64()), pa.array([*b, *[None] * more], pa.int64()), pa.array([*[None] * len(a), *(gain.tolist() if run else [])], pa.float64())], ["a", "b", "gain"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() == 0
        before = now = None
        began = False  # whether the pass began in this task, at the block before or at this one
        for table in _blocks(batches, window):
            new = _Run(table, kind)
            if now is None:
                began = first
            elif new.key != now.key:
                yield rows([], now, gains(before, now, None, began, True))
                before, began = None, True
            else:
                links = _compare(now, new, threshold)
                yield rows(links, now, gains(before, now, new, began, False))
                began = began and before is None
                before = now
            now = new
            yield rows(_compare(now, now, threshold), None, None)
        if now is not None:
            yield rows([], now, gains(before, now, None, began, False))

    return go


def find_links(reps: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, passes: int = PASSES, recall: float = RECALL, seed: int = 11, kind: str = "<f8", report: list[tuple[int, int]] | None = None) -> DataFrame:
    """(a, b): links that connect what all links between vectors (cid, vec) connect.

    ``report`` gets the number of vectors and the window of each round.
    """
    todo, n, first, found = reps, reps.count(), 0, []
    credit = reps.select("cid", F.lit(0.0).alias("gain")).where("false")
    while n > 1:
        if report is not None:
            report.append((n, window))
        tasks = max(1, round(n * passes / (window * WINDOWS_A_TASK)))
        order = ["pass", "dim", "high", "low", "cid"]
        sorted_ = _codes(todo, first, passes, seed, kind).repartitionByRange(tasks, *order).sortWithinPartitions(*order)
        seen = materialize(sorted_.mapInArrow(_passes(window, threshold, kind), "a long, b long, gain double"), "pass")
        found.append(seen.where("b is not null").select("a", "b"))
        if window >= 2 * n:  # the widest window there is
            break
        credit = credit.unionByName(seen.where("b is null").select(F.col("a").alias("cid"), "gain"))
        open_ = credit.groupBy("cid").agg(F.sum("gain").alias("gain")).where(F.col("gain") < -math.log(1 - recall))
        todo = materialize(reps.join(open_.select("cid"), "cid", "left_semi"), "open")
        credit = materialize(credit.join(open_.select("cid"), "cid", "left_semi").groupBy("cid").agg(F.sum("gain").alias("gain")), "credit")
        n, first, window = todo.count(), first + passes, 2 * window
    none = reps.sparkSession.createDataFrame([], "a long, b long")
    return reduce(DataFrame.unionByName, found, none)


def _tiles(rows: DataFrame, bucket: list[str], size: DataFrame, side: int) -> DataFrame:
    """Rows of each bucket dealt into blocks of about ``side``, once for each tile (ti, tj) they take part in."""
    dealt = rows.join(size.withColumn("nb", F.ceil(F.col("_n") / side).cast("int")), bucket)
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("nb")).cast("int"))
    tile = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return tile.withColumn("ti", F.least("block", "other")).withColumn("tj", F.greatest("block", "other"))


def _count(threshold: float, kind: str):
    """Links of each member with members of its component, between the two blocks of a tile."""

    def run(table: pa.Table) -> pa.Table:
        comp, block, i, j = (table.column(c).to_numpy() for c in ("component", "block", "ti", "tj"))
        cid, mult = table.column("cid").to_numpy(), table.column("mult").to_numpy()
        vecs = table.column("vec").to_pylist()
        out_id, out_n = [], []
        order = np.argsort(comp, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(comp[order])) + 1):
            x = _unit([vecs[k] for k in own], kind)
            left, right = own[block[own] == i[own]], own[block[own] == j[own]]
            a, b = x[block[own] == i[own]], x[block[own] == j[own]]
            hit = a @ b.T >= threshold
            if i[own[0]] == j[own[0]]:
                np.fill_diagonal(hit, False)
                out_id.append(cid[left])
                out_n.append(hit @ mult[right])
            else:
                out_id += [cid[left], cid[right]]
                out_n += [hit @ mult[right], hit.T @ mult[left]]
        return pa.table({"cid": np.concatenate(out_id), "n": np.concatenate(out_n).astype(np.int64)})

    return run


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, recall: float = RECALL, seed: int = 11, window: int = WINDOW, passes: int = PASSES) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row a row of ``vectors`` (vec_id, embedding).

    Vectors that are null, empty, zero, or hold null or non-finite numbers link with nothing and are
    their own component; so do vectors of different length among each other.  Equal vectors are one
    class: compared once, counted each.  Labels and other columns are not looked at.  Rows of
    equal vec_id are compared like any others.  component_id is the smallest vec_id of the component.
    """
    with scratch() as keep:
        return keep(_link_vectors(vectors, threshold, block, recall, seed, window, passes), "vector-links")


def _link_vectors(vectors: DataFrame, threshold: float, block: int, recall: float, seed: int, window: int, passes: int) -> DataFrame:
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"
    rows = materialize(_prepare(vectors, kind), "vectors")
    sizes = rows.where("key is not null").groupBy("key").agg(F.min("rid").alias("cid"), F.count("*").alias("mult"))
    sizes = materialize(sizes, "classes")
    reps = materialize(sizes.join(rows.select(F.col("rid").alias("cid"), "vec"), "cid").select("cid", "mult", "vec"), "representatives")
    n = reps.count()
    components = connected_components(find_links(reps, threshold, window, passes, recall, seed, kind))

    size = components.groupBy("component").agg(F.count("*").alias("_n"))
    member = components.join(reps.withColumnRenamed("cid", "node"), "node").select("component", F.col("node").alias("cid"), "mult", "vec")
    tile = _tiles(member, ["component"], size, block)
    small = F.pmod(F.xxhash64("component"), F.lit(max(1, n // 4096)))
    tile = tile.withColumn("deal", F.when(F.col("nb") == 1, -1 - small).otherwise(F.col("component")))
    links = tile.select("deal", "component", "ti", "tj", "block", "cid", "mult", "vec").groupBy("deal", "ti", "tj").applyInArrow(_count(threshold, kind), "cid long, n long")
    links = links.groupBy("cid").agg(F.sum("n").alias("n"))

    known = sizes.join(links, "cid", "left").join(components.select(F.col("node").alias("cid"), "component"), "cid", "left")
    known = known.select("key", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "cid").alias("group"))
    out = materialize(rows.select("rid", "vec_id", "key").join(known, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("group", "rid").alias("group")), "linked")
    least = out.groupBy("group").agg(F.min("vec_id").alias("component_id"))
    return out.join(least, "group").select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
