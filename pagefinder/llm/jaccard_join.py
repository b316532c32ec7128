"""N-gram Jaccard join by a MinHash LSH forest and exact verification.

Texts are sets of their 5-word shingles.  A signature has ``TREES`` labels of ``DEPTH`` MinHash values
(8 bits each, 64 bits in all); ordered by value, the labels of a tree are a prefix trie, whose nodes
are the texts that agree in a prefix.  Matching starts at whole labels.  Then prefixes are shortened a
value at a time: a node that has nothing but one component's texts is done, and texts meet others
only in nodes that still hold several.  Shortening ends where, for a pair at the threshold, the
chance of sharing a node in some tree reaches the target recall.

Texts of a node are verified exactly before they are united (``verify``): with the node's hub first, and
in tiles where that leaves several components, so unlike texts never chain.  Equal sets are one class
and compared once.  Links are then counted between all classes of a component, in tiles of bounded
size that return sums, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import caches, discard, lengths, materialize, only_cache, sized_broadcast, slices, utf8, with_rid, words
from .verify import once, overlaps, tiles, unite_groups

NGRAM = 5
THRESHOLD = 0.8
TREES, DEPTH = 20, 8
RECALL = 0.99
#: Classes of a cluster in one side of a tile.
TILE = 1024
#: A worker forgets word hashes beyond this many.
MOST_WORDS = 400_000
_SEED = np.random.default_rng(2024)
_A = (_SEED.integers(1, 1 << 31, TREES * DEPTH, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _SEED.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_words = _Words()


def _forget() -> bool:
    some = len(_words) > 0
    _words.clear()
    return some


caches["words"] = _forget


def shingles(text: bytes, n: int = NGRAM) -> np.ndarray:
    """Distinct 64-bit hashes, ascending, of a text's runs of ``n`` words (all of a shorter text)."""
    ws = words(text)
    if len(_words) > MOST_WORDS:
        _words.clear()
    h = np.fromiter(map(_words.__getitem__, ws), np.uint64, len(ws))
    n = min(n, len(h))
    if not n:
        return h
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out += h[k : len(h) - n + 1 + k]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def labels(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``TREES`` labels (int64) for each set, none empty: first values in the highest bits."""
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.zeros((len(sets), TREES), np.uint64)
    buffer = np.empty_like(x)
    for k in range(TREES * DEPTH):
        np.multiply(x, _A[k], out=buffer)
        np.add(buffer, _B[k], out=buffer)
        least = np.minimum.reduceat(buffer, starts)
        least = (least ^ (least >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        t = k // DEPTH
        out[:, t] = (out[:, t] << np.uint64(8)) | (least >> np.uint32(24)).astype(np.uint64)
    return out.view(np.int64)


def prefix_length(threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """Shortens the prefix from ``depth`` until a pair at the threshold is met with the target recall."""
    d = depth
    while d > 1 and 1 - (1 - threshold**d) ** trees < recall:
        d -= 1
    return d


def _signatures(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, t, key, labels) of (rid, doc_id, text); t: hash of the text, key: digest of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache("words")
        for batch in batches:
            for i, j in slices(lengths(batch.column(3)), 1_000_000):
                sets = [shingles(t) for t in utf8(batch.column(3).slice(i, j - i))]
                some = [k for k, s in enumerate(sets) if len(s)]
                label: list[list[int] | None] = [None] * (j - i)
                if some:
                    for k, row in zip(some, labels([sets[k] for k in some]).tolist(), strict=True):
                        label[k] = row
                own = [batch.column(c).slice(i, j - i) for c in range(3)]
                keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([*own, pa.array(keys, pa.binary()), pa.array(label, pa.list_(pa.int64()))], names=["rid", "doc_id", "t", "key", "labels"])

    text = F.col("text").cast("string")
    return docs.select("rid", F.col("doc_id").cast("long"), F.xxhash64(text).alias("t"), text).mapInArrow(run, "rid long, doc_id long, t long, key binary, labels array<long>")


def _sets(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(cid, item) of classes, items being shingle sets, read again from the text (doc_id, t) of one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache("words")
        for batch in batches:
            for i, j in slices(lengths(batch.column(1)), 1_000_000):
                sets = [shingles(t).tobytes() for t in utf8(batch.column(1).slice(i, j - i))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sets, pa.binary())], names=["cid", "item"])

    texts = docs.select(F.col("doc_id").cast("long").alias("_d"), F.col("text").cast("string").alias("text")).withColumn("_t", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("t") == F.col("_t"))
    return texts.join(sized_broadcast(materialize(places, "places")), same).select("cid", "text").mapInArrow(run, "cid long, item binary")


def _count(threshold: float):
    """Links of each class with classes of its component, between the two blocks of a tile."""

    def run(table: pa.Table) -> pa.Table:
        comp, block, ti, tj, cid, mult = (table.column(c).to_numpy() for c in ("c", "block", "ti", "tj", "cid", "mult"))
        sets = [np.frombuffer(x, np.uint64) for x in table.column("item").to_pylist()]
        ids, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        order = np.argsort(comp, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(comp[order])) + 1):
            left, right = np.flatnonzero(block[own] == ti[own]), np.flatnonzero(block[own] == tj[own])
            if not len(left) or not len(right):
                continue
            size = np.array([len(sets[k]) for k in own], np.float64)
            both = overlaps([sets[k] for k in own], left, right).astype(np.float64)
            hit = both >= threshold * (size[left][:, None] + size[right][None] - both)
            if ti[own[0]] == tj[own[0]]:
                np.fill_diagonal(hit, False)
            else:
                ids.append(cid[own][right])
                counts.append(hit.T @ mult[own][left])
            ids.append(cid[own][left])
            counts.append(hit @ mult[own][right])
        return pa.table({"cid": np.concatenate(ids), "n": np.concatenate(counts).astype(np.int64)})

    return run


def _jaccard(docs: DataFrame, threshold: float, recall: float, tile: int) -> DataFrame:
    """``jaccard_classes`` for (rid, doc_id, text), with rid."""
    rows = materialize(_signatures(docs), "signatures")
    classes = materialize(rows.where("key is not null").groupBy("key").agg(F.min("rid").alias("cid"), F.count("*").alias("mult")), "classes")
    reps = classes.join(rows.select(F.col("rid").alias("cid"), "doc_id", "t", "labels"), "cid")
    least = prefix_length(threshold, recall)
    node = lambda d: F.xxhash64("tree", F.shiftrightunsigned("label", 64 - 8 * d))
    leaves = materialize(reps.select("cid", F.posexplode("labels").alias("tree", "label")).withColumn("key", node(least)), "labels")
    shared = materialize(leaves.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "nodes")
    trie = materialize(leaves.join(sized_broadcast(shared), "key", "left_semi").select("tree", "label", "cid"), "trie")
    members = materialize(trie.select("cid").distinct(), "members")
    places = rows.select(F.col("rid").alias("cid"), "doc_id", "t").join(sized_broadcast(members), "cid", "left_semi")
    sets = once(_sets(docs, places), members)
    near = None
    for d in range(DEPTH, least - 1, -1):
        nodes = trie.select(node(d).alias("key"), "cid")
        held = materialize(nodes.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "nodes")
        near = unite_groups(materialize(nodes.join(sized_broadcast(held), "key", "left_semi"), "trie-nodes"), sets, threshold, near, tile)
    discard(leaves, shared, members)

    linked = near.join(classes.select("cid", "mult"), "cid").join(sets, "cid")
    size = materialize(near.groupBy("c").agg(F.count("*").alias("n")).where("n > 1"), "component-sizes")
    dealt = tiles(linked, "c", size, tile)
    small = F.pmod(F.xxhash64("c"), F.lit(max(1, (size.agg(F.sum("n")).first()[0] or 0) // 4096)))
    deal = F.when(F.col("nb") == 1, -1 - small).otherwise(F.col("c"))
    links = dealt.select(deal.alias("deal"), "c", "block", "ti", "tj", "cid", "mult", "item").groupBy("deal", "ti", "tj").applyInArrow(_count(threshold), "cid long, n long")
    links = materialize(links.groupBy("cid").agg(F.sum("n").alias("n")), "links")
    discard(sets)

    known = classes.join(links, "cid", "left").join(near, "cid", "left")
    known = known.select("key", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("c", "cid").alias("group"))
    out = rows.select("rid", "doc_id", "key").join(known, "key", "left")
    out = materialize(out.select("rid", "doc_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("group", "rid").alias("group")), "classed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("i"), "doc_id", "rid")).alias("k")
    keep = out.groupBy("group").agg(first).select("group", F.col("k.rid").alias("kr"), F.col("k.doc_id").alias("class_id"))
    return out.join(keep, "group").select("rid", "doc_id", "class_id", "n_links", (F.col("rid") == F.col("kr")).alias("kept"))


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, tile: int = TILE) -> DataFrame:
    """(doc_id, class_id, n_links, kept), a row a row of ``docs``.

    Links join texts whose shingle sets have a Jaccard similarity of ``threshold`` or more; class_id
    is the smallest doc_id reachable by links (null if all are null) and n_links the number of rows
    linked directly, copies included.  Null texts and texts without words link with nothing.  Texts of
    fewer than 5 words have one shingle; long ones are compared whole.  kept: true for one row of each
    class, the first by doc_id, null last; of rows of equal doc_id just one.  Rows are told apart
    by an id of their own, so repeated and null doc_ids do no harm.  Sets are compared by 64-bit hashes.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    return _jaccard(numbered, threshold, recall, tile).drop("rid")


def one_of_each_class(docs: DataFrame) -> DataFrame:
    """One row of each class, the one ``jaccard_classes`` keeps, with all its columns.

    Rows go by an id given when they are written: a row never goes for another's sake that has its
    doc_id, and columns of any name do no harm.
    """
    rows = with_rid(docs)
    gone = materialize(_jaccard(rows.select("rid", "row.doc_id", "row.text"), THRESHOLD, RECALL, TILE).where("not kept").select("rid"), "gone")
    return rows.join(sized_broadcast(gone), "rid", "left_anti").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def brute_force(docs: list[tuple[int, str | None]], threshold: float = THRESHOLD) -> dict[int, tuple[int, int]]:
    """(class_id, n_links) by comparing all pairs of word-tuple sets, for tests."""
    sets = {}
    for d, t in docs:
        ws = words((t or "").encode())
        n = min(NGRAM, len(ws))
        sets[d] = {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if n else set()
    ids = sorted(sets)
    near = {d: {d} for d in ids}
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold:
                near[a].add(b)
                near[b].add(a)
    out, seen = {}, set()
    for d in ids:
        if d not in seen:
            todo, group = [d], {d}
            while todo:
                for x in near[todo.pop()] - group:
                    group.add(x)
                    todo.append(x)
            seen |= group
            out |= {x: (d, len(near[x]) - 1) for x in group}
    return out
