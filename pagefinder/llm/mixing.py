"""Mixing sources to target weights, in fixed-length blocks of words.

The words of each source are laid end to end and cut into blocks.  Weights give every source its target, which
stops at a multiple of what the source has; targets give whole passes over a source and a last one in part, and so its number of
slots.  The slots of the mix are dealt to output shards by multinomial draws of source counts; the k-th slot of a
source is a block of it by a pseudorandom permutation of its block indexes, and blocks are joined by index.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, scratch, with_rid
from .ordering import numbered, running

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of sources in code-point order, repeating; a source is taken so many times at most.
CYCLE, MOST_PASSES = (1, 2, 3), 3
BLOCK_WORDS, SHARD_SLOTS, SEED = 256, 4096, 2024
#: Sources that one draw deals to; more are drawn by groups first, then within each group.
FAN = 1024
#: Shards and rows whose running sums one task makes.
_RUN = 4096


def place_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(rid, doc_id, source, size, rank, before_size): rows of (rid, doc_id, text, source) in order of source, then pseudorandomly.

    The order is the documents' own, not that of files or tasks, so it is the same in every run.  Size is the number of words; only ids and sizes are sorted.
    """
    size = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    rows = docs.select("rid", F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size")).withColumn("_h", F.xxhash64(F.lit(seed), "doc_id"))
    return numbered(rows, [F.asc_nulls_last("source"), F.asc("_h"), F.asc("doc_id"), F.asc("size"), F.asc("rid")], ("size",), "placed").drop("_h")


def water_level(sources: DataFrame) -> float:
    """The level at which weight times level, stopped at each source's ``most``, adds up to all words.

    Each step shares by weight what the stopped sources leave over; it ends when no further source is stopped.  Three numbers a step come to the driver.
    """
    total, left, held, stopped = sources.agg(F.sum("source_size"), F.sum("weight"), F.lit(0), F.lit(0)).first()
    while True:
        level = (total - held) / left if left else math.inf
        over = F.col("weight") * F.lit(level) > F.col("most")
        now = sources.agg(F.coalesce(F.sum(F.when(over, F.col("most"))), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)), F.count_if(over)).first()
        if now[2] == stopped:
            return level
        held, left, stopped = now


def source_targets(placed: DataFrame, cycle: tuple[int, ...] = CYCLE, most_passes: int = MOST_PASSES, block: int = BLOCK_WORDS) -> DataFrame:
    """A row a source: sid (in code-point order, null last), first_word, source_size, weight, target, and what is taken of it.

    ``quota`` slots: ``passes`` whole passes over its ``blocks`` (the last one shorter unless ``tail`` is 0), and in a last pass slots up to the target, the last of them
    cut to ``last_words``.
    """
    sources = placed.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("before_size").alias("first_word"))
    sources = numbered(sources, [F.asc_nulls_last("source")], tag="sources").withColumnRenamed("rank", "sid")
    weight = F.get(F.array(*map(F.lit, cycle)), (F.col("sid") % len(cycle)).cast("int"))
    sources = sources.withColumn("weight", weight).withColumn("most", most_passes * F.col("source_size"))
    level = F.lit(water_level(sources)) if not sources.isEmpty() else F.lit(0.0)
    share = F.col("weight") * level
    out = sources.withColumn("target", F.when(share > F.col("most"), F.col("most").cast("double")).otherwise(share))
    out = out.withColumn("take", F.least(F.round("target").cast("long"), "most")).withColumn("full", F.expr(f"source_size div {block}")).withColumn("tail", F.col("source_size") % block)
    out = out.withColumn("blocks", F.col("full") + (F.col("tail") > 0).cast("int"))
    out = out.withColumn("passes", F.expr("coalesce(take div nullif(source_size, 0), 0)")).withColumn("rest", F.col("take") - F.col("passes") * F.col("source_size"))
    partly = F.least(F.expr(f"(rest + {block - 1}) div {block}"), "blocks")
    return out.withColumn("quota", F.col("passes") * F.col("blocks") + partly).withColumn("last_words", F.when(partly > 0, F.col("rest") - (partly - 1) * block)).drop("rest", "take")


def draw_counts(sources: DataFrame, slots: int, shard_slots: int = SHARD_SLOTS, fan: int = FAN, seed: int = SEED) -> DataFrame:
    """(shard, sid, n): for each output shard a multinomial draw of ``shard_slots`` slots over sources by quota.

    With more than ``fan`` sources a shard's slots are drawn for groups of sources first and then within each group, which is
    the same distribution; a row holds ``fan`` sources at most, so nothing grows with their number.
    """
    spark = sources.sparkSession
    shards = -(-slots // shard_slots)
    n = F.least(F.lit(shard_slots), F.lit(slots) - F.col("id") * shard_slots)
    out = spark.range(shards).select(F.col("id").alias("shard"), F.lit(0).cast("long").alias("node"), n.cast("long").alias("n"))
    top = sources.agg(F.max("sid")).first()[0] or 0
    levels = 1
    while fan**levels <= top:
        levels += 1

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, node, n, level, kids in zip(*(batch.column(c).to_pylist() for c in ("shard", "node", "n", "level", "kids")), strict=True):
                quota = np.array([k["quota"] for k in kids], dtype=np.float64)
                got = np.random.default_rng([seed, level, shard, node]).multinomial(n, quota / quota.sum())
                some = np.flatnonzero(got)
                child = np.array([k["child"] for k in kids])[some]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), shard)), pa.array(child), pa.array(got[some])], ["shard", "node", "n"])

    for level in reversed(range(levels)):
        child = sources.where("quota > 0").groupBy(F.expr(f"sid div {fan**level}").alias("child")).agg(F.sum("quota").alias("quota"))
        kids = child.groupBy(F.expr(f"child div {fan}").alias("node")).agg(F.sort_array(F.collect_list(F.struct("child", "quota"))).alias("kids"))
        out = out.join(kids, "node").select("shard", "node", "n", F.lit(level).alias("level"), "kids").mapInArrow(draw, "shard long, node long, n long")
    return out.withColumnRenamed("node", "sid")


def slot_ranges(counts: DataFrame, sources: DataFrame, slots: int, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """(shard, sid, first, n): which slots of each source every shard has; all of ``quota``, each once.

    The draws of a source add up to its quota only nearly.  What is beyond it is left out; what lacks goes to shards by hash.
    So sources are exact, and shards differ a little in length.
    """
    spread = running(counts, "sid", F.expr(f"shard div {_RUN}"), "shard", ("n",))
    quota = sources.select("sid", "quota")
    kept = spread.join(quota, "sid").select("shard", "sid", F.col("before_n").alias("first"), F.least(F.col("n"), F.col("quota") - F.col("before_n")).alias("n")).where("n > 0")
    drawn = counts.groupBy("sid").agg(F.sum("n").alias("drawn"))
    short = quota.join(drawn, "sid", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0))).where("drawn < quota")
    more = short.select("sid", F.explode(F.sequence("drawn", F.col("quota") - 1)).alias("first"))
    shards = -(-slots // shard_slots)
    more = more.select(F.pmod(F.xxhash64(F.lit(seed), "sid", "first"), F.lit(max(1, shards))).alias("shard"), "sid", "first", F.lit(1).cast("long").alias("n"))
    return kept.unionByName(more)


def _scramble(x: np.ndarray, key: int) -> np.ndarray:
    """64 well-mixed bits of integers and a key."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where a pseudorandom permutation of 0 .. n - 1 puts the given indexes, without making it as a whole.

    Four Feistel rounds permute the next even power of two; what falls outside goes through again until it is inside.
    """
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        a, b = x >> np.uint64(half), x & low
        for r in range(4):
            a, b = b, a ^ (_scramble(b, key * 4 + r & 0xFFFFFFFFFFFFFFFF) & low)
        out[todo] = (a << np.uint64(half)) | b
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


_SLOT_ROWS = 1 << 16


def slot_blocks(ranges: DataFrame, sources: DataFrame, block: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """(shard, sid, slot, block, words): which block fills each slot, and how many of its words are taken.

    Every pass goes over all blocks of a source in an order of its own; the shorter block at the end comes last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                for begin in range(r["first"], r["first"] + r["n"], _SLOT_ROWS):
                    slot = np.arange(begin, min(begin + _SLOT_ROWS, r["first"] + r["n"]))
                    turn, at = np.divmod(slot, r["blocks"])
                    for t in np.unique(turn).tolist():
                        mine = np.flatnonzero((turn == t) & (at < r["full"]))
                        at[mine] = permuted(at[mine], r["full"], int(_scramble(np.array([t], dtype=np.uint64), seed * 1_000_003 + r["sid"])[0] >> np.uint64(3)))
                    taken = np.where(at < r["full"], block, r["tail"])
                    if r["last_words"] is not None:
                        taken[slot == r["quota"] - 1] = r["last_words"]
                    same = lambda x: pa.array(np.full(len(slot), x))
                    yield pa.RecordBatch.from_arrays([same(r["shard"]), same(r["sid"]), pa.array(slot), pa.array(at), pa.array(taken)], ["shard", "sid", "slot", "block", "words"])

    known = ranges.join(sources.select("sid", "blocks", "full", "tail", "quota", "last_words"), "sid")
    return known.select("shard", "sid", "first", "n", "blocks", "full", "tail", "quota", "last_words").mapInArrow(run, "shard long, sid long, slot long, block long, words long")


def document_pieces(placed: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """(rank, sid, block, at, n): the words of each document by block; the piece begins at word ``at`` of the block and has ``n``.

    ``placed`` with sid and first_word.  A block has pieces of as many documents as it has words, at most.
    """
    start = F.col("before_size") - F.col("first_word")
    cut = placed.where("size > 0").select("rank", "sid", "size", start.alias("start"))
    cut = cut.select("*", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block"))
    begin, end = F.greatest(F.col("start"), F.col("block") * block), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    return cut.select("rank", "sid", "block", (begin - F.col("block") * block).alias("at"), (end - begin).alias("n"), (begin - F.col("start")).alias("from"))


def _with_source(placed: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents with their sources' figures; a hot source is split by adaptive execution, or sources are few and small, which is counted first."""
    count, size = sources.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("source")), F.lit(0))).first()
    few = F.broadcast(sources) if 100 * count + size <= 32 << 20 else sources.hint("merge")
    same = placed["source"].eqNullSafe(few["source"])
    return placed.join(few, same).drop(few["source"])


def _plan(rows: DataFrame, cycle: tuple[int, ...], most_passes: int, block: int, shard_slots: int, fan: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (placed, with their sources' figures), sources and the slots of the mix."""
    placed = place_documents(rows, seed)
    sources = materialize(source_targets(placed, cycle, most_passes, block), "targets")
    slots = sources.agg(F.sum("quota")).first()[0] or 0
    counts = materialize(draw_counts(sources, slots, shard_slots, fan, seed), "draws")
    filled = slot_blocks(slot_ranges(counts, sources, slots, shard_slots, seed), sources, block, seed)
    return _with_source(placed, sources), sources, filled


def mix(docs: DataFrame, cycle: tuple[int, ...] = CYCLE, most_passes: int = MOST_PASSES, block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, fan: int = FAN, seed: int = SEED) -> DataFrame:
    """What the mix takes of each row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, taken.

    Sources weigh ``cycle``, repeating, in code-point order with null last, and share all words; a target stops at ``most_passes`` times its source, and so does what
    is taken of any document.  Taken words of a source add up to its target, rounded.  Null and empty texts have no words and are taken 0
    times; a source without words has target 0.  Repeated rows are rows of their own.  Other columns are not read.  Results depend on the rows and the seed
    only, not on files or tasks.
    """
    with scratch() as keep:
        placed, sources, filled = _plan(docs.select(F.lit(0).cast("long").alias("rid"), "doc_id", "source", "text"), cycle, most_passes, block, shard_slots, fan, seed)
        whole = F.col("words") == F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
        uses = filled.join(sources.select("sid", "source_size"), "sid").groupBy("sid", "block").agg(F.count_if(whole).alias("wholes"), F.coalesce(F.max(F.when(~whole, F.col("words"))), F.lit(0)).alias("cut"))
        in_cut = F.greatest(F.lit(0), F.least(F.col("n"), F.col("cut") - F.col("at")))
        taken = document_pieces(placed, block).join(uses, ["sid", "block"]).groupBy("rank").agg(F.sum(F.col("wholes") * F.col("n") + in_cut).alias("taken"))
        out = placed.join(taken, "rank", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
        return keep(out, "mixed")


def mixed_blocks(docs: DataFrame, cycle: tuple[int, ...] = CYCLE, most_passes: int = MOST_PASSES, block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, fan: int = FAN, seed: int = SEED) -> DataFrame:
    """The mix itself: (shard, place, source, words, text), ``place`` from 0 in each shard in a pseudorandom order.

    Texts are cut to pieces where they are, and pieces joined to blocks of ``block`` words, and blocks to slots by index.  Words are joined by
    blanks.  Edge cases are those of ``mix``.
    """
    with scratch() as keep:
        rows = with_rid(docs)
        placed, sources, filled = _plan(rows.select("rid", "row.doc_id", "row.source", "row.text"), cycle, most_passes, block, shard_slots, fan, seed)
        cuts = document_pieces(placed, block).join(placed.select("rank", "rid"), "rank").groupBy("rid").agg(F.collect_list(F.struct("sid", "block", "at", "from", "n")).alias("cuts"))  # as many as a text has blocks
        words = F.regexp_extract_all(F.coalesce(F.col("row.text").cast("string"), F.lit("")), F.lit(WORD), F.lit(0))
        texts = rows.join(cuts, "rid").select("cuts", words.alias("w")).select(F.explode(F.transform("cuts", lambda c: F.struct(c["sid"].alias("sid"), c["block"].alias("block"), c["at"].alias("at"), F.slice(F.col("w"), (c["from"] + 1).cast("int"), c["n"].cast("int")).alias("w")))).alias("p")).select("p.*")
        blocks = texts.groupBy("sid", "block").agg(F.sort_array(F.collect_list(F.struct("at", "w"))).alias("p")).select("sid", "block", F.flatten(F.transform("p", lambda x: x["w"])).alias("w"))  # ``block`` words
        order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "sid", "slot"), "sid", "slot")  # about ``shard_slots`` rows
        out = filled.join(blocks, ["sid", "block"]).join(sources.select("sid", "source"), "sid").withColumn("place", F.row_number().over(order) - 1)
        return keep(out.select("shard", "place", "source", "words", F.array_join(F.slice("w", F.lit(1), F.col("words").cast("int")), " ").alias("text")), "mix")


def query(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
