"""Sharding along a Hilbert curve over metadata, with DataFrame functions only.

Metadata dimensions are quantised to ``bits`` bits each and mapped to their index on a Hilbert
curve; runs of the curve become shards, so a shard covers a compact box in every dimension and
files prune on any of them.  Only metadata is shuffled, never the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, partitions, with_rid

SHARDS = 24
BITS = 5


def hilbert_table(n: int) -> tuple[list[int], list[int]]:
    """The curve in ``n`` dimensions as a finite automaton.

    For state s and the point's next bit of each dimension as a label of n bits, entry s * 2**n + label
    of the two lists has the next digit of the index and the next state.  A state is an entry
    corner and a direction; within it corners are visited in Gray-code order.
    """
    side = 1 << n
    turn = lambda b, k: ((b << k % n) | (b >> (n - k % n))) & (side - 1)
    gray = lambda i: i ^ (i >> 1)
    place = {gray(i): i for i in range(side)}
    ones = lambda i: (~i & (i + 1)).bit_length() - 1
    entry = lambda i: 0 if i == 0 else gray(2 * ((i - 1) // 2))
    axis = lambda i: 0 if i == 0 else (ones(i - 1) if i % 2 == 0 else ones(i)) % n
    states = {(0, 0): 0}
    digit, following = [], []
    todo = [(0, 0)]
    for corner, d in todo:
        for label in range(side):
            w = place[turn(label ^ corner, n - (d + 1) % n)]
            after = (corner ^ turn(entry(w), d + 1), (d + axis(w) + 1) % n)
            if after not in states:
                states[after] = len(states)
                todo.append(after)
            digit.append(w)
            following.append(states[after])
    return digit, following


def hilbert_index(dims: list[Column], bits: int = BITS) -> Column:
    """Index on the curve (long) of integer columns in 0 .. 2**bits - 1; at most 62 bits in all."""
    n = len(dims)
    if n * bits > 62:
        raise ValueError("too many bits for a long")
    digit, following = hilbert_table(n)
    digits, states = F.array(*map(F.lit, digit)), F.array(*map(F.lit, following))
    start = F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).alias("s"))

    def step(acc: Column, b: Column) -> Column:
        label = F.lit(0)
        for k, d in enumerate(dims):
            bit = F.getbit(d.cast("long"), b).cast("int")
            label = label + bit * F.lit(1 << k)
        at = acc["s"] * F.lit(1 << n) + label
        return F.struct((acc["i"] * F.lit(1 << n) + F.get(digits, at).cast("long")).alias("i"), F.get(states, at).alias("s"))

    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda acc: acc["i"])


def metadata_dims(bits: int = BITS) -> list[Column]:
    """Three dimensions: size on a logarithmic scale, source and language by hash; null is a value of its own."""
    top = (1 << bits) - 1
    size = F.least(F.floor(F.log2(F.col("size").cast("double")) * F.lit(top / 31.0)), F.lit(top)).cast("int")  # up to 2 GB, the longest a value can be
    code = lambda c: F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("\x00null"))), F.lit(top + 1)).cast("int")
    return [size, code("source"), code("lang")]


def assign_shards(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """A row a row: doc_id, size, text_crc32, curve (index), rank (place on the curve), shard, slot.

    Law ``rows``: row r of n along the curve goes to shard r * shards / n, so counts differ by one at
    most.  Ties on the curve are put in order of text_crc32 and doc_id, which keeps equal texts with equal
    metadata together; rows equal in all of these take each other's places.  Null text: size 8 and crc 0;
    a null doc_id comes first.  Any number of equal rows is fine: the order is total up to equal rows,
    and a hot value is cut between range partitions at the next key.
    """
    return _assign(docs.select(F.lit(0).cast("long").alias("rid"), "doc_id", "text", "source", "lang"), shards, bits).drop("rid")


def _assign(docs: DataFrame, shards: int, bits: int) -> DataFrame:
    """``assign_shards`` for rows under a ``rid`` each, which it carries along."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select("rid", F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), F.col("lang"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.select("rid", "doc_id", "size", "text_crc32", hilbert_index(metadata_dims(bits), bits).alias("curve"))
    order = ["curve", "text_crc32", "doc_id", "size"]
    ranged = rows.repartitionByRange(partitions(docs.sparkSession), *order).withColumn("_p", F.spark_partition_id())
    ranged = materialize(ranged, "curve")  # fixes which partition each row is in
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"))  # a row a partition
    before = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    ranked = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1).join(F.broadcast(before), "_p")
    ranked = ranked.withColumn("rank", F.col("_r") + F.col("_before")).withColumn("shard", F.expr(f"cast(rank * {shards} div _all as int)"))
    return ranked.select("rid", "doc_id", "size", "text_crc32", "curve", "rank", "shard", F.expr(f"rank - (shard * _all + {shards - 1}) div {shards}").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, bits: int = BITS) -> str:
    """Writes every row and column of the documents, one folder a shard, rows in slot order for file pruning.

    Returns the name of the folders' column: ``shard``, or if the documents have a column of that name, ``shard_``
    (and so on).  Rows are joined with their shards by an id given when they are first written, so repeated and
    null doc_ids, equal rows and null texts stay as many as they were.
    """
    rows = with_rid(docs)
    where = materialize(_assign(rows.select("rid", "row.doc_id", "row.text", "row.source", "row.lang"), shards, bits).select("rid", "shard", "slot"), "slots")
    name = "shard"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    out = rows.join(where, "rid").repartitionByRange(partitions(docs.sparkSession), "shard", "slot").sortWithinPartitions("shard", "slot")
    out.select("row.*", F.col("shard").alias(name)).write.partitionBy(name).parquet(path)
    discard(rows, where)
    return name


def query(spark, sf_dir: str) -> DataFrame:
    out = assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve", "rank")
