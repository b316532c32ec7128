"""Token ids on disk as directly addressable codes (DACs).

A segment holds the ids of consecutive documents.  Each id is cut into chunks of ``chunk_bits``
bits, lowest first; level k holds the k-th chunk of all ids that have one, and a bitmap tells which
go on at level k + 1.  A rank directory (set bits before each block of 512) gives the place at the
next level, so any id is read by a few array accesses, without decoding its neighbours.

Layout, little-endian: ``DAC1``, u8 chunk_bits, u8 levels, u16 0, u64 ids; then for each level: u64
chunks, the chunks (one byte each), and but for the last level the bitmap (u64 words) and the rank
directory (u64 a block).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import lengths, materialize, only_cache, partitions, slices

MAGIC = b"DAC1"
BLOCK = 512
#: Ids in a segment; a longer document has one of its own.
SEGMENT_IDS = 1_000_000
SEGMENTS = "part int, segment int, part_start long, n_ids long, doc_ids binary, missing binary, n_tokens binary, payload binary"


def encode(ids: np.ndarray, chunk_bits: int = 8) -> bytes:
    """A segment's bytes for unsigned ids; chunks have 1 to 8 bits."""
    if not 1 <= chunk_bits <= 8:
        raise ValueError("chunk_bits is 1 to 8")
    rest = ids.astype(np.uint64)
    levels = max(1, -(-int(rest.max(initial=0)).bit_length() // chunk_bits))
    out = [MAGIC, struct.pack("<BBHQ", chunk_bits, levels, 0, len(ids))]
    for k in range(levels):
        out += [struct.pack("<Q", len(rest)), (rest & np.uint64((1 << chunk_bits) - 1)).astype(np.uint8).tobytes()]
        if k + 1 < levels:
            rest = rest >> np.uint64(chunk_bits)
            more = rest > 0
            bits = np.packbits(more, bitorder="little")
            bits = np.pad(bits, (0, -len(bits) % (BLOCK // 8)))
            per_block = np.bitwise_count(bits.view("<u8")).reshape(-1, BLOCK // 64).sum(1).astype("<u8")
            out += [bits.tobytes(), (np.cumsum(per_block) - per_block).astype("<u8").tobytes()]
            rest = rest[more]
    return b"".join(out)


class Segment:
    """Reads a segment: ``seg[i]`` one id, ``seg.decode(i, j)`` a run, ``len(seg)`` how many."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a DAC segment")
        self.bits, self.n_levels, _, self.n = struct.unpack_from("<BBHQ", data, 4)
        at, self.levels = 16, []
        for k in range(self.n_levels):
            (m,) = struct.unpack_from("<Q", data, at)
            chunks = np.frombuffer(data, np.uint8, m, at + 8)
            at += 8 + m
            if k + 1 < self.n_levels:
                blocks = -(-m // BLOCK)
                bitmap = np.frombuffer(data, np.uint8, blocks * BLOCK // 8, at)
                ranks = np.frombuffer(data, "<u8", blocks, at + len(bitmap))
                at += len(bitmap) + 8 * blocks
                self.levels.append((chunks, bitmap, ranks))
            else:
                self.levels.append((chunks, None, None))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (chunks, bitmap, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << k * self.bits
            if bitmap is None or not bitmap[i >> 3] >> (i & 7) & 1:
                break
            i = self._rank(bitmap, ranks, i)
        return value

    @staticmethod
    def _rank(bitmap: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Set bits before place i."""
        b = i // BLOCK
        before = bitmap[b * BLOCK // 8 : i >> 3]
        return int(ranks[b]) + int(np.bitwise_count(before).sum()) + int(bitmap[i >> 3] & ((1 << (i & 7)) - 1)).bit_count() if i % BLOCK else int(ranks[b])

    def decode(self, i: int = 0, j: int | None = None) -> np.ndarray:
        """Ids i to j as uint32: each level's run begins where the rank directory says."""
        j = self.n if j is None else j
        out = np.zeros(max(0, j - i), dtype=np.uint32)
        at = np.arange(len(out))
        for k, (chunks, bitmap, ranks) in enumerate(self.levels):
            if not len(at):
                break
            out[at] |= chunks[i:j].astype(np.uint32) << np.uint32(k * self.bits)
            if bitmap is None:
                break
            more = np.unpackbits(bitmap[i >> 3 : (j + 7) >> 3], bitorder="little")[i & 7 :][: j - i].astype(bool)
            i = self._rank(bitmap, ranks, i)
            at = at[more]
            j = i + len(at)
        return out


def write(docs: DataFrame, end_id: int = 1, vocabulary: str | None = None, segment_ids: int = SEGMENT_IDS, chunk_bits: int = 8) -> DataFrame:
    """Encodes whole texts, appends ``end_id`` to each, and stores segments in ascending doc_id order.

    The table of segments (schema ``SEGMENTS``) is written by Spark's committed writer into the
    shared folder, so lost executors and retried tasks leave no half-written file.  Documents are
    range-partitioned by doc_id and streamed in order; a segment is all that a task holds.
    A null doc_id comes first; rows of equal doc_id stand next to each other, however many.  Null text: empty; a very
    long text is encoded whole and has a segment of its own.  Rows of equal id are in order of their text's hash; other columns are not read; an empty table has no segments.
    Payloads are stored as they are, uncompressed, so that ``token`` reads a segment without decoding a block.
    """
    spark = docs.sparkSession
    key = F.col("doc_id").cast("long").alias("doc_id")
    order = ["doc_id", "digest"]  # equal ids, null ones say, spread over partitions too
    ordered = docs.select(key, F.col("text").cast("string").alias("text")).withColumn("digest", F.xxhash64("text"))
    ordered = ordered.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache("pieces")
        part, segment, start = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal segment, start, held, size
            ids = np.frombuffer(b"".join(x for _, x in held), "<u4")
            docs_, n = np.array([d or 0 for d, _ in held], "<i8"), np.array([len(x) // 4 for _, x in held], "<i8")
            missing = np.packbits([d is None for d, _ in held]).tobytes()
            row = [[part], [segment], [start], [len(ids)], [docs_.tobytes()], [missing], [n.tobytes()], [encode(ids, chunk_bits)]]
            segment, start, held, size = segment + 1, start + len(ids), [], 0
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], names=names)

        end = np.uint32(end_id).tobytes()
        for batch in batches:
            for i, j in slices(lengths(batch.column(1)), 2_000_000):
                ids, texts = (batch.column(c).slice(i, j - i).to_pylist() for c in (0, 1))
                for doc, raw in zip(ids, encoder(vocabulary).encode(texts), strict=True):
                    if held and size + len(raw) + 4 > 4 * segment_ids:
                        yield flush()
                    held.append((doc, raw + end))
                    size += len(raw) + 4
        if held:
            yield flush()

    names = [x.split()[0] for x in SEGMENTS.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    return materialize(ordered.mapInArrow(run, SEGMENTS), "tokens", "none")


def token(segments: DataFrame, position: int) -> int:
    """The id at a place of the whole store, counted from 0: one segment is fetched, and one id read in it."""
    rest = position
    for part, n in _totals(segments) if position >= 0 else []:
        if rest < n:
            row = segments.where((F.col("part") == part) & (F.col("part_start") <= rest) & (F.col("part_start") + F.col("n_ids") > rest)).select("part_start", "payload").first()
            return Segment(row.payload)[rest - row.part_start]
        rest -= n
    raise IndexError(position)


def _totals(segments: DataFrame) -> list[tuple[int, int]]:
    """Ids of each part, a row a partition, in order."""
    return sorted((r.part, r.n) for r in segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())


def read(segments: DataFrame, with_ids: bool = True) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32, ids)`` from stored segments; ids: little-endian u32 bytes,
    left out if not asked for.

    Only the id total of each part, a row a partition, comes to the driver.
    """
    spark = segments.sparkSession
    offsets, total = {}, 0
    for part, n in _totals(segments):
        offsets[part], total = total, total + n
    shared = spark.sparkContext.broadcast(offsets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                part, _, start, _, docs_, missing, n, payload = (batch.column(c)[r].as_py() for c in range(8))
                raw = Segment(payload).decode().astype("<u4").tobytes()
                n = np.frombuffer(n, "<i8")
                ends = np.cumsum(n)
                none = np.unpackbits(np.frombuffer(missing, np.uint8), count=len(n)).astype(bool)
                own = [raw[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(docs_, "<i8"), mask=none), pa.array(ends - n + start + shared.value[part]), pa.array(n), pa.array([zlib.crc32(x) for x in own], pa.int64()), *([pa.array(own, pa.binary())] if with_ids else [])],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 5 if with_ids else 4],
                )

    return segments.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def query(spark, sf_dir: str) -> DataFrame:
    return read(write(spark.read.parquet(f"{sf_dir}/documents.parquet")), with_ids=False)
