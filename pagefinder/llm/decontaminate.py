"""Benchmark decontamination: a prefix-filtered set join of item windows with whole documents.

A window is ``window_words`` consecutive words of an item (all of a shorter one).  It is treated as
the set of its shingles (3 consecutive words; all words of a window shorter than that).
Containment needs every shingle, so the necessary prefix of a window is its single rarest shingle,
rarity being the number of documents of the whole corpus that hold it.  Documents are joined with
those prefixes only; a match must lie where the whole window fits into the document (positional and
length bounds) and is then verified word by word.

The benchmark is the side held in memory.  It is dealt into blocks of bounded bytes; a block is
all that is ever broadcast, and documents pass the blocks one after another, so a benchmark of any
size is joined in full.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, only_cache, slices, utf8, words

WINDOW_WORDS = 10
SHINGLE_WORDS = 3
#: Bytes of item texts in a block; a longer item has one of its own.
BLOCK_BYTES = 4_000_000
#: Candidate positions verified at once.
CHUNK = 200_000


#: A shingle's code is a 64-bit hash of its word ids; occurrences are verified word by word.
BASE, MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def _code(ids):
    """Of integers, or of arrays of uint64, which wrap round."""
    base = BASE if isinstance(ids[0], int) else np.uint64(BASE)
    out = ids[0]
    for x in ids[1:]:
        out = out * base + x
    return out * base + type(base)(len(ids))


@dataclass
class Block:
    """Windows of some items, and the index of their shingles."""

    vocabulary: dict[bytes, int]
    windows: np.ndarray  # word ids, a row a window, 0 after a shorter one
    lengths: np.ndarray
    items: list[list[str]]  # by window: ids of the items that have it
    codes: np.ndarray  # distinct shingle codes, ascending
    owner: np.ndarray  # by (window, shingle): window
    offset: np.ndarray  # place in the window
    code: np.ndarray  # index into codes

    @classmethod
    def build(cls, rows: list[tuple[str, bytes]], window_words: int) -> Block:
        vocabulary: dict[bytes, int] = {}
        seen: dict[tuple[int, ...], set[str]] = {}
        for item, text in rows:
            ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text)]
            for i in range(max(1, len(ids) - window_words + 1) if ids else 0):
                seen.setdefault(tuple(ids[i : i + window_words]), set()).add(item)
        windows = np.zeros((len(seen), window_words), dtype=np.int64)
        lengths = np.zeros(len(seen), dtype=np.int64)
        owner, offset, code = [], [], []
        for k, w in enumerate(seen):
            windows[k, : len(w)], lengths[k] = w, len(w)
            size = min(SHINGLE_WORDS, len(w))
            for i in range(len(w) - size + 1):
                owner.append(k)
                offset.append(i)
                code.append(_code(w[i : i + size]) & MASK)
        codes, at = np.unique(np.array(code, dtype=np.uint64), return_inverse=True)
        return cls(vocabulary, windows, lengths, [sorted(x) for x in seen.values()], codes, np.array(owner, dtype=np.int64), np.array(offset, dtype=np.int64), at.astype(np.int64))

    def prefixes(self, frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each window's rarest shingle: (code, window, offset), ascending by code."""
        order = np.lexsort((self.code, frequency[self.code], self.owner))
        first = order[np.unique(self.owner[order], return_index=True)[1]]
        first = first[np.argsort(self.code[first], kind="stable")]
        return self.code[first], self.owner[first], self.offset[first]

    def find(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word ids of all texts (0: not in the block, and after each text), each text's begin and
        end, and where known shingles lie: (position, index into codes)."""
        get = self.vocabulary.get
        ids: list[int] = []
        ends = []
        for t in texts:
            ids += [get(w, 0) for w in words(t)]
            ends.append(len(ids))
            ids += [0] * SHINGLE_WORDS
        a = np.array(ids, dtype=np.int64)
        end = np.array(ends, dtype=np.int64)
        begin = np.append(0, end[:-1] + SHINGLE_WORDS)
        n = max(0, len(a) - SHINGLE_WORDS + 1)
        here = np.flatnonzero(a[:n])
        position, index = [], []
        for size in range(1, SHINGLE_WORDS + 1):
            if size > 1:
                here = here[a[here + size - 1] > 0]
            if size < SHINGLE_WORDS and not (self.lengths == size).any():
                continue
            code = _code([a[here + j].astype(np.uint64) for j in range(size)])
            at = np.minimum(np.searchsorted(self.codes, code), max(0, len(self.codes) - 1))
            hit = self.codes[at] == code if len(self.codes) else np.zeros(len(here), bool)
            position.append(here[hit])
            index.append(at[hit])
        return a, begin, end, np.concatenate(position), np.concatenate(index)


def _frequency(docs: DataFrame, block) -> np.ndarray:
    """How many documents hold each shingle of the block; each task sends its sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache()
        b = block.value
        total = np.zeros(len(b.codes), dtype=np.int64)
        for batch in batches:
            texts = utf8(batch.column(0))
            for i, j in slices([len(t) for t in texts], 4_000_000):
                _, begin, _, position, index = b.find(texts[i:j])
                doc = np.searchsorted(begin, position, "right") - 1
                total += np.bincount(np.unique(doc * len(total) + index) % max(1, len(total)), minlength=len(total)) if len(total) else 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["code", "n"])

    out = np.zeros(len(block.value.codes), dtype=np.int64)
    rows = docs.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    out[rows.code.to_numpy(dtype=np.int64)] = rows.n.to_numpy()
    return out


def _bits(n: int, spans: list[tuple[int, int]], before: bytes) -> bytes:
    mask = np.unpackbits(np.frombuffer(before, np.uint8), count=n).astype(bool) if before else np.zeros(n, dtype=bool)
    for s, e in spans:
        mask[s:e] = True
    return np.packbits(mask).tobytes()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window_words: int = WINDOW_WORDS, block_bytes: int = BLOCK_BYTES, carry: bool = False) -> DataFrame:
    """A row a row of ``docs``: doc_id, text, n_words, hit_bits (binary: the words inside an
    occurrence of a window, one bit a word, big bit first; null if none), n_hit, items (array of
    the ids, as strings in order, of the items with an occurring window).

    Null and empty texts have no words and no hits; a null or wordless item matches nothing; an
    item id that repeats counts once, and so do equal items, which are made distinct before any come to the driver; a null item id is named ``null``.  Rows of equal doc_id are
    judged apart.  Other columns are not looked at; with ``carry`` a struct ``row`` holds them all.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = 1 if total <= block_bytes else -(-2 * total // block_bytes)
    now = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("binary").alias("hit_bits"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"), *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []))
    for k in range(n_blocks):
        part = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == k)
        rows = sorted((r.item, r.text.encode()) for r in part.toLocalIterator())
        block = spark.sparkContext.broadcast(Block.build(rows, window_words))
        prefix = spark.sparkContext.broadcast(block.value.prefixes(_frequency(docs, block)))
        before, now = now, now.mapInArrow(_joiner(block, prefix), now.schema)
        if k + 1 < n_blocks:
            now = materialize(now, "decontaminate")
            discard(before)
    return now


def _joiner(block, prefix):
    def verified(a, begin, end, position, index):
        """Occurrences (text, begin in the text, window) of whole windows."""
        b, (code, window, offset) = block.value, prefix.value
        lo, hi = np.searchsorted(code, index, "left"), np.searchsorted(code, index, "right")
        some = np.flatnonzero(hi > lo)
        position, lo, n = position[some], lo[some], (hi - lo)[some]
        found = []
        for i, j in slices(n.tolist(), CHUNK):
            k = n[i:j]
            row = np.repeat(lo[i:j], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            at, w = np.repeat(position[i:j], k), window[row]
            doc = np.searchsorted(begin, at, "right") - 1
            start = at - offset[row]
            fits = (start >= begin[doc]) & (start + b.lengths[w] <= end[doc])
            doc, start, w = doc[fits], start[fits], w[fits]
            same = np.ones(len(w), dtype=bool)
            for c in range(b.windows.shape[1]):
                same &= (b.windows[w, c] == 0) | (a[np.minimum(start + c, len(a) - 1)] == b.windows[w, c])
            found.append(np.stack([doc[same], start[same], w[same]]))
        return np.concatenate(found, axis=1) if found else np.zeros((3, 0), dtype=np.int64)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache()
        b = block.value
        for batch in batches:
            texts = utf8(batch.column(1))
            for i, j in slices([len(t) for t in texts], 4_000_000):
                part = batch.slice(i, j - i)
                a, begin, end, position, index = b.find(texts[i:j])
                doc, start, w = verified(a, begin, end, position, index)
                bits, n_hit, items = (part.column(c).to_pylist() for c in (3, 4, 5))
                cut = np.searchsorted(doc[order := np.argsort(doc, kind="stable")], np.arange(j - i + 1))
                for d in np.unique(doc).tolist():
                    own = order[cut[d] : cut[d + 1]]
                    s = start[own] - begin[d]
                    bits[d] = _bits(int(end[d] - begin[d]), np.unique(np.stack([s, s + b.lengths[w[own]]], 1), axis=0).tolist(), bits[d])
                    n_hit[d] = int(np.unpackbits(np.frombuffer(bits[d], np.uint8)).sum())
                    items[d] = sorted({*items[d], *(x for k in np.unique(w[own]).tolist() for x in b.items[k])})
                columns = [part.column(0), part.column(1), pa.array(end - begin, pa.int64()), pa.array(bits, pa.binary()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), *(part.column(c) for c in range(6, part.num_columns))]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return join


def without_hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark, with all their columns; no join.

    Null and empty texts stay; equal rows stay or go alike; columns may have any names, as they are carried in a struct.
    """
    return decontaminate(docs, benchmark, carry=True).where("n_hit = 0").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window_words: int = WINDOW_WORDS) -> dict[int, tuple]:
    """The contract, word by word, for tests."""
    import re

    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = []
    for item, text in items:
        w = cut(text)
        windows += [(str(item), w[i : i + window_words]) for i in range(max(1, len(w) - window_words + 1) if w else 0)]
    out = {}
    for doc, text in docs:
        ws, hit, ids = cut(text), set(), set()
        for item, w in windows:
            for i in range(len(ws) - len(w) + 1):
                if ws[i : i + len(w)] == w:
                    hit |= set(range(i, i + len(w)))
                    ids.add(item)
        out[doc] = (len(ws), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    return out
