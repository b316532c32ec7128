"""Importance resampling towards a target text, by hashed n-gram buckets.

A document's weight is the sum, over its n-grams, of how much likelier their bucket is in the target than
in the corpus; Gumbel noise makes the best weights a random draw without replacement.  N-grams are strings until the
dictionary of distinct ones is made: each is hashed once, there, and its bucket's gain is joined
back to the counts of the documents.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_TABLE, lengths, materialize, only_cache, scratch, slices, utf8, words
from .ordering import numbered

BUCKETS, SHORTEST, LONGEST = 10_000, 1, 1
SEED, PERCENT, LEAST_WORDS = 2024, 10, 20
#: Bytes of text whose n-grams are counted together, with as many documents as two bytes can tell apart at most; pieces that a longer text is cut into.
SLICE_BYTES, SLICE_DOCS, PIECE_BYTES = 16 << 20, 60_000, 4 << 20

_COUNTS = pa.schema([("batch", pa.int64()), ("feature", pa.binary()), ("total", pa.int64()), ("places", pa.binary()), ("docs", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())), ("words", pa.list_(pa.int64()))])
_COUNTS_SQL = "batch long, feature binary, total long, places binary, docs array<long>, n array<long>, words array<long>"


def _pieces(text: bytes, most: int) -> Iterator[list[bytes]]:
    """Words of a text, piece by piece, so that a very long one is never a list as a whole."""
    begin = 0
    while len(text) - begin > most:
        end = begin + most
        while end < len(text) and WORD_TABLE[text[end]] != 0x20:
            end += 1
        yield words(text[begin:end])
        begin = end
    yield words(text[begin:])


def features(text: bytes, low: int, high: int, most: int = PIECE_BYTES) -> Iterator[Iterator[bytes]]:
    """Runs of ``low`` to ``high`` consecutive words, joined by a blank; repeats included."""
    last: list[bytes] = []  # words that runs of the next piece may begin with
    for piece in _pieces(text, most):
        both = last + piece
        for n in range(low, high + 1):
            begin = max(0, len(last) - n + 1)
            if n == 1:
                yield iter(piece)
            else:
                yield map(b" ".join, zip(*(islice(both, begin + k, None) for k in range(n)), strict=False))
        last = both[len(both) - high + 1 :] if high > 1 else []


def feature_counts(docs: DataFrame, low: int = SHORTEST, high: int = LONGEST) -> DataFrame:
    """Counts of each n-gram in each document, (batch, feature, total, places, docs, n, words).

    A batch is some megabytes of documents.  It has one row for each of its n-grams: how often it occurs in all, and the places in the batch of the documents
    it is in, two bytes for each occurrence.  One row without a feature has the batch's doc_ids and their numbers of n-grams (n) and of words.  So a string is
    stored once a batch, and one that every document has is a row a batch with a bounded list.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache()
        context = TaskContext.get()
        batch_id = context.partitionId() << 32
        for batch in batches:
            for a, b in slices([max(n, SLICE_BYTES // SLICE_DOCS) for n in lengths(batch.column("text"))], SLICE_BYTES):
                part = batch.slice(a, b - a)
                yield _count(part, batch_id, low, high)
                batch_id += 1

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(run, _COUNTS_SQL)


def _count(part: pa.RecordBatch, batch_id: int, low: int, high: int) -> pa.RecordBatch:
    ids: defaultdict[bytes, int] = defaultdict()
    ids.default_factory = ids.__len__
    found, sizes, n_words = [], [], []
    for text in utf8(part.column("text")):
        runs = [np.fromiter(map(ids.__getitem__, run), np.int32) for run in features(text, low, high)]
        mine = np.concatenate(runs)
        found.append(mine)
        sizes.append(len(mine))
        n_words.append(len(mine) if low == high == 1 else sum(map(len, _pieces(text, PIECE_BYTES))))
    feature = np.concatenate(found)
    order = np.argsort(feature, kind="stable")
    at = np.repeat(np.arange(len(found), dtype="<u2"), sizes)[order]
    ends = np.concatenate([[0], np.cumsum(np.bincount(feature, minlength=len(ids)))])
    # the row of the documents, then a row for each n-gram
    none = pa.array([None] * len(ids), pa.list_(pa.int64()))
    first = lambda x: pa.concat_arrays([pa.array([x], pa.list_(pa.int64())), none])
    offsets = pa.py_buffer(np.concatenate([[0], 2 * ends]).astype(np.int32))  # the first is empty
    column = {
        "batch": pa.array(np.full(len(ids) + 1, batch_id, dtype=np.int64)),
        "feature": pa.array([None, *ids], pa.binary()),
        "total": pa.array(np.concatenate([[0], np.diff(ends)])),
        "places": pa.BinaryArray.from_buffers(pa.binary(), len(ids) + 1, [None, offsets, pa.py_buffer(at)]),
        "docs": first(part.column("doc_id").to_pylist()),
        "n": first(sizes),
        "words": first(n_words),
    }
    return pa.RecordBatch.from_arrays([column[f.name].cast(f.type) for f in _COUNTS], schema=_COUNTS)


def feature_gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(feature, gain) of the corpus's n-grams, from the counts of corpus and target.

    The dictionary of distinct n-grams is written with the bucket of each; buckets are summed from it, ``buckets`` rows at most, and their gains joined to it.
    """
    both = corpus.where("feature is not null").select("feature", F.col("total").alias("s"), F.lit(0).cast("long").alias("t"))
    both = both.unionByName(target.where("feature is not null").select("feature", F.lit(0).cast("long").alias("s"), F.col("total").alias("t")))
    counts = both.groupBy("feature").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    dictionary = materialize(counts.withColumn("bucket", (F.crc32("feature") % buckets).cast("int")), "dictionary")
    by_bucket = dictionary.groupBy("bucket").agg(F.sum("s").cast("double").alias("bs"), F.sum("t").cast("double").alias("bt"))
    all_s = by_bucket.agg(F.sum("bs").alias("all_s"), F.sum("bt").alias("all_t"))
    ratio = (F.col("bt") + 1) * (F.col("all_s") + buckets) / ((F.col("bs") + 1) * (F.col("all_t") + buckets))
    gains = by_bucket.join(F.broadcast(all_s)).select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain"))  # beside one row
    return dictionary.where("s > 0").join(F.broadcast(gains), "bucket").select("feature", "gain")


def weighted(counts: DataFrame, gains: DataFrame) -> DataFrame:
    """(doc_id, n_features, n_words, weight) of each document that ``counts`` were made of."""

    def total(batch: pa.Table) -> pa.Table:
        gain = batch.column("gain").combine_chunks().to_numpy()
        places = batch.column("places").combine_chunks()
        ends = np.frombuffer(places.buffers()[1], dtype=np.int32)[places.offset : places.offset + len(places) + 1] // 2
        at = np.frombuffer(places.buffers()[2], dtype="<u2")[ends[0] : ends[-1]]
        sums = np.bincount(at, np.repeat(gain, np.diff(ends)))  # whole numbers below 2**53
        some = np.flatnonzero(np.bincount(at))
        return pa.table({"batch": pa.array(np.full(len(some), batch.column("batch")[0].as_py())), "at": pa.array(some.astype(np.int32)), "weight": pa.array(sums[some].astype(np.int64))})

    docs = counts.where("feature is null").select("batch", F.posexplode(F.arrays_zip("docs", "n", "words")).alias("at", "d")).select("batch", "at", F.col("d.docs").alias("doc_id"), F.col("d.n").alias("n_features"), F.col("d.words").alias("n_words"))
    known = counts.where("feature is not null").select("batch", "feature", "places").join(gains, "feature").select("batch", "gain", "places")
    sums = known.groupBy("batch").applyInArrow(total, "batch long, at int, weight long")  # a batch's rows are bounded
    return docs.join(sums, ["batch", "at"], "left").select("doc_id", "n_features", "n_words", F.coalesce("weight", F.lit(0)).alias("weight"))


def noise(seed: int = SEED):
    """floor(1000 times a standard Gumbel draw) that depends on the seed and the doc_id only."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, low: int = SHORTEST, high: int = LONGEST, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) as (doc_id, n_features, weight, score, rank); those with a rank are drawn.

    Of the N documents of ``least_words`` words or more, percent * N / 100 (rounded down) of the highest scores are drawn; ties go to the
    smaller doc_id, a null one last; repeated rows of one doc_id and score take successive ranks.  Null and empty texts have no
    n-grams, weight 0, and are not drawn.  An empty target or corpus is fine: its counts are zero.  Other columns are not read.  Ranks come from
    range partitions and their counts, so no task sees all documents.
    """
    able = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    with scratch() as keep:
        counts = materialize(feature_counts(docs, low, high), "counts")
        aimed = materialize(feature_counts(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), low, high), "target-counts")
        gains = feature_gains(counts, aimed, buckets)
        scored = materialize(weighted(counts, gains).withColumn("score", F.col("weight") + noise(seed)), "scores")
        fit = numbered(scored.where(able), [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")], tag="ranks")
        n = scored.where(able).agg(F.floor(F.count("*") * percent / 100).alias("k"))
        ranked = fit.join(F.broadcast(n)).withColumn("rank", F.when(F.col("rank") < F.col("k"), F.col("rank") + 1))  # beside one row
        out = ranked.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")), allowMissingColumns=True)
        return keep(out.select("doc_id", "n_features", "weight", "score", "rank"), "resampled")


def query(spark, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, bench)


_WORDS = r"regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+')"

#: The buckets' crc32 is made of bytes and the table of 256 remainders, once for each distinct n-gram.
ORACLE_SQL = rf"""WITH RECURSIVE step AS (SELECT range AS i, CAST(range AS BIGINT) AS c, 0 AS k FROM range(256) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS entries FROM step WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents), b AS (SELECT {_WORDS} AS w FROM benchmark),
f AS (SELECT r, u AS feature, count(*) AS n FROM (SELECT r, unnest(w) AS u FROM d) GROUP BY r, u),
voc AS (SELECT feature, sum(s) AS s, sum(t) AS t FROM (SELECT feature, n AS s, 0 AS t FROM f UNION ALL SELECT unnest(w), 0, 1 FROM b) GROUP BY feature),
h AS (SELECT feature, s, t, xor(list_reduce(list_transform(range(0, octet_length(encode(feature)) + 1), lambda k: CASE WHEN k = 0 THEN 4294967295 ELSE CAST(('0x' || substring(hex(encode(feature)), 2 * k - 1, 2)) AS BIGINT) END),
  lambda c, x: xor(c >> 8, entries[xor(c & 255, x) + 1])), 4294967295) % {BUCKETS} AS bucket FROM voc, crc),
g0 AS (SELECT bucket, CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM h GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM g0) + {BUCKETS}) / ((s + 1) * ((SELECT sum(t) FROM g0) + {BUCKETS})))) AS BIGINT) AS gain FROM g0),
wt AS (SELECT r, sum(n * gain) AS weight FROM f JOIN h USING (feature) JOIN g USING (bucket) GROUP BY r),
sc AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substring(sha256('{SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN wt USING (r)),
rk AS (SELECT *, row_number() OVER (ORDER BY n_features < {LEAST_WORDS}, score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (n_features >= {LEAST_WORDS}) OVER () AS able FROM sc)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {LEAST_WORDS} AND place <= {PERCENT} * able // 100 THEN place END AS rank FROM rk"""


def brute_force(docs: list[tuple[int, str | None]], target: list[str | None], low: int = SHORTEST, high: int = LONGEST, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> dict[int, tuple]:
    """doc_id -> (n_features, weight, score, rank) for small tables, in plain Python, by the rule itself."""
    import hashlib

    def runs(text):
        w = words((text or "").encode())
        return [b" ".join(w[i : i + n]) for n in range(low, high + 1) for i in range(len(w) - n + 1)]

    s, t = [0] * buckets, [0] * buckets
    for _, x in docs:
        for f in runs(x):
            s[zlib.crc32(f) % buckets] += 1
    for x in target:
        for f in runs(x):
            t[zlib.crc32(f) % buckets] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for i, x in docs:
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(f) % buckets] for f in runs(x))
        rows.append((i, len(runs(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words((x or "").encode())) >= least_words))
    drawn = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0]))
    drawn = drawn[: percent * len(drawn) // 100]
    ranks = {r[0]: k + 1 for k, r in enumerate(drawn)}
    return {r[0]: (*r[1:4], ranks.get(r[0])) for r in rows}
