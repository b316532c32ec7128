"""Quality classifier: Bradley-Terry pairwise ranking of documents, cut at a score quantile."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket5, only_cache, slices, utf8

#: Labelled rows used for fitting at most; the rows with the smallest hash of their id are taken.
MOST_LABELLED = 20_000
#: Preference pairs drawn for the logistic loss.
PAIRS = 200_000
#: Documents whose score reaches this are good.
CUT = 0.3

_PUNCT = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Class of each byte: upper, lower, digit, blank, newline, other control, non-ASCII, then each punctuation mark.
_CLASS = np.full(256, 5, dtype=np.int64)
for _b in range(256):
    _CLASS[_b] = 0 if 65 <= _b <= 90 else 1 if 97 <= _b <= 122 else 2 if 48 <= _b <= 57 else 3 if _b in (32, 9) else 4 if _b in (10, 13) else 6 if _b >= 128 else 7 + _PUNCT.index(_b) if _b in _PUNCT else 5
N_CLASSES = 7 + len(_PUNCT)
N_FEATURES = N_CLASSES + 6


def features(texts: list[bytes]) -> np.ndarray:
    """One row of ``N_FEATURES`` numbers a whole text; an empty text has zeros."""
    out = np.zeros((len(texts), N_FEATURES))
    for i, t in enumerate(texts):
        if not t:
            continue
        n = len(t)
        share = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(t, np.uint8), minlength=256), minlength=N_CLASSES) / n
        ws = t.split()
        k = max(1, len(ws))
        lines = [x for x in t.split(b"\n") if x.strip()]
        out[i, :N_CLASSES] = np.sqrt(share)
        out[i, N_CLASSES:] = (
            np.log1p(n) / 10,
            n / k / 20,
            len(set(ws)) / k,
            len(set(lines)) / max(1, len(lines)),
            share[0] / max(share[0] + share[1], 1e-9),
            share[7:].sum() / max(share[3] + share[4], 1e-9) / 4,
        )
    return out


@dataclass
class PairwiseRanker:
    """Linear scores learnt from preferences: P(i above j) = 1 / (1 + exp(score_j - score_i))."""

    ridge: float = 1e-3
    seed: int = 7
    mean: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES))
    scale: np.ndarray = field(default_factory=lambda: np.ones(N_FEATURES))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES))
    threshold: float = 0.0

    def fit(self, x: np.ndarray, good: np.ndarray, pairs: int = PAIRS) -> PairwiseRanker:
        """Newton steps on the logistic loss of feature differences of (good, bad) pairs.

        The threshold is the quantile of the fitted scores at the share of bad rows.  Without rows of
        both classes all weights stay 0 and every document gets the threshold's score, thus is kept.
        """
        above, below = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
        if not len(above) or not len(below):
            return self
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        rng = np.random.default_rng(self.seed)
        d = z[rng.choice(above, pairs)] - z[rng.choice(below, pairs)]
        w = np.zeros(x.shape[1])
        for _ in range(25):
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            grad = -(d * p[:, None]).mean(0) + self.ridge * w
            hess = (d * (p * (1 - p))[:, None]).T @ d / pairs + self.ridge * np.eye(len(w))
            step = np.linalg.solve(hess, grad)
            w = w - step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w
        self.threshold = float(np.quantile(self.raw(x), len(below) / (len(above) + len(below)), method="midpoint"))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; ``CUT`` exactly at the threshold."""
        s = 1 / (1 + np.exp(-np.clip(self.raw(x) - self.threshold + np.log(CUT / (1 - CUT)), -30, 30)))
        return np.where(self.raw(x) >= self.threshold, np.maximum(s, CUT), s)


def _apply(docs: DataFrame, make, schema: str) -> DataFrame:
    """Whole texts in slices of about 4 MB through ``make(texts) -> columns after doc_id``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache()
        for b in batches:
            ids, texts = b.column(0), utf8(b.column(1))
            for i, j in slices([len(t) for t in texts], 4_000_000):
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), *make(texts[i:j])], names=names)

    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, most_labelled: int = MOST_LABELLED) -> PairwiseRanker:
    """Fits on labelled documents whose row of ``labels`` meets ``learn_from``.

    At most ``most_labelled`` rows are used (a bounded sample by hash of the id); their ids are
    broadcast, which that parameter bounds, and their features come to the driver.  Rows with a
    null id or label are left out; an id labelled more than once counts once, by its mean, and one that
    several documents bear stands for one of them.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    if learn_from is not None:
        rows = rows.where(learn_from)
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("good"))
    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled).toPandas()
    spark = docs.sparkSession
    if not len(sample):
        return PairwiseRanker()
    ids = F.broadcast(spark.createDataFrame(sample[["doc_id"]], "doc_id long"))
    some = docs.select(F.col("doc_id").cast("long"), "text").join(ids, "doc_id", "left_semi")
    got = _apply(some, lambda texts: [pa.array([f.tobytes() for f in features(texts)], pa.binary())], "doc_id long, f binary")
    got = got.groupBy("doc_id").agg(F.min("f").alias("f")).toPandas()  # one row an id, whatever ids repeat
    got = got.merge(sample, on="doc_id").sort_values(["doc_id", "f"])
    x = np.frombuffer(b"".join(got.f), dtype=np.float64).reshape(-1, N_FEATURES)
    return PairwiseRanker().fit(x, got.good.to_numpy())


def classify(docs: DataFrame, model: PairwiseRanker) -> DataFrame:
    """``(doc_id, score, predicted)`` a row of ``docs``; null and empty texts are scored too.

    Repeated rows give repeated results, ties in score share a verdict, other columns are ignored.
    """

    def make(texts: list[bytes]) -> list[pa.Array]:
        s = model.score(features(texts))
        return [pa.array(s), pa.array((s >= CUT).astype(np.int32))]

    return _apply(docs, make, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: PairwiseRanker) -> DataFrame:
    """The rows of ``docs`` that the model accepts, with all their columns; one pass, no join."""

    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache()
        for b in batches:
            text = pa.StructArray.flatten(b.column(0))[place]
            for i, j in slices(pc.fill_null(pc.binary_length(text), 0).to_pylist(), 4_000_000):
                good = model.score(features(utf8(text.slice(i, j - i)))) >= CUT
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i)], names=["row"]).filter(pa.array(good))

    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return whole.mapInArrow(run, whole.schema).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = classify(docs, train(docs, labels, bucket5() != 0))
    return out.select("doc_id", (bucket5() == 0).alias("held_out"), "score", "predicted")
