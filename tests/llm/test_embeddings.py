"""Sorted passes over vectors: windows at every size, crowds, and what a block does."""

import numpy as np
import pyarrow as pa

from pagefinder.llm import embed_dedup


def turned(rng, x, by):
    """Vectors at about this cosine."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return by * x + np.sqrt(1 - by**2) * rng.standard_normal(x.shape) / np.sqrt(x.shape[1])


def links(x):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    return np.concatenate([(unit[k : k + 1000] @ unit.T >= 0.9).sum(axis=1) - 1 for k in range(0, len(x), 1000)])


def frame(spark, x):
    return spark.createDataFrame(pa.table({"cid": np.arange(len(x)), "vec": [v.tobytes() for v in x]})).repartition(4)


def connected(found, n):
    root = list(range(n))

    def top(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for r in found.collect():
        root[top(r.a)] = top(r.b)
    return [top(k) for k in range(n)]


def test_windows_below_two_thousand(spark):
    """No size is compared in all pairs: 1500 vectors go through windows of 64, several passes, and planted pairs are found."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((1200, 48))
    x = np.concatenate([base, turned(rng, base[:300], 0.915)])
    report = []
    found = embed_dedup.find_links(frame(spark, x), window=64, report=report)
    assert report[0] == (1500, 64) and all(w < n for n, w in report)
    top = connected(found, len(x))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    pairs = [k for k in range(300) if unit[k] @ unit[1200 + k] >= 0.9]
    assert len(pairs) > 200 and sum(top[k] == top[1200 + k] for k in pairs) >= 0.95 * len(pairs)
    a, b = np.array([(r.a, r.b) for r in found.collect()]).T
    assert ((unit[a] * unit[b]).sum(axis=1) >= 0.9).all()


def test_crowd_widens_windows(spark):
    """A cone whose vectors are nearly near: windows grow until its pairs are found."""
    rng = np.random.default_rng(6)
    axis = np.zeros((1, 96))
    axis[0, 0] = 1
    hot = turned(rng, np.repeat(axis, 4000, 0), 0.84**0.5)
    x = np.concatenate([hot, turned(rng, hot[:200], 0.925), rng.standard_normal((500, 96))])
    got = {r.vec_id: r.n_links for r in embed_dedup.link_vectors(spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(x.tolist())}))).collect()}
    want = links(x)
    assert want.sum() > 200 and all(got[k] <= n for k, n in enumerate(want)) and sum(got.values()) >= 0.95 * want.sum()


def test_copies_leave_at_once(spark):
    """Near copies of one vector: each one's whole window is linked, so one round connects them."""
    rng = np.random.default_rng(7)
    x = np.concatenate([turned(rng, np.repeat(rng.standard_normal((1, 32)), 1500, 0), 0.99), rng.standard_normal((20, 32))])
    report = []
    top = connected(embed_dedup.find_links(frame(spark, x), window=64, report=report), len(x))
    assert len(set(top[:1500])) == 1 and sum(n > 100 for n, _ in report) == 1


def test_shared_bits():
    assert embed_dedup.shared_bits([(5, 9), (5, 8), (4, 9), (1 << 62, 0)], (5, 9)).tolist() == [126, 125, 62, 0]
