"""Mixing: targets against a plain computation, documents' shares against the words of the mix itself."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from pagefinder.llm import mixing

SCHEMA = "doc_id long, text string, source string, rid long, size long, sid string, shard int"


def corpus(seed=7):
    """Sources of very different sizes, one of them null; each word says its row and place."""
    rng = random.Random(seed)
    sizes = [(s, rng.randint(0, 120)) for s in ["b"] * 60 + ["a"] * 25 + [None] * 20 + ["ü"] * 3 + ["c"] * 8] + [("b", 6000), ("tiny", 3), ("void", 0), ("void", None), (None, 40)]
    return [(i, None if n is None else " \n".join(f"d{i}w{k}" for k in range(n)), s) for i, (s, n) in enumerate(sizes)]


def targets(rows, cycle, most):
    size = Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    order = sorted((s for s in size if s is not None), key=str) + [None] * (None in size)
    weight = {s: cycle[k % len(cycle)] for k, s in enumerate(order)}
    stopped: set = set()
    while True:
        left = sum(weight[s] for s in order if s not in stopped)
        level = (sum(size.values()) - sum(most * size[s] for s in stopped)) / left if left else 0
        over = {s for s in order if s not in stopped and weight[s] * level > most * size[s]}
        if not over:
            return {s: (size[s], most * size[s] if s in stopped else weight[s] * level) for s in order}
        stopped |= over


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus()
    return rows, spark.createDataFrame([(d, t, s, 1, 2, "x", 3) for d, t, s in rows], SCHEMA)


@pytest.mark.parametrize(("block", "shard_slots", "fan", "most"), [(16, 50, 1024, 3), (7, 400, 2, 3), (64, 10, 3, 1)])
def test_against_the_words_of_the_mix(tables, block, shard_slots, fan, most):
    rows, docs = tables
    how = {"block": block, "shard_slots": shard_slots, "fan": fan, "most_passes": most}
    want = targets(rows, mixing.CYCLE, most)
    got = {r.doc_id: r for r in mixing.mix(docs.repartition(5), **how).collect()}
    source = {d: s for d, _, s in rows}
    assert len(got) == len(rows)
    for d, t, s in rows:
        assert (got[d].size, got[d].source_size) == (len((t or "").split()), want[s][0]) and abs(got[d].target - want[s][1]) < 1e-6
        assert got[d].taken <= most * got[d].size
    per = Counter()
    for d, r in got.items():
        per[source[d]] += r.taken
    assert all(abs(per[s] - t) <= 0.5 for s, (_, t) in want.items())
    # the mix: contiguous runs of each source's words, in shards of about the size asked for
    words, shards = Counter(), Counter()
    for r in mixing.mixed_blocks(docs, **how).collect():
        run = r.text.split(" ")
        assert len(run) == r.words <= block
        for w in run:
            d = int(re.match(r"d(\d+)w", w)[1])
            words[d] += 1
            assert source[d] == r.source
        shards[r.shard] += 1
    assert {d: r.taken for d, r in got.items() if r.taken} == words
    assert max(shards.values()) <= 1.5 * shard_slots + 20


def test_same_whatever_the_partitions(tables):
    _, docs = tables
    one = sorted(mixing.mix(docs.repartition(1), block=16).collect(), key=str)
    assert one == sorted(mixing.mix(docs.repartition(7), block=16).collect(), key=str)


def test_permutation():
    for n in (1, 2, 3, 17, 1000, 4097):
        at = mixing.permuted(np.arange(n), n, 5)
        assert sorted(at.tolist()) == list(range(n))
    assert (mixing.permuted(np.arange(1000), 1000, 5) != mixing.permuted(np.arange(1000), 1000, 6)).mean() > 0.9


def test_empty_repeated_and_wordless(spark, tables):
    rows, docs = tables
    assert mixing.mix(docs.where("false")).count() == 0 and mixing.mixed_blocks(docs.where("false")).count() == 0
    blank = spark.createDataFrame([(1, None, None), (None, "", "a"), (2, " \t\n", "a")], "doc_id long, text string, source string")
    assert {(r.size, r.source_size, r.target, r.taken) for r in mixing.mix(blank).collect()} == {(0, 0, 0.0, 0)}
    twice = mixing.mix(docs.unionByName(docs), block=16).collect()
    assert len(twice) == 2 * len(rows) and all(r.taken <= 3 * r.size for r in twice)


def test_multinomial_draws(spark):
    """Counts of shards have the mean and the spread of a multinomial draw, through groups as well."""
    quotas = [500, 300, 150, 50]
    sources = spark.createDataFrame([(k, q) for k, q in enumerate(quotas)], "sid long, quota long")
    for fan in (1024, 2):
        got = Counter()
        for r in mixing.draw_counts(sources, 40_000, shard_slots=100, fan=fan).collect():
            got[r.shard, r.sid] = r.n
        counts = np.array([[got[k, s] for s in range(4)] for k in range(400)])
        p = np.array(quotas) / 1000
        assert (counts.sum(1) == 100).all() and np.abs(counts.mean(0) - 100 * p).max() < 2
        assert np.abs(counts.var(0) / (100 * p * (1 - p)) - 1).max() < 0.35
