"""The conversation trie against a plain one, with awkward rows."""

import random

import pytest

from pagefinder.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, depth long, owner int"


def tables(seed=4, n=120):
    """Conversations that share beginnings at every depth, equal ones, long ones, nulls, repeats, gaps in the ids."""
    rng = random.Random(seed)
    rows, told = [], []
    for c in range(n):
        if c % 13 == 5:
            continue
        turns = list(rng.choice(told)[: rng.randint(1, 6)]) if told and rng.random() < 0.6 else []
        turns += [(rng.choice(["user", "assistant"]), " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 6)))) for _ in range(rng.randint(0 if turns else 1, 5))]
        told.append(turns)
        rows += [(c, k, r, t) for k, (r, t) in enumerate(turns)]
    rows += [(200, k, "user", f"t{k % 7}") for k in range(60)] + [(201, k, "user", f"t{k % 7}") for k in range(55)]
    rows += [(300, None, None, None), (300, None, "user", "x"), (300, 1, "user", "x"), (300, 1, "user", "x"), (300, 1, "user", "y" * 50_000)]
    rows += [(c, 0, "user", "same words here") for c in range(400, 470)] + [(None, 0, "user", "lost"), (19, 0, "user", "Ünï ü")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("run", [4096, 3])
def test_against_a_plain_trie(spark, monkeypatch, run):
    monkeypatch.setattr(conversations, "_RUN", run)
    monkeypatch.setattr(conversations, "_IDS", 5 * run)
    rows = tables()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA).repartition(5)
    got = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in conversations.prefix_trie(df).collect()}
    assert got == conversations.brute_force(rows)


def test_ladder(spark):
    """Each conversation goes one turn further with the last one: the tree of chains is as high as it can be."""
    rows = [(c, k, "user", f"{k}" if k <= c else f"end {c}") for c in range(12) for k in range(c + 2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in conversations.prefix_trie(df, group=1).collect()}
    assert got == conversations.brute_force(rows, group=1)


def test_empty(spark):
    df = spark.createDataFrame([(None, 1, "user", "x", 1, 2)], SCHEMA)
    assert conversations.prefix_trie(df).count() == 0 and conversations.prefix_trie(df.where("false")).count() == 0
