"""The automaton's own parts: failure arcs, states carried over words, walks of long texts."""

import random

import numpy as np
import pytest

from pagefinder.llm import lm_score


def model(texts, learn, order):
    chunk = lm_score.Chunk.build([t.encode() for t in texts], order)
    count = chunk.counts(np.array(learn))
    words = count[chunk.words]
    return chunk, lm_score.Automaton.build(chunk, count, int(words.sum()), int((words > 0).sum()), lm_score.PRIOR)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
@pytest.mark.parametrize("walk", [1, 2, 7, 256])
def test_walks_sum_to_the_formula(monkeypatch, order, walk):
    monkeypatch.setattr(lm_score, "WALK", walk)
    rng = random.Random(order)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.choice([0, 1, 5, 90]))) for _ in range(40)] + ["new words only", "a b unseen c d", "x " * 700]
    want = lm_score.brute_force(list(enumerate(texts)), order)
    chunk, automaton = model(texts, [not want[k][0] for k in range(len(texts))], order)
    n, known, base, score = automaton.traverse(chunk)
    for k in range(len(texts)):
        assert (n[k], known[k]) == want[k][1:3] and abs(base[k] - want[k][4]) < 1e-9 and abs(score[k] - want[k][5]) < 1e-9


def test_states_and_failure_arcs():
    texts = ["a b c", "a b d", "b c"]
    chunk, automaton = model(texts, [True, True, False], 3)
    at = {(k, t, i): chunk.grams[k][chunk.begins[t] + i] for k in range(3) for t in range(3) for i in range(1, 4) if chunk.begins[t] + i < len(chunk.grams[0])}
    ab, b = at[1, 0, 2], at[0, 0, 2]
    assert automaton.fail[ab] == b and automaton.fail[b] == -1 and automaton.count[ab] == 2 == automaton.count[b]
    assert abs(10 ** automaton.fail_weight[ab] - lm_score.PRIOR / (2 + lm_score.PRIOR)) < 1e-12
    # after "b c" of a text that begins with b: the start and b were never seen together, so the state is b's alone
    state, size = automaton.start(chunk, np.array([chunk.begins[2] + 1]))
    assert (state[0], size[0]) == (b, 1)
