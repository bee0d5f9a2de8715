from itertools import product

import numpy as np
import pytest

from trefoil.llm import crf


def random_case(seed, k=3, sizes=(1, 4, 0, 2, 5, 3)):
    rng = np.random.default_rng(seed)
    return rng.normal(0, 2, (sum(sizes), k)), np.concatenate([[0], np.cumsum(sizes)]), rng.normal(0, 1, (k, k))


@pytest.mark.parametrize("seed", range(4))
def test_marginals_and_best_paths_against_enumeration(seed):
    e, bounds, t = random_case(seed)
    post = crf.posteriors(e, bounds, t)
    at, cuts = crf.islands(e, bounds, t, 0)
    best = np.zeros(len(e), dtype=int)
    best[at] = crf.viterbi(e[at], cuts, t)
    assert (crf.viterbi(e, bounds, t) == best).all()
    for a, b in zip(bounds, bounds[1:], strict=False):
        paths = list(product(range(3), repeat=b - a))
        if not b - a:
            continue
        inner = [sum(e[a + i, y] for i, y in enumerate(p)) + sum(t[p[i], p[i + 1]] for i in range(len(p) - 1)) for p in paths]
        assert tuple(best[a:b]) == paths[int(np.argmax(inner))]
        # forward-backward starts from an unknown label before the first word
        total = [s + np.log(np.exp(t[:, p[0]]).sum()) for s, p in zip(inner, paths, strict=True)]
        w = np.exp(np.array(total) - max(total))
        for i in range(b - a):
            want = np.array([w[[p[i] == y for p in paths]].sum() for y in range(3)]) / w.sum()
            assert np.allclose(post[a + i], want)


def test_blocks_don_t_show():
    """A sequence of several blocks has the marginals that a plain recursion gives."""
    e, bounds, t = random_case(9, sizes=(3 * crf.BLOCK + 5, crf.BLOCK, 2 * crf.BLOCK + 1))
    post = crf.posteriors(e, bounds, t)
    a = np.exp(t)
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        f = np.full(3, 1 / 3)
        ahead = []
        for i in range(lo, hi):
            f = (f @ a) * np.exp(e[i])
            f /= f.sum()
            ahead.append(f)
        m = np.ones(3)
        for i in reversed(range(lo, hi)):
            want = ahead[i - lo] * m
            assert np.allclose(post[i], want / want.sum())
            m = a @ (m * np.exp(e[i]))
            m /= m.sum()


def test_islands_save_work_and_change_nothing():
    rng = np.random.default_rng(1)
    e = rng.normal(0, 1, (3000, 4))
    e[:, 0] += 8 * (rng.random(3000) < 0.9)
    bounds = np.array([0, 700, 700, 701, 3000])
    t = rng.normal(0, 0.5, (4, 4))
    at, cuts = crf.islands(e, bounds, t, 0)
    best = np.zeros(3000, dtype=int)
    best[at] = crf.viterbi(e[at], cuts, t)
    assert len(at) < 2000 and (best == crf.viterbi(e, bounds, t)).all()


def test_training_recovers_a_rule():
    rng = np.random.default_rng(2)
    seq = rng.integers(0, 6, (60, 12))
    gold = (seq >= 3).astype(int)
    w, t = crf.train([np.arange(6)], [np.arange(6)], 6, seq, gold, 2, rounds=60)
    assert (crf.viterbi(w[seq[0]], np.array([0, 12]), t) == gold[0]).all()
