"""A linear-chain conditional random field in numpy: training, forward-backward and Viterbi over many sequences at once.

Emissions are scores (n, labels) of all sequences one after the other; ``bounds`` cuts them.
Sequences are cut into blocks of equal length, so that a step of the recursion is one array operation over all
blocks and a very long sequence costs no more steps than the short ones do.
"""

from __future__ import annotations

import numpy as np

BLOCK = 32


def _blocks(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of every block, and each sequence's bounds among the blocks."""
    size = np.diff(bounds)
    many = -(-size // BLOCK)
    ends = np.concatenate([[0], np.cumsum(many)])
    place = np.arange(ends[-1]) - np.repeat(ends[:-1], many)
    start = np.repeat(bounds[:-1], many) + place * BLOCK
    return start, np.minimum(BLOCK, np.repeat(bounds[1:], many) - start), ends


def _normal(x: np.ndarray, axis) -> np.ndarray:
    return x / np.maximum(x.sum(axis=axis, keepdims=True), 1e-300)


def posteriors(emissions: np.ndarray, bounds: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Marginal label probabilities (n, labels) by forward-backward."""
    n, k = emissions.shape
    if not n:
        return np.zeros((0, k))
    start, size, ends = _blocks(bounds)
    a = np.exp(transitions - transitions.max())
    e = np.exp(emissions - emissions.max(axis=1, keepdims=True))
    at = np.minimum(start[:, None] + np.arange(BLOCK), n - 1).T
    live = (np.arange(BLOCK)[:, None] < size)[:, :, None]
    # what each block does to any incoming message: a product of its steps
    through = np.broadcast_to(np.eye(k), (len(start), k, k)).copy()
    for t in range(BLOCK):
        step = (through.reshape(-1, k) @ a).reshape(-1, k, k) * e[at[t]][:, None, :]
        through = np.where(live[t][:, :, None], _normal(step, (1, 2)), through)
    # messages that enter each block from the left and the right, block by block along the sequences
    left, right = np.full((len(start), k), 1.0 / k), np.full((len(start), k), 1.0 / k)
    many = np.diff(ends)
    for i in range(1, int(many.max(initial=0))):
        row = ends[:-1][many > i] + i
        left[row] = _normal(np.einsum("bi,bij->bj", left[row - 1], through[row - 1]), 1)
        row = ends[1:][many > i] - 1 - i
        right[row] = _normal(np.einsum("bij,bj->bi", through[row + 1], right[row + 1]), 1)
    ahead = np.empty((BLOCK, len(start), k))
    m = left
    for t in range(BLOCK):
        m = np.where(live[t], _normal((m @ a) * e[at[t]], 1), m)
        ahead[t] = m
    out = np.zeros((n, k))
    m = right
    for t in reversed(range(BLOCK)):
        ok = live[t][:, 0]
        out[at[t][ok]] = ahead[t][ok] * m[ok]
        m = np.where(live[t], _normal((m * e[at[t]]) @ a.T, 1), m)
    return _normal(out, 1)


def viterbi(emissions: np.ndarray, bounds: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Best label of every position. Sequences are run side by side, longest first; give short ones (see :func:`islands`)."""
    n, k = emissions.shape
    best = np.zeros(n, dtype=np.int64)
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    start, size = bounds[:-1][order], size[order]
    live = int((size > 0).sum())
    if not live:
        return best
    back = np.zeros((n, k), dtype=np.int16)
    score = emissions[start[:live]].copy()
    final = np.zeros(len(start), dtype=np.int64)
    for t in range(1, int(size[0]) + 1):
        now = int((size > t).sum())
        final[now:live] = score[now:live].argmax(axis=1)
        live, score = now, score[:now]
        if live:
            cand = score[:, :, None] + transitions
            back[start[:live] + t] = cand.argmax(axis=1)
            score = cand.max(axis=1) + emissions[start[:live] + t]
    label, live = final, len(start)
    for t in range(int(size[0]) - 1, -1, -1):
        live = int((size > t).sum())
        best[start[:live] + t] = label[:live]
        if t:
            label[:live] = back[start[:live] + t, label[:live]]
    return best


def islands(emissions: np.ndarray, bounds: np.ndarray, transitions: np.ndarray, plain: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where Viterbi must still be run, and bounds that cut them into sequences.

    A position whose score for label ``plain`` leads by more than any label between any neighbours can gain in
    transitions has that label in every best path, as changing it there could only raise a path's score. Between two
    such positions the path is independent of the rest; one of them is kept on both sides of each island.
    """
    n, k = emissions.shape
    rest = np.delete(emissions, plain, axis=1).max(axis=1) if k > 1 else np.full(n, -np.inf)
    gain = (transitions - transitions[:, [plain]]).max(axis=0) + (transitions - transitions[[plain]]).max(axis=1)
    sure = emissions[:, plain] - rest > gain.max() + 1e-6
    need = ~sure
    first = np.zeros(n + 1, dtype=bool)
    first[bounds] = True
    wide = need.copy()
    wide[:-1] |= need[1:] & ~first[1:n]
    wide[1:] |= need[:-1] & ~first[1:n]
    at = np.flatnonzero(wide)
    cut = np.concatenate([[True], (np.diff(at) > 1) | first[at[1:]]]) if len(at) else np.zeros(0, dtype=bool)
    return at, np.concatenate([np.flatnonzero(cut), [len(at)]])


def train(features: list[np.ndarray], owner: list[np.ndarray], n_features: int, sequences: np.ndarray, labels: np.ndarray, k: int, rounds: int = 40, rate: float = 0.3, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights (n_features, k) and transitions (k, k) by full-batch Adagrad on the conditional log-likelihood.

    ``features[i]`` are feature numbers and ``owner[i]`` the word each belongs to; words repeat in the sequences
    (rows of word numbers, -1 pads) with gold ``labels`` of the same shape.
    """
    words = int(max(sequences.max(initial=0), max((o.max(initial=0) for o in owner), default=0))) + 1
    feature, of = np.concatenate(features), np.concatenate(owner)
    weights, trans = np.zeros((n_features, k)), np.zeros((k, k))
    sum_w, sum_t = np.full((n_features, k), 1e-6), np.full((k, k), 1e-6)
    live = sequences >= 0
    seq = np.where(live, sequences, 0)
    gold = np.eye(k)[labels] * live[:, :, None]
    pair = live[:, 1:] & live[:, :-1]
    gold_t = np.einsum("sti,stj->ij", gold[:, :-1] * pair[:, :, None], gold[:, 1:])
    steps = seq.shape[1]
    for _ in range(rounds):
        emit = np.stack([np.bincount(of, weights[feature, j], words) for j in range(k)], axis=1)
        e = emit[seq]
        e = np.exp(e - e.max(axis=2, keepdims=True))
        a = np.exp(trans - trans.max())
        ahead, behind = np.empty(e.shape), np.empty(e.shape)
        m = np.full((len(seq), k), 1.0 / k)
        for t in range(steps):
            m = np.where(live[:, t, None], _normal((m @ a) * e[:, t], 1), m)
            ahead[:, t] = m
        m = np.full((len(seq), k), 1.0 / k)
        for t in reversed(range(steps)):
            behind[:, t] = m
            m = np.where(live[:, t, None], _normal((m * e[:, t]) @ a.T, 1), m)
        post = _normal(ahead * behind, 2) * live[:, :, None]
        xi = np.einsum("sti,ij,stj->stij", ahead[:, :-1], a, e[:, 1:] * behind[:, 1:])
        xi = _normal(xi, (2, 3)) * pair[:, :, None, None]
        count = max(1, int(live.sum()))
        diff = (gold - post).reshape(-1, k)
        by_word = np.stack([np.bincount(seq.ravel(), diff[:, j], words) for j in range(k)], axis=1)
        grad = np.stack([np.bincount(feature, by_word[of, j], n_features) for j in range(k)], axis=1) / count - decay / 100 * weights
        grad_t = (gold_t - xi.sum(axis=(0, 1))) / count - decay * trans
        sum_w += grad**2
        sum_t += grad_t**2
        weights += rate * grad / np.sqrt(sum_w)
        trans += rate * grad_t / np.sqrt(sum_t)
    return weights, trans
