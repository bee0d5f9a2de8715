import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from trefoil.llm import pseudo_likelihood as P
from trefoil.llm import queries


def corpus(n=120, seed=2):
    """Two invented languages, each with its own alternating words."""
    rng = random.Random(seed)
    kinds = [("alpha beta".split(), "north south east west".split()), ("eins zwei".split(), "rot blau gelb braun".split())]
    out = []
    for _ in range(n):
        link, noun = rng.choice(kinds)
        out.append(" ".join(w for _ in range(rng.randint(20, 60)) for w in (rng.choice(link), rng.choice(noun))))
    return out


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_network_learns_and_orders_texts(spark):
    vocab, net = P.train(frame(spark, corpus()).repartition(3))
    held_out = corpus(20, 9)
    natural, _ = P.log_probs(vocab, net, pa.array(held_out))
    # each text's own words in another order, and all texts' words mixed
    rng = random.Random(1)
    shuffled = [" ".join(rng.sample(t.split(), len(t.split()))) for t in held_out]
    mixed = [" ".join(rng.sample([w for t in held_out for w in t.split()], 800))]
    untrained, _ = P.log_probs(vocab, P.Network.start(vocab.tokens), pa.array(held_out))
    scored = [P.log_probs(vocab, net, pa.array(x))[0].mean() for x in (shuffled, mixed)]
    assert all(natural.mean() > x + 0.3 for x in (*scored, untrained.mean()))


def plain_log_probs(vocab, net, text):
    """By the definition: a full softmax over classes, one over all tokens of the class, and the word's share of a shared token."""
    words = [w for w in re.sub(r"([!-/:-@\[-`{-~]+)", r" \1 ", text.lower()).split() if w]
    hashes = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    token, share = [], []
    for h in hashes.tolist():
        if h in set(vocab.hashes.tolist()):
            token.append(int(vocab.token[vocab.hashes.tolist().index(h)]))
            share.append(0.0)
        else:
            token.append(vocab.own + (h >> 8) % P.SHARED_TOKENS)
            share.append(vocab.log_count[(h >> 20) % len(vocab.log_count)] - vocab.log_mass[(h >> 8) % P.SHARED_TOKENS])
    padded = [vocab.tokens] * P.SIDE + token + [vocab.tokens] * P.SIDE
    out = []
    for i, t in enumerate(token):
        hidden = np.tanh(sum(net.embed[j][padded[i + P.SIDE + p]].astype(float) for j, p in enumerate(P.PLACES)))
        logits = hidden @ net.top + net.top_bias
        c = t if t < P.ALONE else P.ALONE + (t - P.ALONE) // P.CLASS_SIZE
        value = logits[c] - np.log(np.exp(logits).sum()) + share[i]
        if t >= P.ALONE:
            a = P.ALONE + (c - P.ALONE) * P.CLASS_SIZE
            inner = net.out[a : a + P.CLASS_SIZE] @ hidden + net.bias[a : a + P.CLASS_SIZE]
            value += inner[t - a] - np.log(np.exp(inner).sum())
        out.append(value)
    return out


def test_query_against_the_definition(spark):
    texts = [*corpus(60), "alpha, once... SEEN word ###", "twice seen", "twice seen", None, "", "  "]
    df = frame(spark, texts).repartition(2)
    model = P.train(df)
    got = {r.doc_id: r for r in P.score(df, model).collect()}
    for i in [0, 1, 2, *range(60, len(texts))]:
        want = plain_log_probs(*model, texts[i] or "")
        assert got[i].n_tokens == len(want) and got[i].log_prob == pytest.approx(sum(want), abs=1e-3 * max(1, len(want)))
    # what other layouts of the same rows give
    again = {r.doc_id: r.log_prob for r in P.score(df.repartition(7)).collect()}
    assert all(again[i] == pytest.approx(r.log_prob, abs=1e-4) for i, r in got.items())


def test_probabilities_sum_to_one_and_gradients_fit(spark):
    vocab = P.vocabulary(frame(spark, corpus(30)))
    trainer = P.Trainer(P.Network.start(vocab.tokens), vocab)
    trainer.learn(pa.array(corpus(30)))
    hidden = P._hidden(trainer.net, np.full(5, vocab.tokens), np.array([2]))[:, : P.WIDTH]
    top = P._softmax(hidden @ trainer.net.top + trainer.net.top_bias)[0]
    total = top[: P.ALONE].sum()
    for c in range(P.ALONE, len(top)):
        a = P.ALONE + (c - P.ALONE) * P.CLASS_SIZE
        total += top[c] * P._softmax(hidden @ trainer.net.out[a : a + P.CLASS_SIZE].T + trainer.net.bias[a : a + P.CLASS_SIZE]).sum()
    assert total == pytest.approx(1, abs=1e-4)


def test_counts_grow_with_the_corpus(spark):
    texts = [f"word{i} " * (1 + i % 3) + f"rare{i}" for i in range(3000)]
    small, large = P.vocabulary(frame(spark, texts[:200])), P.vocabulary(frame(spark, texts))
    assert len(large.log_count) > len(small.log_count) and large.words > 10 * small.words
    h = pd.util.hash_array(np.array([f"word{i}" for i in range(2, 3000, 3)] + [f"rare{i}" for i in range(2, 3000, 3)], dtype=object), categorize=False)
    token, share = large.look_up(h)
    found = large.log_count[P._bucket(h, len(large.log_count))].reshape(2, -1)
    assert (token >= large.own).all() and np.allclose(np.median(found, axis=1), [np.log(3), 0]) and share[: len(h) // 2].mean() > share[len(h) // 2 :].mean() + 0.8


def test_copies_weigh_and_no_shard_is_hot(spark):
    texts = [f"text number {i} of many" for i in range(4000)] + ["one row again and again"] * 4000 + ["a small group"] * 7
    df = frame(spark, texts).withColumn("doc_id", F.lit(1)).repartition(6)
    shards = 8
    dealt = P.deal(df, shards).groupBy("shard", "h").agg(F.sum("weight").alias("weight")).collect()
    per_shard, per_text = Counter(), Counter()
    for r in dealt:
        per_shard[r.shard] += r.weight
        per_text[r.h] += r.weight
    mean = len(texts) / shards
    assert len(per_shard) == shards and max(per_shard.values()) <= 2 * mean
    assert sorted(per_text.values())[-3:] == [1, 7, 4000] and sum(per_text.values()) == pytest.approx(len(texts))
    # texts that are read: the hot one once for each of its shards
    assert P.deal(df, shards).count() <= 4007 + shards


def test_copies_train_as_one_weighted_text(spark):
    vocab = P.vocabulary(frame(spark, corpus(40)))
    a, b = pa.array(corpus(70)), np.arange(1, 71, dtype=np.float64)
    whole = P.Shard(P.Network.start(vocab.tokens), vocab)
    whole.add(a, np.arange(70), b)
    pieces = P.Shard(P.Network.start(vocab.tokens), vocab)
    rows = [i for i in range(70) for _ in range(i + 1)]
    for i in range(0, len(rows), 13):
        pieces.add(a.take(pa.array(rows[i : i + 13])), np.array(rows[i : i + 13]), np.ones(len(rows[i : i + 13])))
    (n, x), (m, y) = whole.end(), pieces.end()
    assert n == m == sum((i + 1) * len(t.as_py().split()) for i, t in enumerate(a)) and np.allclose(x, y)


def test_averaging_in_levels(spark, monkeypatch):
    monkeypatch.setattr(P, "FAN_IN", 2)
    monkeypatch.setattr(P, "SHARD_WORDS", 500)
    vocab, net = P.train(frame(spark, corpus(40)).repartition(5))
    assert vocab.words > 1500
    monkeypatch.setattr(P, "SHARD_WORDS", 100)
    again = P.train(frame(spark, corpus(40)).repartition(3), vocab)[1]
    assert np.isfinite(again.flat()).all()
    assert np.isfinite(net.flat()).all()


def test_query_contract_nulls_and_clashing_columns(spark):
    got = queries.op10_masked_pseudo_likelihood(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.log_prob <= 0 and (r.mean_log_prob is None) == (r.n_tokens == 0) for r in got)
    data = [(1, "alpha north", 1.0), (1, "alpha north", 2.0), (2, None, 0.0), (3, "", 0.0), (4, "... !!", 0.0), (None, "alpha " * 100000, 0.0)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, log_prob double")
    rows = P.score(df).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 100000), (1, 2), (1, 2), (2, 0), (3, 0), (4, 2)]
    assert P.score(df.limit(0)).collect() == []
