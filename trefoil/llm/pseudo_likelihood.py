"""Masked pseudo-likelihood: a bidirectional window network predicts every token from the words on both sides of it.

Words (lower case; runs of punctuation are words of their own) are counted over the whole corpus. The frequent ones are
tokens of their own, the rest share tokens by hash. The network adds an embedding for each of the neighbours by its
place, goes through one tanh layer and gives every token its probability by a two-level softmax, in which both levels
see the context: the token's class, and the token among all of its class. A rare word further takes its own share of the
shared token, from the corpus counts of all rare words; words seen once and unseen ones count as one. A text scores
the sum of the log-probabilities of all its words, each given the others in its window.

Training covers all documents: a hash of the text deals them to shards, whatever files they lie in, and shards grow in
number with the corpus, not in size. Copies of a text train once, weighted by their number; a text with more copies than
a shard has texts goes to as many shards as its share of the rows is worth, with an equal part of the weight in each.
Every shard trains a replica on all its tokens in the order of the hash, from one common start that a small bounded
sample has warmed up; a task averages the replicas of its shards by their tokens as it goes, and tasks' replicas are
averaged in groups of FAN_IN, level by level. The tables that grow with the corpus stay in Spark; to the tasks go at
most OWN words and the counts of at most 2 ** BITS buckets of rare words.

Defined results: null, empty and word-less texts have 0 tokens, log_prob 0 and a null mean; very long texts are read
whole; repeated rows are scored each on its own; only the named columns are read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trefoil.llm.words import bounded_batches, one_blas_thread, slices, split, strings
from trefoil.session import discard, materialize

#: Words at most that are tokens of their own, how often they must occur, tokens that rare words share, bits of their count table at most.
OWN, OWN_COUNT, SHARED_TOKENS, BITS = 6144, 4, 256, 22
#: Buckets in a packed row on the way to the driver, as bits.
BLOCK_BITS = 16
#: Neighbours on each side, width of the layer, tokens that are classes of their own, tokens in a class.
SIDE, WIDTH, ALONE, CLASS_SIZE = 2, 16, 64, 96
PLACES = [p for p in range(-SIDE, SIDE + 1) if p]
#: Tokens in a training step and in a scoring step, learning rate.
BATCH, SCORE_BATCH, RATE = 8192, 16384, 0.1
#: Words for which a shard is made, words for which a task is made beyond Spark's own number of them, replicas averaged at once.
SHARD_WORDS, TASK_WORDS, FAN_IN = 1 << 20, 1 << 26, 8
#: The warm-up's bounded sample of texts, characters of the stretch that is taken of a longer text, and passes over it.
WARM_DOCS, WARM_CHARS, WARM_PASSES = 200, 10_000, 4
SEED = 5


@dataclass
class Vocabulary:
    """Sorted hashes of own words and their tokens; log counts of rare words by bucket; log mass of each shared token. Own tokens come first, the pad last."""

    hashes: np.ndarray
    token: np.ndarray
    log_count: np.ndarray
    log_mass: np.ndarray
    words: int

    @property
    def own(self) -> int:
        return len(self.hashes)

    @property
    def tokens(self) -> int:
        return self.own + SHARED_TOKENS

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token of each word, and the log share that the word has of its token."""
        shared = (h >> np.uint64(8)) % np.uint64(SHARED_TOKENS)
        token, share = (self.own + shared).astype(np.int64), self.log_count[_bucket(h, len(self.log_count))] - self.log_mass[shared.astype(np.int64)]
        if self.own:
            at = np.minimum(np.searchsorted(self.hashes, h), self.own - 1)
            known = self.hashes[at] == h
            token, share = np.where(known, self.token[at], token), np.where(known, 0.0, share)
        return token, share


def _bucket(h: np.ndarray, size: int) -> np.ndarray:
    return ((h >> np.uint64(20)) & np.uint64(size - 1)).astype(np.int64)


def _class(token: np.ndarray) -> np.ndarray:
    return np.where(token < ALONE, token, ALONE + (token - ALONE) // CLASS_SIZE)


@dataclass
class Network:
    """Embeddings by place (places, tokens + 1, width); output and bias of the classes and of the tokens within them."""

    embed: np.ndarray
    top: np.ndarray
    top_bias: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, self.top, self.top_bias, self.out, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.arrays()])

    @staticmethod
    def shapes(tokens: int) -> list[tuple[int, ...]]:
        classes = int(_class(np.array([tokens - 1]))[0]) + 1
        return [(len(PLACES), tokens + 1, WIDTH), (WIDTH, classes), (classes,), (tokens, WIDTH), (tokens,)]

    @staticmethod
    def of(flat: np.ndarray, tokens: int) -> Network:
        shapes = Network.shapes(tokens)
        ends = np.cumsum([int(np.prod(x)) for x in shapes])
        return Network(*[flat[e - int(np.prod(x)) : e].reshape(x).copy() for x, e in zip(shapes, ends, strict=True)])

    @staticmethod
    def start(tokens: int) -> Network:
        rng = np.random.default_rng(SEED)
        a, b, c, d, e = Network.shapes(tokens)
        return Network(rng.normal(0, 0.1, a).astype(np.float32), rng.normal(0, 0.1, b).astype(np.float32), np.zeros(c, dtype=np.float32), rng.normal(0, 0.1, d).astype(np.float32), np.zeros(e, dtype=np.float32))


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words, which of them each word is, and the texts' bounds among the words."""
    apart = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"([[:punct:]]+)", r" \1 ")
    codes, words, bounds = split(apart)
    return pd.util.hash_array(strings(words), categorize=False), codes, bounds


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch)


def word_counts(docs: DataFrame) -> DataFrame:
    """``(hash, n)`` of every word over all documents; each step of a task adds up its own first."""

    def run(batches):
        for part in _texts(batches):
            seen, codes, _ = hashed(part.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), pa.array(np.bincount(codes, minlength=len(seen)))], ["hash", "n"])

    return bounded_batches(docs.select("text")).mapInArrow(run, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))


def _packed(rows: pa.Table) -> pa.Table:
    """The log counts of one block's buckets, in their order; zero where a bucket counts as one."""
    logs = np.zeros(1 << BLOCK_BITS, dtype=np.float32)
    logs[rows.column("bucket").to_numpy() & ((1 << BLOCK_BITS) - 1)] = np.log(rows.column("n").to_numpy())
    return pa.table({"block": rows.column("block")[:1], "logs": pa.array([logs.tobytes()], pa.binary())})


def vocabulary(docs: DataFrame) -> Vocabulary:
    """The count table is written to the shared folder; only its most frequent words and the counts of rare ones by bucket come to the driver."""
    counts = materialize(word_counts(docs), "word-counts")
    total = counts.agg(F.count("*").alias("kinds"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    top = counts.where(F.col("n") >= OWN_COUNT).orderBy(F.desc("n"), "hash").limit(OWN).collect()
    hashes = np.array([r["hash"] for r in top], dtype=np.int64)
    order = np.argsort(hashes.view(np.uint64))
    size = 1 << min(BITS, max(12, ceil(log2(max(total["kinds"], 1))) + 2))
    least = (top[-1]["n"], top[-1]["hash"]) if top else (None, None)
    # own words are those before the last one in the order they were taken in
    rare = counts.where((F.col("n") < least[0]) | ((F.col("n") == least[0]) & (F.col("hash") > least[1]))) if top else counts
    h = F.col("hash")
    mass = rare.groupBy(F.shiftrightunsigned(h, 8).bitwiseAND(F.lit(SHARED_TOKENS - 1)).alias("shared")).agg(F.sum("n").alias("n")).collect()
    by_bucket = rare.groupBy(F.shiftrightunsigned(h, 20).bitwiseAND(F.lit(size - 1)).alias("bucket")).agg(F.sum("n").alias("n")).where("n > 1")
    # packed on the executors: the driver gets a few binary rows, not one for each bucket
    blocks = by_bucket.withColumn("block", F.shiftright("bucket", BLOCK_BITS)).groupBy("block").applyInArrow(_packed, "block bigint, logs binary")
    log_count = np.zeros(max(size, 1 << BLOCK_BITS), dtype=np.float32)
    for r in blocks.collect():
        log_count[r["block"] << BLOCK_BITS : (r["block"] + 1) << BLOCK_BITS] = np.frombuffer(r["logs"], dtype=np.float32)
    log_count = log_count[:size]
    log_mass = np.zeros(SHARED_TOKENS, dtype=np.float32)
    for r in mass:
        log_mass[r["shared"]] = np.log1p(r["n"])
    discard(counts)
    return Vocabulary(hashes.view(np.uint64)[order], order.astype(np.int64), log_count, log_mass, int(total["words"]))


def _windows(vocab: Vocabulary, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all texts with pads between, where the real ones are, the texts' bounds among the real ones, and the log share of each."""
    h, codes, bounds = hashed(texts)
    token, share = (x.take(codes) for x in vocab.look_up(h))
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.arange(len(codes)) + SIDE * (text + 1)
    tokens = np.full(len(codes) + SIDE * (len(bounds) + 1), vocab.tokens, dtype=np.int64)
    tokens[at] = token
    return tokens, at, bounds, share


#: Arrays that steps write into by shape: fresh ones of this size would cost more than the work on them.
_room: dict[tuple, np.ndarray] = {}


def _logits(h: np.ndarray, weights: np.ndarray, small: bool, most: int | None = None) -> np.ndarray:
    """Of a layer that ends in ones, by weights whose last row is the bias; with ``most`` in an array that the next call with the same ``most`` and classes uses again. Unless known to be ``small``, logits are held to 80, against overflow."""
    if most and (most, weights.shape[1]) not in _room:
        _room[most, weights.shape[1]] = np.empty((most, weights.shape[1]), dtype=np.float32)
    x = np.matmul(h, weights, out=_room[most, weights.shape[1]][: len(h)] if most else None)
    return x if small else np.minimum(x, 80, out=x)


def _sums(x: np.ndarray) -> np.ndarray:
    return x @ np.ones(x.shape[1], dtype=x.dtype)


def _softmax(x: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Probabilities in place of logits, each row times its weight."""
    np.exp(x, out=x)
    x *= ((1 if weight is None else weight) / _sums(x))[:, None]
    return x


def _log_share(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log-probability of one column of each row; the logits are used up."""
    own = x[np.arange(len(x)), at]
    return own - np.log(_sums(np.exp(x, out=x)))


def _hidden(net: Network, tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The tanh layer, and a column of ones for the bias."""
    hidden = np.ones((len(at), WIDTH + 1), dtype=np.float32)
    total = net.embed[0].take(tokens.take(at + PLACES[0]), axis=0)
    for i, p in enumerate(PLACES[1:], 1):
        total += net.embed[i].take(tokens.take(at + p), axis=0)
    np.tanh(total, out=hidden[:, :WIDTH])
    return hidden


def _with_bias(net: Network) -> tuple[np.ndarray, np.ndarray, bool]:
    """Weights of classes (by column) and tokens (by row), the bias last, and whether no logit of a tanh layer can exceed 80 by them."""
    over, inner = np.concatenate([net.top, net.top_bias[None]]), np.concatenate([net.out, net.bias[:, None]], axis=1)
    return over, inner, bool(max(np.abs(over).sum(axis=0).max(), _sums(np.abs(inner)).max()) < 80)


def _by_class(klass: np.ndarray) -> Iterator[tuple[slice, int, int]]:
    """From classes in ascending order: the run of each class that has several tokens, the class's first token and how far it goes."""
    cuts = np.flatnonzero(np.concatenate([[True], klass[1:] != klass[:-1]])) if len(klass) else np.zeros(0, dtype=np.int64)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(klass)], strict=True):
        if klass[a] >= ALONE:
            first = ALONE + (int(klass[a]) - ALONE) * CLASS_SIZE
            yield slice(a, b), first, first + CLASS_SIZE


def _in_order(tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in the order of their tokens' classes, that order, and the classes."""
    klass = _class(tokens[at]).astype(np.uint16)
    order = np.argsort(klass, kind="stable")
    return at[order], order, klass[order]


class Trainer:
    """Adagrad over minibatches of masked tokens."""

    def __init__(self, net: Network, vocab: Vocabulary):
        self.net, self.vocab, self.seen = Network.of(net.flat(), vocab.tokens), vocab, 0
        self.sums = [np.full_like(x, 1e-4) for x in self.net.arrays()]

    def _step(self, param: np.ndarray, total: np.ndarray, grad: np.ndarray) -> None:
        total += grad * grad
        param -= RATE * grad / np.sqrt(total)

    def learn(self, texts: pa.Array, weights: np.ndarray | None = None) -> None:
        """Steps over the texts' tokens, each with the weight of its text."""
        tokens, every, bounds, _ = _windows(self.vocab, texts)
        weight = np.ones(len(every), dtype=np.float32) if weights is None else np.repeat(weights, np.diff(bounds)).astype(np.float32)
        self.seen += float(weight.sum(dtype=np.float64))
        net = self.net
        for i in range(0, len(every), BATCH):
            at, order, klass = _in_order(tokens, every[i : i + BATCH])
            part = weight[i : i + BATCH].take(order)
            part /= part.sum()
            here, n = tokens.take(at), np.arange(len(at))
            hidden, (over, inner, small) = _hidden(net, tokens, at), _with_bias(net)
            p = _softmax(_logits(hidden, over, small, BATCH), part)
            p[n, klass] -= part
            back = p @ net.top.T
            out = np.zeros_like(inner)
            for rows, a, b in _by_class(klass):
                h, own = hidden[rows], part[rows]
                q = _softmax(_logits(h, inner[a:b].T, small), own)
                q[n[: len(h)], here[rows] - a] -= own
                back[rows] += q @ net.out[a:b]
                out[a:b] = q.T @ h
            top = hidden.T @ p
            back *= 1 - hidden[:, :WIDTH] ** 2
            for k, place in enumerate(PLACES):
                # only the rows of the tokens that occur there change
                there = tokens.take(at + place).astype(np.uint16)
                order = np.argsort(there, kind="stable")
                there = there.take(order)
                start = np.flatnonzero(np.concatenate([[True], there[1:] != there[:-1]]))
                grad, rows = np.add.reduceat(back.take(order, axis=0), start, axis=0), there.take(start).astype(np.int64)
                total = self.sums[0][k].take(rows, axis=0) + grad * grad
                self.sums[0][k][rows] = total
                net.embed[k][rows] -= RATE * grad / np.sqrt(total)
            for param, total, grad in zip(net.arrays()[1:], self.sums[1:], (top[:-1], top[-1], out[:, :-1], out[:, -1]), strict=True):
                self._step(param, total, grad)


#: Texts that a training step takes together, so that its steps don't depend on how Spark cut the batches.
LEARN_TEXTS = 64


class Shard:
    """A replica in training on rows that come in the order of their hash, copies next to each other."""

    def __init__(self, start: Network, vocab: Vocabulary):
        self.trainer, self.last, self.texts, self.weights = Trainer(start, vocab), None, pa.array([], pa.string()), np.zeros(0)

    def add(self, texts: pa.Array, h: np.ndarray, weight: np.ndarray) -> None:
        """Learn full groups of distinct texts; what is left waits, and so does the last text, of which copies may follow."""
        first = np.flatnonzero(np.concatenate([[len(self.weights) == 0 or h[0] != self.last], h[1:] != h[:-1]]))
        before = int(first[0]) if len(first) else len(h)
        if before:
            self.weights[-1] += weight[:before].sum()
        if len(first):
            self.texts = pa.concat_arrays([self.texts, texts.take(pa.array(first)).cast(pa.string())])
            self.weights = np.concatenate([self.weights, np.add.reduceat(weight, first)])
        self.last = h[-1]
        full = max(len(self.weights) - 1, 0) // LEARN_TEXTS * LEARN_TEXTS
        for i in range(0, full, LEARN_TEXTS):
            self.trainer.learn(self.texts.slice(i, LEARN_TEXTS), self.weights[i : i + LEARN_TEXTS])
        self.texts, self.weights = self.texts.slice(full), self.weights[full:]

    def end(self) -> tuple[float, np.ndarray]:
        """Tokens seen, and the replica."""
        if len(self.weights):
            self.trainer.learn(self.texts, self.weights)
        return self.trainer.seen, self.trainer.net.flat()


def warm_start(docs: DataFrame, vocab: Vocabulary) -> Network:
    """A network that has seen a small sample of texts, or stretches of long ones; it only gives all replicas one start."""
    h = F.xxhash64("text")
    able = docs.select("text", h.alias("h")).where(F.length("text") > 0)
    share = min(1.0, WARM_DOCS / max(able.count(), 1))
    at = F.when(F.length("text") > WARM_CHARS, 1 + F.pmod(F.shiftright("h", 30), F.length("text") - WARM_CHARS)).otherwise(F.lit(1)).cast("int")
    drawn = able.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)) + (share >= 1.0)).select(F.substring("text", at, F.lit(WARM_CHARS)).alias("text"), "h")
    texts = [r.text for r in drawn.dropDuplicates(["h"]).orderBy("h").limit(2 * WARM_DOCS).collect()]
    trainer = Trainer(Network.start(vocab.tokens), vocab)
    for _ in range(WARM_PASSES if texts else 0):
        trainer.learn(pa.array(texts, pa.string()))
    return trainer.net


def _average(rows: pa.Table) -> pa.Table:
    """One replica from a few, weighted by tokens."""
    rows = rows.sort_by("replica")
    weight = rows.column("tokens").to_numpy().astype(np.float64)
    total = np.zeros(len(np.frombuffer(rows.column("net")[0].as_py(), dtype=np.float32)))
    for w, net in zip(weight, rows.column("net"), strict=True):
        total += w * np.frombuffer(net.as_py(), dtype=np.float32)
    mean = (total / max(weight.sum(), 1)).astype(np.float32).tobytes()
    return pa.table({"replica": pa.array([rows.column("group")[0].as_py()], pa.int64()), "tokens": pa.array([float(weight.sum())], pa.float64()), "net": pa.array([mean], pa.binary())})


def train(docs: DataFrame, vocab: Vocabulary | None = None) -> tuple[Vocabulary, Network]:
    """A network trained on all of ``docs``."""
    vocab = vocab or vocabulary(docs)
    start = warm_start(docs, vocab)
    shared = docs.sparkSession.sparkContext.broadcast((vocab, start))
    session = docs.sparkSession
    shards = max(1, -(-vocab.words // SHARD_WORDS))
    tasks = min(shards, max(int(session.conf.get("spark.sql.shuffle.partitions")), vocab.words // TASK_WORDS))

    def replicas(batches):
        one_blas_thread()
        shard, at, total, seen = None, -1, None, 0.0

        def ended():
            n, net = shard.end()
            return net.astype(np.float64) * n if total is None else total + net.astype(np.float64) * n, seen + n

        for part in _texts(batches):
            number, h, weight = (part.column(c).to_numpy() for c in ("shard", "h", "weight"))
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1, [len(number)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if number[a] != at:
                    if shard:
                        total, seen = ended()
                    shard, at = Shard(shared.value[1], shared.value[0]), int(number[a])
                shard.add(part.column("text").slice(a, b - a), h[a:b], weight[a:b])
        if shard:
            total, seen = ended()
            if seen:
                mean = (total / seen).astype(np.float32).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([at * tasks // shards], pa.int64()), pa.array([seen], pa.float64()), pa.array([mean], pa.binary())], ["replica", "tokens", "net"])

    # shards next to each other share a task, and no task gets more of them than another by chance
    dealt = deal(docs, shards).repartitionById(tasks, F.floor(F.col("shard") * tasks / shards).cast("int")).sortWithinPartitions("shard", "h")
    shape = "replica bigint, tokens double, net binary"
    nets = materialize(bounded_batches(dealt).mapInArrow(replicas, shape), "replicas")
    while nets.count() > 1:
        grouped = nets.withColumn("group", F.floor(F.col("replica") / FAN_IN).cast("bigint")).groupBy("group")
        last, nets = nets, materialize(grouped.applyInArrow(_average, shape), "replicas")
        discard(last)
    found = nets.collect()
    discard(nets)
    return vocab, Network.of(np.frombuffer(found[0]["net"], dtype=np.float32), vocab.tokens) if found else start


def deal(docs: DataFrame, shards: int) -> DataFrame:
    """``(text, h, weight, shard)`` of all rows with text; weights of a text add up to its number of rows.

    A text with more copies than a shard's mean number of rows (fewer than ``shards`` texts can have that many) comes once for
    each of the shards that its share of the rows is worth; copies of others all go to one shard, which merges them.
    """
    rows = docs.select("text", F.xxhash64("text").alias("h")).where(F.length("text") > 0)
    home = F.pmod("h", F.lit(shards))
    plain = ["text", "h", F.lit(1.0).alias("weight"), home.alias("shard")]
    if shards == 1:
        return rows.select(*plain)
    every = rows.count()
    counts = rows.groupBy("h").agg(F.count("*").alias("copies"))
    hot = F.broadcast(materialize(counts.where(F.col("copies") * shards > every), "hot-texts"))
    worth = F.ceil(F.col("copies") * shards / F.lit(every))
    spread = rows.join(hot, "h").dropDuplicates(["h"]).select("text", "h", (F.col("copies") / worth).alias("weight"), F.explode(F.sequence(F.lit(0), worth - 1)).alias("part"))
    spread = spread.select("text", "h", "weight", F.pmod(home + F.col("part"), F.lit(shards)).alias("shard"))
    return rows.join(hot, "h", "left_anti").select(*plain).unionByName(spread)


def log_probs(vocab: Vocabulary, net: Network, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Log-probability of each token given its window, and the texts' bounds."""
    tokens, every, bounds, share = _windows(vocab, texts)
    out, (over, inner, small) = share.astype(np.float64), _with_bias(net)
    for i in range(0, len(every), SCORE_BATCH):
        at, order, klass = _in_order(tokens, every[i : i + SCORE_BATCH])
        here = tokens.take(at)
        hidden = _hidden(net, tokens, at)
        found = _log_share(_logits(hidden, over, small, SCORE_BATCH), klass).astype(np.float64)
        for rows, a, b in _by_class(klass):
            found[rows] += _log_share(_logits(hidden[rows], inner[a:b].T, small), here[rows] - a)
        out[i + order] += found
    return out, bounds


def score(docs: DataFrame, model: tuple[Vocabulary, Network] | None = None, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` with ``n_tokens``, ``log_prob`` (summed) and ``mean_log_prob``; trains on ``docs`` unless given a model."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))
    given = docs.select(*columns, *([] if "text" in columns else ["text"]))
    kinds = dict(given.dtypes)

    def run(batches):
        one_blas_thread()
        for part in _texts(batches):
            each, bounds = log_probs(*shared.value, part.column("text"))
            total = np.concatenate([[0.0], np.cumsum(each)])
            n, summed = np.diff(bounds), total[bounds[1:]] - total[bounds[:-1]]
            mean = pa.array(summed / np.maximum(n, 1), mask=n == 0)
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], pa.array(n), pa.array(summed), mean], [*columns, "n_tokens", "log_prob", "mean_log_prob"])

    return bounded_batches(given).mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in columns], "n_tokens bigint, log_prob double, mean_log_prob double"]))
