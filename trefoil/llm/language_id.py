"""Language ID by a linear-chain conditional random field over words.

Each word gets scores from hashed affixes (up to three characters), character 2- and 3-grams, and its
membership in lexicons learned per language; learned transitions tie neighbouring words, so a word that two
languages share takes the language around it, and code-switched text gets a label per word. Forward-backward
gives each word's label probabilities; a text's language has the largest share of its letters.

Defined results: null text, empty text and text without a letter give ``und`` and score 0; equal shares go to
the first language by name; repeated rows are scored each on its own; only the named columns are read, so
others, whatever their names, don't matter; an empty table gives no rows. With no labelled text to learn
from, every text is ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from trefoil.llm import crf
from trefoil.llm.words import bounded_batches, characters, letters, prefix_hashes, segment_sum, slices, split, stratified, whole_hashes

#: Buckets of the hashed character features.
BUCKETS = 1 << 16
AFFIX, GRAM = 3, (2, 3)
#: Bounds of the labelled sample that the field is fitted on: texts of each language, and characters of the stretch that is taken of a longer text.
TRAIN_DOCS, TRAIN_CHARS = 200, 4_000
#: Words in a training piece; two pieces of different texts make a sequence, so that switches occur.
PIECE = 24
LEXICON_COUNT, LEXICON_SHARE = 3, 0.6


@dataclass
class Field:
    """A fitted field."""

    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: np.ndarray
    lexicon_language: np.ndarray


def _features(words: pa.StringArray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashed feature numbers and their words; each word's letters and whole-word hash. Case is folded."""
    words = pc.utf8_lower(words)
    points, bounds = characters(words)
    start, size = bounds[:-1], np.diff(bounds)
    n_letters = segment_sum(letters()[points].astype(np.int64), bounds) if len(points) else np.zeros(len(words), dtype=np.int64)
    feature, owner = [], []

    def add(kind: int, value: np.ndarray, of: np.ndarray) -> None:
        mixed = (value + np.uint64(kind)) * np.uint64(0xC2B2AE3D27D4EB4F)
        feature.append(((mixed >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64))
        owner.append(of)

    every = np.arange(len(words))
    for k, h in prefix_hashes(points, start, size, AFFIX):
        add(k, h[size >= k], every[size >= k])
    wordhash = whole_hashes(points, start, size)
    back, where = points[::-1], len(points) - bounds[1:]
    for k, h in prefix_hashes(back, where, size, AFFIX):
        add(10 + k, h[size >= k], every[size >= k])
    of = np.repeat(every, size)
    for k in GRAM:
        if len(points) >= k:
            h = np.zeros(len(points) - k + 1, dtype=np.uint64)
            for i in range(k):
                h = (h ^ points[i : len(points) - k + 1 + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i)
            same = of[: len(h)] == of[k - 1 :]
            add(20 + k, h[same], of[: len(h)][same])
    return feature, owner, n_letters, wordhash


def _lexicon_rows(field_hashes: np.ndarray, language: np.ndarray, wordhash: np.ndarray, k: int) -> np.ndarray:
    """Number of each word's lexicon feature; the last one means no lexicon has it."""
    if not len(field_hashes):
        return np.full(len(wordhash), BUCKETS + k)
    at = np.minimum(np.searchsorted(field_hashes, wordhash), len(field_hashes) - 1)
    return BUCKETS + np.where(field_hashes[at] == wordhash, language[at], k)


def fit(rows: list[tuple[str, str]], seed: int = 7) -> Field:
    """Fit on ``(text, language)`` pairs."""
    rows = sorted((r for r in rows if r[0] and r[1]), key=lambda r: (r[1], r[0]))
    languages = sorted({lang for _, lang in rows})
    k = len(languages)
    if not k:
        return Field([], np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
    codes, words, bounds = split(pa.array([t for t, _ in rows]))
    label = np.repeat([languages.index(lang) for _, lang in rows], np.diff(bounds))
    feature, owner, _, wordhash = _features(words)
    counts = np.stack([np.bincount(codes, label == j, len(words)) for j in range(k)], axis=1)
    total = counts.sum(axis=1)
    known = (total >= LEXICON_COUNT) & (counts.max(axis=1) >= LEXICON_SHARE * total)
    order = np.argsort(wordhash[known], kind="stable")
    lexicon, lexicon_language = wordhash[known][order], counts[known].argmax(axis=1)[order]
    feature.append(_lexicon_rows(lexicon, lexicon_language, wordhash, k))
    owner.append(np.arange(len(words)))
    piece, gold = [], []
    for a, b, lang in zip(bounds, bounds[1:], [languages.index(x) for _, x in rows], strict=False):
        for i in range(a, b, PIECE):
            row = np.full(PIECE, -1)
            row[: min(PIECE, b - i)] = codes[i : min(b, i + PIECE)]
            piece.append(row)
            gold.append(lang)
    shuffled = np.random.default_rng(seed).permutation(len(piece))
    shuffled = np.concatenate([shuffled, shuffled[: len(shuffled) % 2]])
    seq = np.stack(piece)[shuffled].reshape(-1, 2 * PIECE)
    labels = np.repeat(np.array(gold)[shuffled], PIECE).reshape(-1, 2 * PIECE)
    weights, transitions = crf.train(feature, owner, BUCKETS + k + 1, seq, labels, k)
    return Field(languages, weights.astype(np.float32), transitions, lexicon, lexicon_language)


def label_words(field: Field, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label probabilities of every word, its letters, and the texts' bounds among the words."""
    codes, words, bounds = split(texts)
    feature, owner, n_letters, wordhash = _features(words)
    k = len(field.languages)
    feature.append(_lexicon_rows(field.lexicon, field.lexicon_language, wordhash, k))
    owner.append(np.arange(len(words)))
    emit = np.zeros((len(words), k))
    for f, of in zip(feature, owner, strict=True):
        for j in range(k):
            emit[:, j] += np.bincount(of, field.weights[f, j], len(words))
    emit[n_letters == 0] = 0
    return crf.posteriors(emit[codes], bounds, field.transitions), n_letters[codes], bounds


def predict(field: Field, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    if not field.languages:
        return ["und"] * len(texts), np.zeros(len(texts))
    post, n_letters, bounds = label_words(field, texts)
    mass = segment_sum(post * n_letters[:, None], bounds)
    total = segment_sum(n_letters, bounds)
    share = mass / np.maximum(total, 1)[:, None]
    best = share.argmax(axis=1)
    score = np.where(total > 0, np.clip(share.max(axis=1), 0, 1), 0.0)
    return [field.languages[b] if t else "und" for b, t in zip(best, total, strict=True)], score


def training_sample(docs: DataFrame, most: int = TRAIN_DOCS) -> list[tuple[str, str]]:
    """About ``most`` labelled texts of each language outside the held-out fold, or stretches of long ones; bounded whatever the table's size, and rare languages are learned like frequent ones."""
    return [(text, lang) for text, lang, _ in stratified(docs, "lang", most, TRAIN_CHARS)]


def detect(docs: DataFrame, field: Field | None = None, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` of ``docs`` with ``lang_pred`` and ``score``; fits on a bounded sample of ``docs`` unless given a field."""
    field = field or fit(training_sample(docs))
    shared = docs.sparkSession.sparkContext.broadcast(field)
    given = docs.select(*columns, *([] if "text" in columns else ["text"]))

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                lang, score = predict(shared.value, part.column("text"))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], pa.array(lang, pa.string()), pa.array(score)], [*columns, "lang_pred", "score"])

    kinds = dict(given.dtypes)
    return bounded_batches(given).mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in columns], "lang_pred string", "score double"]))
