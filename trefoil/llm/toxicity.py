"""Toxicity by a weighted finite-state pattern grammar over clauses.

A clause's words become symbols, and transducers pass them on, the output of one being the input of the next:

* negation marks the insults and threats that it bears on,
* reported speech marks all that follow it,
* insult and threat pass on what offends: a negated threat is none,
* target joins a marked insult or threat with the person it is aimed at, on either side of it, and writes the clause's
  patterns: aimed or not, negated or not, reported or not. Each has its weight, and a threat without its object is none.
  An insult is aimed at anybody, a threat only at those addressed: what happens to a third person is told, not threatened.

Their composition is one automaton; a clause scores the weights of the patterns that it accepts, each times the lexical
weight of its own offence. A text's clause scores by pattern go through a logistic model to a score. Insults (whole words,
and stems where many different completions occur mostly in toxic texts) and the logistic weights are learned from labels; the other
word classes are fixed lists. What labels show too rarely is stated as a few clauses with their verdicts (``POLICY``), which
the logistic model learns like texts: one insult aimed at nobody is not toxic, one aimed at somebody is, and so is a threat with its object.

Defined results: null, empty and word-less texts match nothing and score the base rate of such texts; very long
texts are read whole; repeated rows are scored each on its own; only the named columns are read; an empty table
gives no rows. With no labels to learn from (or one class only) every score is 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trefoil.llm.words import ROLL, bounded_batches, characters, held_out, letters, slices, split, stratified, whole_hashes

# Word lists in English, German, French and Spanish.
TARGETS = "you your yourself dich dir ihr euch toi te vous usted ustedes vosotros".split()
THIRDS = "he she they them him her ihn ihm ihnen elle ils elles eux lui ella ellos ellas".split()
NEGATIONS = "not never neither nor isn't aren't don't nicht kein keine keinen niemals nie pas jamais ni nunca tampoco".split()
REPORTS = "said says say wrote writes called calls quoted reported claims claimed sagte sagt schrieb nannte behauptet dit disait écrit appelé dijo dice escribió llamó".split()
THREATS = (
    "kill kills killed killing hurt hurts hurting destroy destroys destroyed destroying attack attacks attacked beat beats murder murders murdered burn burns threaten threatens threatened "
    "töten töte tötet getötet umbringen umbringe zerstören zerstöre zerstört schlagen schlage schlägt tuer tue tuerai tuera détruire détruirai frapper frappe frapperai matar mato mataré matará mata destruir destruiré golpear golpearé"
).split()
#: Symbols that the first transducer reads.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, THIRD = range(7)
#: Words that a target and a negation reach.
TARGET_REACH, NEGATION_REACH = 5, 3
#: Weights of a pattern that is aimed, unaimed, negated, reported.
AIMED, UNAIMED, NEGATED, REPORTED = 1.5, 0.75, 0.5, 0.7
CLAUSE_ENDS = ".,;:!?"
#: Bounds of the labelled sample: rows of each label, and characters of the stretch that is taken of a longer text.
TRAIN_DOCS, TRAIN_CHARS = 3000, 8_000
#: Lengths of stems; different completions and next letters that a stem needs in toxic texts; share of its texts that one longer stem may have.
STEMS, COMPLETIONS, NEXT_LETTERS, ONE_BRANCH = (4, 5, 6, 7, 8), 5, 4, 0.8
#: Texts that agree in the SKETCH smallest hashes of their words of LONG letters or more, under one of three seeds, are copies of one another.
SKETCH, LONG = 3, 8
#: Words and stems that at most may be taken for insults by chance (a bound on their expected number), and share of clean texts (of the share of toxic ones) that may hold an insult.
CHANCE, CLEAN_SHARE = 5.0, 0.05
#: The same share for a stem, which a text has to use more than once before it counts for much.
STEM_CLEAN_SHARE = 0.15
#: Patterns: kind (insult, threat) x aimed x negated x reported.
PATTERNS = 16

#: Clauses with their verdicts, each the only one of texts of several lengths in words, and how many drawn rows each of these texts stands for.
POLICY = (
    ((INSULT,), 0), ((NEGATION, INSULT), 0), ((TARGET, NEGATION, INSULT), 0), ((REPORT, TARGET, INSULT), 0), ((REPORT, TARGET, THREAT), 0), ((THREAT,), 0),
    ((TARGET, INSULT), 1), ((TARGET, THREAT), 1),
)
POLICY_WORDS, POLICY_ROWS = (4, 8, 16), 5.0

#: What a transducer writes: symbols with weights. A symbol is (class, marks); marks are bits.
Tape = tuple[tuple[tuple[int, int], float], ...]
NEG_MARK, REP_MARK, AIM_MARK = 2, 4, 1


@dataclass
class Transducer:
    """Reads a symbol, moves and writes: ``step(state, symbol) -> (state, tape)``; ``final(state)`` is what it writes at the clause's end."""

    start: tuple
    step: Callable[[tuple, tuple[int, int]], tuple[tuple, Tape]]
    final: Callable[[tuple], Tape] = lambda state: ()


def negation() -> Transducer:
    """Marks insults and threats within reach after a negation; the state counts down."""

    def step(state, symbol):
        kind, marks = symbol
        if kind == NEGATION:
            return (NEGATION_REACH,), ()
        hit = state[0] > 0 and kind in (INSULT, THREAT)
        return (max(state[0] - 1, 0),), (((kind, marks | NEG_MARK * hit), 1.0),)

    return Transducer((0,), step)


def report() -> Transducer:
    """Marks every insult and threat after a verb of saying."""

    def step(state, symbol):
        kind, marks = symbol
        if kind == REPORT:
            return (1,), ()
        hit = state[0] and kind in (INSULT, THREAT)
        return state, (((kind, marks | REP_MARK * bool(hit)), 1.0),)

    return Transducer((0,), step)


def offence(kind: int, unless: int = 0) -> Transducer:
    """Passes an offence of one kind on, or as an ordinary word if it has the mark ``unless``, and the rest as it is."""
    return Transducer((), lambda state, symbol: (state, (((OTHER, 0) if symbol[0] == kind and symbol[1] & unless else symbol, 1.0),)))


def target() -> Transducer:
    """Joins an offence with a target at most TARGET_REACH words before or after it.

    State: words for which the last target of any person, and the last one addressed, still reach; the offence that waits for one, and for how many words.
    """

    def pattern(kind: int, marks: int) -> Tape:
        weight = (AIMED if marks & AIM_MARK else UNAIMED) * (NEGATED if marks & NEG_MARK else 1) * (REPORTED if marks & REP_MARK else 1)
        return (((kind, marks), weight),)

    def let_go(waiting) -> Tape:
        return pattern(*waiting) if waiting and waiting[0] == INSULT else ()

    def step(state, symbol):
        reach, addressed, waiting, left = state
        kind, marks = symbol
        if kind == TARGET:
            return (TARGET_REACH, TARGET_REACH, None, 0), pattern(waiting[0], waiting[1] | AIM_MARK) if waiting else ()
        out: Tape = ()
        if kind == THIRD and waiting and waiting[0] == INSULT:
            out, waiting, left = pattern(INSULT, waiting[1] | AIM_MARK), None, 0
        elif waiting and left == 1:
            out, waiting, left = let_go(waiting), None, 0
        elif waiting:
            left -= 1
        if kind in (INSULT, THREAT):
            if reach if kind == INSULT else addressed:
                out += pattern(kind, marks | AIM_MARK)
            else:
                out, waiting, left = out + let_go(waiting), symbol, TARGET_REACH
        return (TARGET_REACH if kind == THIRD else max(reach - 1, 0), max(addressed - 1, 0), waiting, left), out

    return Transducer((0, 0, None, 0), step, lambda state: let_go(state[2]))


def _feed(machine: Transducer, state: tuple, tape: Tape) -> tuple[tuple, Tape]:
    out: list = []
    for symbol, weight in tape:
        state, wrote = machine.step(state, symbol)
        out += [(s, w * weight) for s, w in wrote]
    return state, tuple(out)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """What ``second`` writes when it reads what ``first`` writes."""

    def step(state, symbol):
        a, tape = first.step(state[0], symbol)
        b, out = _feed(second, state[1], tape)
        return (a, b), out

    def final(state):
        b, out = _feed(second, state[1], first.final(state[0]))
        return out + second.final(b)

    return Transducer((first.start, second.start), step, final)


@dataclass
class Automaton:
    """A transducer as tables by state (and symbol): next state, and the ``(pattern, weight)`` pairs written, at the clause's end, too."""

    next: list[list[int]] = field(default_factory=list)
    out: list[list[tuple]] = field(default_factory=list)
    last: list[tuple] = field(default_factory=list)


def compiled(machine: Transducer) -> Automaton:
    """The tables of all reachable states."""
    patterns = lambda tape: tuple((8 * (s[0] == THREAT) + s[1], w) for s, w in tape)
    number, todo, auto = {machine.start: 0}, [machine.start], Automaton()
    for state in todo:
        auto.next.append([])
        auto.out.append([])
        for symbol in range(7):
            after, tape = machine.step(state, (symbol, 0))
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            auto.next[-1].append(number[after])
            auto.out[-1].append(patterns(tape))
        auto.last.append(patterns(machine.final(state)))
    return auto


def cascade() -> list[Transducer]:
    """The grammar's transducers in the order in which they read one another."""
    return [negation(), report(), offence(INSULT), offence(THREAT, unless=NEG_MARK), target()]


def grammar() -> Automaton:
    """The composed grammar; a pattern's bits are aimed, negated, reported, threat."""
    return compiled(reduce(compose, cascade()))


@dataclass
class Model:
    """Sorted hashes of insults with their weights, whole words first and then stems by length, and logistic weights (bias last)."""

    hashes: list[np.ndarray]
    weights: list[np.ndarray]
    logistic: np.ndarray


def _hash_words(words: list[str]) -> np.ndarray:
    points, bounds = characters(pa.array(words, pa.string()))
    return whole_hashes(points, bounds[:-1], np.diff(bounds))


_fixed: dict[int, np.ndarray] = {}


def _fixed_classes() -> dict[int, np.ndarray]:
    if not _fixed:
        _fixed.update({symbol: np.sort(_hash_words(words)) for symbol, words in ((TARGET, TARGETS), (THIRD, THIRDS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS))})
    return _fixed


def _member(sorted_hashes: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(sorted_hashes):
        return np.zeros(len(h), dtype=bool)
    return sorted_hashes[np.minimum(np.searchsorted(sorted_hashes, h), len(sorted_hashes) - 1)] == h


def _core(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case code points, start and length of each word's part from first to last letter, and whether the word ends a clause."""
    text = [w.lower() for w in words.to_pylist()]
    points, bounds = characters(pa.array(text, pa.string()))
    n = len(points)
    start, size = bounds[:-1].copy(), np.diff(bounds)
    if not n:
        return points, start, size, np.zeros(len(text), dtype=bool)
    where = np.arange(n)
    is_letter = letters()[points]
    filled = size > 0
    first, last = np.full(len(text), n), np.full(len(text), -1)
    first[filled] = np.minimum.reduceat(np.where(is_letter, where, n), bounds[:-1][filled])
    last[filled] = np.maximum.reduceat(np.where(is_letter, where, -1), bounds[:-1][filled])
    none = last < 0
    ends = np.isin(points[np.maximum(bounds[1:] - 1, 0)], [ord(c) for c in CLAUSE_ENDS]) & filled
    return points, np.where(none, 0, first), np.where(none, 0, last - first + 1), ends


def _symbols(model: Model, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, lexical weight and clause end of each distinct word."""
    points, start, size, ends = _core(words)
    symbol, weight = np.zeros(len(words), dtype=np.int64), np.ones(len(words))
    whole = whole_hashes(points, start, size)
    for kind, hashes in _fixed_classes().items():
        symbol[_member(hashes, whole) & (size > 0)] = kind
    lexical = np.zeros(len(words))
    for i, k in enumerate((0, *STEMS)):
        if len(model.hashes[i]):
            h = whole_hashes(points, start, np.minimum(size, k)) if k else whole
            found = _member(model.hashes[i], h) & (size >= max(k, 1))
            at = np.minimum(np.searchsorted(model.hashes[i], h), len(model.hashes[i]) - 1)
            lexical = np.where(found, np.maximum(lexical, model.weights[i][at]), lexical)
    insult = lexical > 0
    symbol[insult] = INSULT
    weight[insult] = lexical[insult]
    return symbol, weight, ends


def clause(automaton: Automaton, symbols: list[int], weights: list[float]) -> tuple[list[float], int, float]:
    """Weights by pattern, accepted patterns and score of one clause. A pattern takes the lexical weight of its own offence.

    Where an offence is read and an aimed pattern written, that offence follows its target; all other patterns are of the offence that waited.
    """
    state, sums, count, waiting = 0, [0.0] * PATTERNS, 0, 0.0
    for s, own in zip([*symbols, None], [*weights, 0.0], strict=True):
        offends = s in (INSULT, THREAT)
        for pattern, w in automaton.last[state] if s is None else automaton.out[state][s]:
            at_once = offends and bool(pattern & AIM_MARK)
            sums[pattern] += w * (own if at_once else waiting)
            count += 1
            offends = offends and not at_once
        waiting = own if offends else waiting
        state = state if s is None else automaton.next[state][s]
    return sums, count, sum(sums)


def policy(automaton: Automaton, heavy: float) -> tuple[np.ndarray, np.ndarray]:
    """Features and verdicts of the stated clauses, their insults of weight ``heavy``."""
    x, y = [], []
    for symbols, verdict in POLICY:
        sums, count, total = clause(automaton, list(symbols), [heavy if s == INSULT else 1.0 for s in symbols])
        for n in POLICY_WORDS:
            x.append([*np.log1p(sums), total, np.log1p(count), np.sqrt(count / n), 0.0])
            y.append(verdict)
    return np.array(x), np.array(y, dtype=float)


def features(model: Model, texts: pa.Array, automaton: Automaton) -> np.ndarray:
    """Per text: clause scores summed by pattern (log1p), the best clause, the log count of accepted patterns, their share of the words, and what clauses besides the best one score (log1p)."""
    codes, words, bounds = split(texts)
    symbol, weight, ends = _symbols(model, words)
    out = np.zeros((len(bounds) - 1, PATTERNS + 4))
    s = symbol[codes]
    hits = np.flatnonzero((s == INSULT) | (s == THREAT))
    if not len(hits):
        return out
    # clauses end at their marks and with their text; only those with an offence are run
    stops = np.unique(np.concatenate([np.flatnonzero(ends[codes]) + 1, bounds]))
    of = np.unique(np.searchsorted(stops, hits, side="right"))
    row = np.searchsorted(bounds, stops[of - 1], side="right") - 1
    counts = np.zeros(len(out))
    for r, a, b in zip(row.tolist(), stops[of - 1].tolist(), stops[of].tolist(), strict=True):
        sums, count, total = clause(automaton, s[a:b].tolist(), weight[codes[a:b]].tolist())
        out[r, :PATTERNS] += sums
        out[r, PATTERNS] = max(out[r, PATTERNS], total)
        counts[r] += count
    out[:, PATTERNS + 3] = np.log1p(np.maximum(out[:, :PATTERNS].sum(axis=1) - out[:, PATTERNS], 0))
    out[:, :PATTERNS] = np.log1p(out[:, :PATTERNS])
    out[:, PATTERNS + 1] = np.log1p(counts)
    out[:, PATTERNS + 2] = np.sqrt(counts / np.maximum(np.diff(bounds), 1))
    return out


def without_copies(texts: list[set[str]]) -> list[int]:
    """Numbers of texts of which no earlier one is a near copy, so that a word that one text brings along in a thousand copies counts once."""
    seen: set[tuple] = set()
    out = []
    for i, words in enumerate(texts):
        long = sorted(w for w in words if len(w) >= LONG)
        if len(long) < SKETCH:
            keys = [tuple(sorted(words))]
        else:
            h = pd.util.hash_array(np.array(long, dtype=object), categorize=False)
            keys = [(seed, *np.sort(h * (2 * np.uint64(seed) + ROLL))[:SKETCH].tolist()) for seed in range(3)]
        if not any(k in seen for k in keys):
            out.append(i)
        seen.update(keys)
    return out


def learned(toxic: list[set[str]], clean: list[set[str]]) -> dict[str, tuple[float, int]]:
    """Insults with weight and stem length (0: a whole word) from the words of toxic and of clean texts.

    A word counts when more of its texts are toxic than chance gives any of all the candidates (an exponential bound on the
    binomial tail), and hardly any clean text holds it. A stem must pass the same test with all its completions together, go on in many
    ways, and not hang on one longer stem or one word.
    """
    counted = Counter(w for words in toxic for w in words)
    following: dict[str, dict[str, int]] = {}
    for w, n in counted.items():
        for k in STEMS:
            if len(w) > k:
                following.setdefault(w[:k], {})[w] = n
    stems = {s for s, words in following.items() if len(words) >= COMPLETIONS and len({w[len(s)] for w in words}) >= NEXT_LETTERS}
    stems |= {s + c for s in stems for c in {w[len(s)] for w in following[s]}}
    keys: dict[str, tuple] = {}
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for y, texts in ((1, toxic), (0, clean)):
        for words in texts:
            found_keys: set = set()
            for w in words:
                if w not in keys:
                    keys[w] = (*([(w, 0)] if w in counted else []), *((w[:k], k) for k in range(STEMS[0], min(STEMS[-1] + 2, len(w))) if w[:k] in stems))
                found_keys.update(keys[w])
            seen[y].update(found_keys)
    if not toxic or not clean:
        return {}
    q = len(toxic) / (len(toxic) + len(clean))
    need = math.log(max(len(seen[1]), 1) / CHANCE)

    def odds(key) -> float:
        n1, n0 = seen[1][key], seen[0][key]
        p = n1 / (n1 + n0)
        if p <= q or n0 * len(toxic) > (STEM_CLEAN_SHARE if key[1] else CLEAN_SHARE) * n1 * len(clean):
            return 0.0
        bound = (n1 + n0) * (p * math.log(p / q) + ((1 - p) * math.log((1 - p) / (1 - q)) if p < 1 else 0.0))
        return math.log((n1 + 0.5) / (len(toxic) + 1)) - math.log((n0 + 0.5) / (len(clean) + 1)) if bound >= need else 0.0

    found: dict[str, tuple[float, int]] = {}
    for k in STEMS:
        for stem in sorted(s for s, n in seen[1] if n == k):
            words = following[stem]
            n1 = seen[1][stem, k]
            if len(words) < COMPLETIONS or len({w[k] for w in words}) < NEXT_LETTERS or any(stem[:j] in found for j in STEMS if j < k) or max(words.values()) > ONE_BRANCH * n1:
                continue
            if max((seen[1][stem + c, k + 1] for c in {w[k] for w in words}), default=0) > ONE_BRANCH * n1 or not odds((stem, k)):
                continue
            found[stem] = (min(odds((stem, k)), 8.0) / 4, k)
    of_stem = {s: w for s, (w, _) in found.items()}
    for word, n in sorted(seen[1]):
        # a word that a stem covers is kept where it alone says more
        own = min(odds((word, 0)), 8.0) / 4 if n == 0 and len(word) > 1 else 0.0
        if own > max((of_stem.get(word[:j], 0.0) for j in STEMS), default=0.0):
            found[word] = (own, 0)
    return found


def fit(rows: list[tuple]) -> Model:
    """Learn insults and pattern weights from ``(text, toxic)`` or ``(text, toxic, weight)`` rows."""
    rows = [(r[0] or "", int(r[1]), float(r[2]) if len(r) > 2 else 1.0) for r in rows if r[1] is not None]
    y = np.array([r[1] for r in rows], dtype=float)
    none = [np.zeros(0, dtype=np.uint64)] * (1 + len(STEMS)), [np.zeros(0)] * (1 + len(STEMS))
    if not len(rows) or y.min() == y.max():
        return Model(*none, np.zeros(0))
    words = [set(re.findall(r"[^\W\d_]+", r[0].lower())) for r in rows]
    single = without_copies(words)
    found = learned([words[i] for i in single if rows[i][1]], [words[i] for i in single if not rows[i][1]])
    hashes, weights = [], []
    for k in (0, *STEMS):
        own = [s for s, (_, n) in found.items() if n == k]
        h = _hash_words(own) if own else none[0][0]
        order = np.argsort(h)
        hashes.append(h[order])
        weights.append(np.array([found[s][0] for s in own])[order] if own else np.zeros(0))
    model = Model(hashes, weights, np.zeros(0))
    automaton = grammar()
    x = features(model, pa.array([r[0] for r in rows]), automaton)
    # a row counts for as many as it was drawn for, in all as many as were drawn
    each = np.array([r[2] for r in rows])
    each *= len(rows) / each.sum()
    stated, verdicts = policy(automaton, max((w for w, _ in found.values()), default=1.0))
    x, y, each = np.concatenate([x, stated]), np.concatenate([y, verdicts]), np.concatenate([each, np.full(len(verdicts), POLICY_ROWS)])
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), 1.0)
    ridge[-1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (each * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    model.logistic = w
    return model


def score_texts(model: Model, texts: pa.Array, automaton: Automaton) -> np.ndarray:
    if not len(model.logistic):
        return np.zeros(len(texts))
    x = features(model, texts, automaton)
    return 1 / (1 + np.exp(-np.clip(x @ model.logistic[:-1] + model.logistic[-1], -30, 30)))


def training_sample(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> list[tuple[str, int, float]]:
    """About ``most`` labelled texts of each label outside the held-out fold, or stretches of long ones; bounded whatever the tables' sizes. A document with two labels counts as toxic."""
    able = labels.select("doc_id", "toxic").where(~held_out()).where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in able.groupBy("toxic").count().collect()}
    # ids are drawn before they meet the texts, generously, so that what is broadcast stays small
    share = F.element_at(F.create_map(*[x for y, n in counts.items() for x in (F.lit(y), F.lit(min(1 << 30, int(2 * most / n * (1 << 30)))))]), F.col("toxic")) if counts else F.lit(0)
    drawn = able.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)
    return stratified(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id"), "toxic", most, TRAIN_CHARS)


def score(docs: DataFrame, labels: DataFrame | None = None, model: Model | None = None, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` of ``docs`` with ``score``; fits on a bounded labelled sample unless given a model."""
    model = model or fit(training_sample(docs, labels))
    shared = docs.sparkSession.sparkContext.broadcast((model, grammar()))
    given = docs.select(*columns, *([] if "text" in columns else ["text"]))

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], pa.array(score_texts(shared.value[0], part.column("text"), shared.value[1]))], [*columns, "score"])

    kinds = dict(given.dtypes)
    return bounded_batches(given).mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in columns], "score double"]))


__all__ = ["Automaton", "Model", "Transducer", "cascade", "clause", "compiled", "compose", "features", "fit", "grammar", "learned", "score", "score_texts", "training_sample"]
