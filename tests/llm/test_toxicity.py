import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa

from tests.conftest import SF
from trefoil.llm import queries
from trefoil.llm import toxicity as X

SF1 = SF.replace("0.001", "0.1")


def test_held_out_labels():
    rows = duckdb.sql(f"select doc_id, text, toxic from '{SF1}/documents.parquet' join '{SF1}/labels.parquet' using (doc_id) order by doc_id").fetchall()
    held = [zlib.crc32(str(r[0]).encode()) % 3 == 1 for r in rows]
    model = X.fit([(t[: X.TRAIN_CHARS], y) for (_, t, y), h in zip(rows, held, strict=True) if not h])
    test = [(t, y) for (_, t, y), h in zip(rows, held, strict=True) if h]
    p = X.score_texts(model, pa.array([t for t, _ in test]), X.grammar()) >= 0.7
    y = np.array([y for _, y in test]) == 1
    assert (p & y).sum() >= 0.85 * y.sum() and (p & ~y).sum() <= 0.005 * (~y).sum()


    # what labels hardly show is stated: a lone insult is no clause that counts, an aimed one and a threat to somebody are
    innocent = ["idiot", "trash", "the trash was collected on monday", "nobody is stupid here", "she beat him at chess", "you are not an idiot", "he said you are an idiot", "we killed the lights and went home"]
    offensive = ["you are an idiot", "you idiot, you are pathetic", "i will kill you", "I will murder you and burn your house"]
    got = X.score_texts(model, pa.array(innocent + offensive), X.grammar()) >= 0.7
    assert got.tolist() == [False] * len(innocent) + [True] * len(offensive)


def test_held_out_labels_by_language():
    rows = duckdb.sql(f"select doc_id, text, toxic, lang from '{SF1}/documents.parquet' join '{SF1}/labels.parquet' using (doc_id) order by doc_id").fetchall()
    held = [zlib.crc32(str(r[0]).encode()) % 3 == 1 for r in rows]
    model = X.fit([(r[1][: X.TRAIN_CHARS], r[2]) for r, h in zip(rows, held, strict=True) if not h])
    for lang in ("de", "en", "es", "fr"):
        toxic = [r[1] for r, h in zip(rows, held, strict=True) if h and r[2] == 1 and r[3] == lang]
        assert (X.score_texts(model, pa.array(toxic), X.grammar()) >= 0.7).mean() >= 0.8, lang


def small_model():
    toxic = [f"you are an idiot and a moron {i}" for i in range(20)]
    return X.fit([(t, 1) for t in toxic] + [(f"you are the of and an a was here {i} with this not so said", 0) for i in range(60)])


def run(*symbols, weights=None):
    sums, _, _ = X.clause(X.grammar(), list(symbols), weights or [1.0] * len(symbols))
    return {i: round(w, 4) for i, w in enumerate(sums) if w}


def test_clauses_are_accepted_by_pattern():
    assert run(X.INSULT) == {0: 0.75}
    assert run(X.TARGET, X.OTHER, X.INSULT) == run(X.INSULT, X.OTHER, X.OTHER, X.TARGET) == {1: 1.5}
    assert run(X.NEGATION, X.INSULT) == {2: 0.375}
    assert run(X.REPORT, X.TARGET, X.NEGATION, X.INSULT) == {7: 0.525}
    assert run(X.NEGATION, X.OTHER, X.OTHER, X.OTHER, X.INSULT) == {0: 0.75}
    assert run(X.TARGET, X.THREAT) == run(X.THREAT, X.TARGET) == {9: 1.5}
    # a threat without an object, and words alone, are no clause
    assert run(X.THREAT, X.OTHER) == run(X.TARGET, X.NEGATION, X.REPORT) == {}
    f = X.features(small_model(), pa.array(["you idiot", "not idiot", "not so. idiot", "said idiot"]), X.grammar())
    assert f[0, 1] > f[1, 2] > 0 and f[2, 0] > 0 and f[3, 4] > 0


def test_the_composition_is_the_cascade():
    """The compiled automaton against the transducers run one after the other over whole tapes."""
    rng, automaton = random.Random(2), X.grammar()
    for _ in range(4000):
        symbols = [rng.choice([X.OTHER, X.INSULT, X.THREAT, X.TARGET, X.NEGATION, X.REPORT]) for _ in range(rng.randint(0, 14))]
        tape = [((s, 0), 1.0) for s in symbols]
        for machine in X.cascade():
            state, out = machine.start, []
            for symbol, weight in tape:
                state, wrote = machine.step(state, symbol)
                out += [(s, w * weight) for s, w in wrote]
            tape = [*out, *machine.final(state)]
        want = [0.0] * X.PATTERNS
        for (kind, marks), weight in tape:
            want[8 * (kind == X.THREAT) + marks] += weight
        got, count, total = X.clause(automaton, symbols, [1.0] * len(symbols))
        has = any(s in (X.INSULT, X.THREAT) for s in symbols)
        assert np.allclose(got, want if has else 0) and (count == len(tape) or not has) and np.isclose(total, sum(got))


def test_patterns_take_the_weight_of_their_own_offence():
    """The compiled automaton against the definition: each offence with its own weight, aimed if a target is in reach on either side."""
    rng, automaton = random.Random(5), X.grammar()
    for _ in range(4000):
        symbols = [rng.choice([X.OTHER, X.OTHER, X.INSULT, X.THREAT, X.TARGET, X.THIRD]) for _ in range(rng.randint(0, 14))]
        weights = [rng.choice([0.5, 1.0, 2.0]) for _ in symbols]
        want, reach = [0.0] * X.PATTERNS, X.TARGET_REACH
        aims = {X.INSULT: (X.TARGET, X.THIRD), X.THREAT: (X.TARGET,)}
        waiting = None
        for i, s in enumerate([*symbols, None]):
            if waiting is not None:
                kind = symbols[waiting]
                if s in aims[kind]:
                    want[8 * (kind == X.THREAT) + 1] += X.AIMED * weights[waiting]
                    waiting = None
                elif s is None or i - waiting == reach or (s in aims and not set(symbols[max(i - reach, 0) : i]) & set(aims[s])):
                    want[0] += X.UNAIMED * weights[waiting] * (kind == X.INSULT)
                    waiting = None
            if s in aims:
                if set(symbols[max(i - reach, 0) : i]) & set(aims[s]):
                    want[8 * (s == X.THREAT) + 1] += X.AIMED * weights[i]
                else:
                    waiting = i
        assert np.allclose(X.clause(automaton, symbols, weights)[0], want), (symbols, weights)


def test_insults_are_whole_words_or_stems_that_go_on_in_many_ways():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abdeiklmnorstu") for _ in range(rng.randint(3, 9)))
    text = lambda *more: {word() for _ in range(40)} | set(more)
    toxic = [text("moron", "gruzz" + rng.choice("abcdefgh") + word()) for _ in range(60)]
    copies = [toxic[0] | {"bystander"}] * 40
    clean = [text("morning", "clothes", "world") for _ in range(300)]
    single = X.without_copies(toxic + copies + clean)
    assert len(single) == 360
    found = X.learned(toxic, clean)
    assert set(found) == {"moron", "gruzz"} and found["moron"][1] == 0 and found["gruzz"][1] == 5
    model = X.fit([(" ".join(sorted(t)), 1) for t in toxic + copies] + [(" ".join(sorted(t)), 0) for t in clean])
    p = X.score_texts(model, pa.array(["we walked there in the morning", "clothes of the world", "bystander", "you are a gruzzling, you moron"]), X.grammar())
    assert (p[:3] < 0.1).all() and p[3] > 0.7


def test_long_texts_are_learned_from(spark):
    rng = random.Random(4)
    words = lambda: [rng.choice("the of and a here was not with this there so as in".split()) for _ in range(6000)]
    data = [(i, " ".join(w if i % 3 or k % 40 else "idiot" for k, w in enumerate(words()))) for i in range(120)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id bigint, toxic int")
    assert min(len(t) for _, t in data) > 2 * X.TRAIN_CHARS
    got = {r.doc_id: r.score for r in X.score(docs, labels).collect()}
    assert all((got[i] >= 0.7) == (i % 3 == 0) for i in got)
    sample = X.training_sample(docs, labels, 10)
    assert max(len(t) for t, _, _ in sample) <= X.TRAIN_CHARS and {y for _, y, _ in sample} == {0, 1}


def test_query_contract(spark):
    got = queries.op3_toxicity(spark, SF).collect()
    n = duckdb.sql(f"select count(*) from '{SF}/documents.parquet'").fetchall()[0][0]
    assert len(got) == n and all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_nulls_empty_repeats_and_clashing_columns(spark):
    data = [(1, "you idiot, you moron", 9.0), (1, "you idiot, you moron", 8.0), (2, None, None), (3, "", 0.0), (None, "the of and " * 60000, 0.0)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, score double")
    got = {(r.doc_id, r.score >= 0.5) for r in X.score(df, model=small_model()).collect()}
    assert got == {(1, True), (2, False), (3, False), (None, False)}
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0)], "doc_id bigint, toxic int")
    assert [r.score for r in X.score(df, labels).collect()] == [0.0] * 5
    assert X.score(df.limit(0), model=small_model()).collect() == []
