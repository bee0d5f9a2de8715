from collections import defaultdict

import duckdb

from tests.conftest import SF, duck_rows, rows_of
from trefoil.llm import preference as P
from trefoil.llm import queries, sql


def plain(rows):
    """Expected rows by hand: (pair, segment, turn, role, rendered, trained)."""
    one = {}
    for conv, turn, role, text in rows:
        if conv is not None and turn is not None:
            v = (role if role is not None else "unknown", text if text is not None else "")
            one[conv, turn] = min(v, one.get((conv, turn), v))
    pairs = defaultdict(lambda: ({}, {}))
    for (conv, turn), v in one.items():
        pairs[conv // 2][conv % 2][turn] = v
    out = []
    for pair, (a, b) in pairs.items():
        differ = [t for t in {*a, *b} if a.get(t) != b.get(t)]
        cut = min(differ) if differ else None
        for segment, side in (("chosen", a), ("rejected", b)):
            for t, (role, text) in side.items():
                shared = cut is None or t < cut
                if shared and segment == "rejected":
                    continue
                s = f"<|{role}|>\n{text}<|end|>\n"
                trained = s[len(role) + 5 :] if not shared and role == "assistant" else ""
                out.append((pair, "prompt" if shared else segment, t, role, s, trained))
    return sorted(out)


ROWS = [
    (0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (0, 2, "user", "more"), (0, 3, "assistant", "good é"), (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "more"), (1, 3, "assistant", "bad"), (1, 4, "assistant", "worse"),
    (2, 0, "user", "same"), (2, 1, "assistant", "same"), (3, 0, "user", "same"), (3, 1, "assistant", "same"), (4, 0, "user", "alone"), (4, 1, "assistant", None), (6, 0, None, "x"), (7, 0, None, "x"), (7, 1, "assistant", ""), (8, 0, "user", "b"), (8, 0, "user", "a"),
    (8, 0, "user", "a"), (9, 0, "user", "a"), (None, 0, "user", "lost"), (10, None, "user", "lost"), (12, 1, "assistant", "late"), (13, 0, "user", "early"), (13, 1, "assistant", "late"), (14, 0, "assistant", "x" * 200000), (15, 0, "assistant", "y"),
]


def test_against_plain_python(spark):
    df = spark.createDataFrame([(*r, 1, "z") for r in ROWS], "conv_id bigint, turn bigint, role string, text string, pair_id int, side string")
    got = P.format_pairs(df).collect()
    assert sorted((r.pair_id, r.segment, r.turn, r.role, r.rendered, r.rendered[r.train_from : r.train_to]) for r in got) == plain(ROWS)
    assert {r.pair_id for r in got if not r.paired} == {2}
    assert rows_of(P.format_pairs(df, P.consecutive_pairs(df))) == rows_of(P.format_pairs(df))
    assert P.format_pairs(df.limit(0)).collect() == []


def spans(text):
    return [tuple(map(int, x.split("-"))) for x in text.split(",") if x]


def test_examples(spark):
    df = spark.createDataFrame(ROWS, "conv_id bigint, turn bigint, role string, text string")
    got = {r.pair_id: r for r in P.examples(P.format_pairs(df)).collect()}
    first = got[0]
    assert first.prompt == "<|user|>\nhi<|end|>\n<|assistant|>\nyes<|end|>\n<|user|>\nmore<|end|>\n"
    assert [first.chosen[a:b] for a, b in spans(first.chosen_mask)] == ["good é<|end|>\n"]
    assert [first.rejected[a:b] for a, b in spans(first.rejected_mask)] == ["bad<|end|>\n", "worse<|end|>\n"]
    assert (got[1].chosen, got[1].rejected) == ("", "")
    assert not got[2].paired and got[0].paired
    parts = P.examples(P.format_pairs(df.where("conv_id < 2")), block=2).orderBy("part").collect()
    assert len(parts) == 3 and all("".join(r[s] for r in parts) == first[s] for s in ("prompt", "chosen", "rejected"))
    assert [r.rejected[a:b] for r in parts for a, b in spans(r.rejected_mask)] == ["bad<|end|>\n", "worse<|end|>\n"]


def test_examples_of_any_turn_numbers(spark):
    turns = [1_000_000, 1_000_600, 5_000_000_000, 1 << 40]
    rows = [(c, t, ("user", "assistant")[k % 2], f"text {k if k < 3 else c}") for c in (0, 1) for k, t in enumerate(turns)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, part string, at int")
    (one,) = P.examples(P.format_pairs(df)).collect()
    assert one.prompt.count("<|end|>") == 3 and one.paired
    assert (one.chosen, one.rejected) == ("<|assistant|>\ntext 0<|end|>\n", "<|assistant|>\ntext 1<|end|>\n")
    parts = P.examples(P.format_pairs(df), block=3).orderBy("part").collect()
    assert [r.part for r in parts] == [0, 1] and parts[0].prompt == one.prompt and parts[1].chosen == one.chosen
    assert P.examples(P.format_pairs(df.limit(0))).collect() == []


def test_ids_beyond_what_a_double_holds(spark):
    big = 2**54
    rows = [(big + 2, 0, "user", "hi"), (big + 3, 0, "user", "hi"), (big + 2, 1, "assistant", "a"), (big + 3, 1, "assistant", "b"), (-(2**62) - 2, 0, "user", "n"), (-(2**62) - 1, 0, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = P.format_pairs(df).collect()
    assert {(r.pair_id, r.segment, r.turn, r.paired) for r in got} == {(big // 2 + 1, "prompt", 0, True), (big // 2 + 1, "chosen", 1, True), (big // 2 + 1, "rejected", 1, True), (-(2**61) - 1, "prompt", 0, True)}
    con = duckdb.connect()
    con.execute("create table conversations as select * from (values " + ", ".join(f"({c}::bigint, {t}, '{r}', '{x}')" for c, t, r, x in rows) + ") v(conv_id, turn, role, text)")
    assert {tuple(r) for r in con.sql(f"select pair_id, segment, turn, paired from ({sql.PREFERENCE})").fetchall()} == {(r.pair_id, r.segment, r.turn, r.paired) for r in got}


def test_query_against_sql(spark):
    got = queries.op7_preference_formatting(spark, SF)
    columns, want = duck_rows(sql.PREFERENCE)
    assert sorted(got.columns) == columns and rows_of(got) == want
    columns, want = duck_rows(sql.EXAMPLES)
    pairs = queries.preference_examples(spark, SF)
    assert sorted(pairs.columns) == columns and rows_of(pairs) == want and "Python" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
