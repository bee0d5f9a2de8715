import random
import re
from collections import Counter

from tests.conftest import SF, duck_rows, rows_of
from trefoil.llm import quality as Q
from trefoil.llm import queries, sql


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = list(zip(words, words[1:], words[2:], strict=False))
    many = Counter(grams)
    covered = {i + d for i, g in enumerate(grams) if many[g] > 1 for d in range(3)}
    return len(words), sum(map(len, words)), sum(c in Q.SYMBOLS for c in text or ""), len(lines) - len(set(lines)), len(covered)


def texts():
    rng = random.Random(6)
    out = [None, "", " \t\n\x0b\x0c\r ", "one", "a b", "a b c", "a b c a b c", "x x x x", "é ü\nß\n\né ü\n  \n é ü", "a\xa0b c", "#*$ %&| <>", "the end " * 30000]
    return out + ["".join(rng.choice(["a ", "b ", "c\n", "d\t", "## ", "é", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(150)]


def test_measurements_against_plain_python(spark):
    data = [(i, t, "x", 7) for i, t in enumerate(texts())]
    df = spark.createDataFrame(data, "doc_id bigint, text string, words string, n_words int")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in Q.measure(df).collect()}
    assert got == {i: plain(t) for i, t, _, _ in data}


def test_ledger_policies_and_ablations(spark):
    assert Q.mask(("symbols", "symbols")) == Q.bit("symbols") == 4
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts())] + [(900, "good words stand here and there " + " ".join(f"w{i}ord" for i in range(80)))] * 2, "doc_id bigint, text string")
    ledger = Q.ledger(df)
    rows = ledger.collect()
    kept = [r.doc_id for r in Q.apply_policy(ledger, Q.POLICIES["v1"]).where("kept").collect()]
    assert kept == [900, 900]
    base = Q.mask(Q.POLICIES["base"])
    assert all(bool(r.fail_bits & base) == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in rows)
    for r in Q.ablations(ledger).collect():
        m, b = Q.mask(Q.POLICIES[r.policy]), Q.bit(r.rule)
        assert (r.documents, r.failed, r.failed_alone, r.kept) == (len(rows), sum(bool(x.fail_bits & b) for x in rows), sum(x.fail_bits & m == b for x in rows), sum(not x.fail_bits & m for x in rows))
    assert Q.ledger(df.limit(0)).collect() == []


def test_query_against_sql(spark):
    got = queries.op2_quality_ledger(spark, SF)
    columns, want = duck_rows(sql.QUALITY)
    assert sorted(got.columns) == columns and rows_of(got) == want
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_clean_documents_are_kept(spark):
    good = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1")
    judged = queries.op2_quality_ledger(spark, SF).join(good, "doc_id").where("not base_failed")
    n = judged.count()
    assert n and judged.where("kept").count() >= 0.97 * n
