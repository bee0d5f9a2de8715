import random

from tests.conftest import SF, duck_rows, rows_of
from trefoil.llm import line_dedup as L
from trefoil.llm import queries, sql

FOLD = str.maketrans(L.UPPER, L.LOWER)


def plain(rows):
    """The definition, row by row; a null id comes after all others."""
    order = lambda i: (i is None, i)
    first, out = {}, []
    key = lambda line: line.strip(L.SPACE).translate(FOLD)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                first[key(line)] = min(first.get(key(line), i), i, key=order)
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == i]
        out.append((i, "\n".join(kept), len(lines) - len(kept), len(lines)))
    return sorted(out, key=repr)


def got(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id bigint, text string, h1 int, keep string, place int")
    return sorted(((r.doc_id, r.kept_text, r.n_dropped, r.n_lines) for r in L.deduplicate(df).collect()), key=repr)


def test_cases_by_hand(spark):
    long = "this line is long enough"
    rows = [
        (5, f"{long}\nshort\n{long}\nown line of five"), (3, f"  {long.upper()}\t\nshort\n"), (9, None), (8, ""), (7, f"{long}\n{long}"), (None, f"{long}\nonly null holds it"), (None, "only null holds it"),
        (3, f"{long} \r\nother text of three"), (5, f"{long}\nshort\n{long}\nown line of five"), (11, "123456789\n1234567890\nÀÉÎÕÜàéîõü"), (12, "1234567890\nàéîõüàéîõü\nÀÉÎÕÜàéîõü"), (13, "\n\n \n"),
    ]
    assert got(spark, rows) == plain(rows)
    assert got(spark, []) == []


def test_random_texts_and_hot_lines(spark):
    rng = random.Random(4)
    pool = [f"line number {i} " + "x" * (i % 7) for i in range(60)] + ["tiny", "", "  "]
    rows = [(rng.choice([None, *range(300)]), "\n".join(rng.choice([x, x.title()]) for x in rng.choices(pool, k=rng.randint(0, 30)))) for _ in range(500)]
    rows += [(1000 + i, "the very common line of all documents\nown words of document " + str(i)) for i in range(400)] + [(7, "one row again and again")] * 300
    assert got(spark, rows) == plain(rows)


def test_long_text(spark):
    rows = [(2, "\n".join(f"numbered line {i // 2}" for i in range(60000))), (1, "numbered line 7\nnumbered line 29999")]
    assert got(spark, rows) == plain(rows)


def test_bitmaps_are_runs_and_plan_is_native(spark):
    df = spark.createDataFrame([(1, "aaaaaaaaaaaa\nbbbbbbbbbbbb"), (2, "x\naaaaaaaaaaaa\nbbbbbbbbbbbb\ny\nz\naaaaaaaaaaaa")], "doc_id bigint, text string")
    (row,) = L.keep_bitmaps(df).collect()
    assert (row.doc_id, row.n_lines, row.n_dropped, [tuple(r) for r in row.keep]) == (2, 6, 3, [(0, 1), (3, 2)])
    plan = L.lost_lines(df)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "Python" not in plan and plan.count("Exchange rangepartitioning") == 1
    window = plan[plan.index("Window") :]
    assert "hashpartitioning(h1" not in window[: window.index("rangepartitioning")]


def test_query_against_sql(spark):
    columns, want = duck_rows(sql.LINE_DEDUP)
    found = queries.op11_line_dedup(spark, SF)
    assert sorted(found.columns) == columns and rows_of(found) == want
    assert any(r[columns.index("n_dropped")] for r in want)
