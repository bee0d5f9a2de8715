import random
import re
from collections import Counter, defaultdict

from tests.conftest import SF, duck_rows, rows_of
from trefoil.llm import divergence as D
from trefoil.llm import queries, sql

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows):
    """The definition over ``(text, lang, source)`` rows, every group against every kept term."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = [w.translate(FOLD) for w in re.findall(D.TERM, text or "")]
        groups[lang].add(source)
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        terms = sorted(t for t, n in docs[lang].items() if n >= 10)
        v = len(terms)
        p = {}
        for key in [*sources, None]:
            own = Counter() if key is not None else sum((counts[lang, s] for s in sources), Counter())
            own = counts[lang, key] if key is not None else own
            n = sum(own[t] for t in terms)
            p[key] = {t: 1 + 10**9 * (own[t] + 2) // (n + 2 * v) for t in terms}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        ranked = lambda values, most: sorted(values, key=lambda x: (-x[1], x[0].encode()))[:most]
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in terms)) for o in sources if o != s]
            best = [(t, f(p[s][t], p[None][t])) for t in terms if counts[lang, s][t] and p[s][t] > p[None][t]]
            out += [(lang, s, "pair", o, x, i + 1) for i, (o, x) in enumerate(ranked(pairs, None))]
            out += [(lang, s, "term", t, x, i + 1) for i, (t, x) in enumerate(ranked(best, 10))]
    return sorted(out)


def audited(spark, rows):
    df = spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(rows)], "doc_id bigint, text string, lang string, source string, term string, n int")
    return sorted(map(tuple, D.audit(df).select("lang", "source", "part", "item", "value", "rank").collect()))


def test_against_the_definition(spark):
    rng = random.Random(2)
    words = ["Alpha", "alpha", "beta", "gamma", "Été", "été", "naïve", "x", "日本", "delta9", "it's", "o\x00p"] + [f"w{c}" for c in "abcdefghij"]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 40))), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "B", "é", None, "c"])) for _ in range(400)]
    rows += [(None, "en", "empty"), ("", "xx", "one"), ("12 34", "xx", "two"), (None, None, None), ("rare words only", "de", "s1"), ("others", "de", "s2")]
    rows += [("alpha beta " * 5, "en", "hot")] * 300 + [("long " * 100_000, "fr", "long")]
    assert audited(spark, rows) == plain(rows)
    assert audited(spark, []) == []


def test_task_counts(monkeypatch):
    monkeypatch.setattr(D, "COUNT_BYTES", 200)
    import pyarrow as pa

    batch = lambda k: pa.RecordBatch.from_pydict({"lang": ["en"] * 9, "source": ["a", "b", "c"] * 3, "text": [f"A{chr(97 + i)} b{chr(97 + k)} b{chr(97 + k)} aa" for i in range(9)]})
    total = Counter()
    for b in D._count(iter([batch(k) for k in range(12)])):
        for r in b.to_pylist():
            total[r["term"]] += r["docs"]
            total.update({(s, r["term"]): n for s, n in zip(r["sources"], r["ns"], strict=True)})
    assert (total["a", "ba"], total["ba"], total["a", "aa"], total["aa"], total["b", "ab"], total["ab"]) == (6, 9, 48, 108, 12, 12)


def test_query_against_sql(spark):
    columns, want = duck_rows(sql.DIVERGENCE, SF)
    found = queries.op13_source_divergence(spark, SF)
    assert sorted(found.columns) == columns and rows_of(found) == want and want
