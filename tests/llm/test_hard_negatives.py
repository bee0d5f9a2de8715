import math
import random

import numpy as np
import pyarrow as pa

from tests.conftest import SF, duck_rows, rows_of
from trefoil.llm import hard_negatives as H
from trefoil.llm import queries, sql


def plain(data):
    """All pairs, by the definition; data is a list of (vec_id, embedding, label)."""
    rows = set()
    for i, e, label in data:
        if i is None or label is None or not e or any(x is None or not math.isfinite(x) for x in e):
            continue
        rows.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * float(np.float32(x))) for x in e)))
    dot = lambda p, q: sum(x * y for x, y in zip(p, q, strict=False))
    out = []
    for i, label, q in rows:
        if i % 100:
            continue
        near = sorted((-dot(q, r), j) for j, other, r in rows if other == label and j != i)[:5]
        far = sorted((-dot(q, r), j) for j, other, r in rows if other != label)
        for minus, p in near:
            fit = [(s, j) for s, j in far if 30 * -minus <= 100 * -s <= 90 * -minus][:10]
            out += [(i, p, k + 1, j, -minus, -s) for k, (s, j) in enumerate(fit)]
    return sorted(out)


def mined(spark, data):
    df = spark.createDataFrame([(*r, "x", 3) for r in data], "vec_id bigint, embedding array<float>, label int, key string, q int")
    got = H.mine(df).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(map(tuple, got.collect()))


def test_against_all_pairs(spark):
    rng = random.Random(1)
    data = [(i, [rng.uniform(-1, 1) + 0.6 for _ in range(12)], rng.randrange(4)) for i in range(900)]
    common = [0.5] * 12
    data += [(10_000 + i, common, i % 3) for i in range(400)] + [(500, common, 1)] * 40
    data += [(1, None, 2), (2, [0.1, None] * 6, 1), (3, [float("nan")] * 12, 1), (4, [float("inf")] + [0.0] * 11, 0), (None, common, 1), (5000, common, None), (5100, [], 1), (700, [0.9] * 5, 2)]
    assert mined(spark, data) == plain(data)


def test_few_rows_and_none(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 0.0], 2)]) == [(100, 1, 1, 2, 65536, 32768)]
    assert isinstance(mined(spark, [(100, [3e38], 1), (1, [-3e38], 1), (2, [1.0], 2)]), list)
    assert mined(spark, [(100, [1.0], 1), (1, [-1.0], 1), (2, [-0.5], 2)]) == []


def test_bounds_hold_and_few_rows_are_scored():
    rng = np.random.default_rng(3)
    q = np.floor(rng.normal(0, 40, (4000, 64))).astype(np.int64)
    edges = np.stack([np.concatenate([[c.min()], np.quantile(c, np.arange(1, 256) / 256).astype(np.int64), [c.max() + 1]]) for c in q.T])
    edges = np.maximum.accumulate(edges, axis=1)
    table = pa.table({"vec_id": np.arange(4000), "label": np.arange(4000) % 5, "q": pa.array(list(q))})
    file = H.Approximations(table, edges)
    low, high = file.bounds(q[:50], slice(0, 4000))
    exact = q[:50] @ q.T
    assert (low <= exact).all() and (exact <= high).all()
    scored = []
    own = file.exact
    file.exact = lambda a, rows: (scored.append(len(rows)), own(a, rows))[1]
    anchors = {"vec_id": np.arange(50), "label": np.arange(50) % 5, "key": np.arange(50), "q": q[:50]}
    list(H.best_of_label(anchors, file))
    assert np.mean(scored) < 40  # of 800 rows of the label


def test_query_against_sql(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        columns, want = duck_rows(sql.HARD_NEGATIVES, sf)
        found = queries.op12_hard_negatives(spark, sf)
        assert sorted(found.columns) == columns and rows_of(found) == want and want
