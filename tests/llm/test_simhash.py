import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.conftest import SF
from trefoil.llm import components, queries
from trefoil.llm import words as W
from trefoil.llm import simhash as H


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots(ids, pairs):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute(rows):
    prints = {i: plain_fingerprint(t) for i, t in rows}
    return prints, roots(prints, [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 4])


def test_four_bytes_always_contain_a_triple():
    assert len(H.TRIPLES) == 20
    assert all(any(set(t) <= set(q) for t in H.TRIPLES) for q in combinations(range(8), 4))


def test_fingerprints():
    long = " ".join(random.Random(1).choices("alpha beta gamma delta eps ÄÖ Zeta".split(), k=30000))
    for t in (None, "", " \t\x0b", "One", "one Two three", "A b c d", "a\xa0b c d e f", "x " * 700, long):
        assert H.fingerprint(t) == plain_fingerprint(t)


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    prints, root = brute(rows)
    got = queries.op9_simhash_near_dedup(spark, SF).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{prints[i]:016x}", root[i]) for i, _ in rows} and len(got) == len(rows)


def chains(spark, n=400, seed=4):
    """Fingerprints around a few centres, some at the limit of linking."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(6)]
    values = set()
    while len(values) < n:
        x = rng.choice(centres)
        for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4, 5, 7, 9])):
            x ^= 1 << b
        values.add(x)
    return linked_frame(spark, values)


def linked_frame(spark, values):
    rows = [(f, int(np.uint64(f).astype(np.int64))) for f in sorted(values)]
    want = roots([i for _, i in rows], [(a[1], b[1]) for a, b in combinations(rows, 2) if (a[0] ^ b[0]).bit_count() <= 4])
    return spark.createDataFrame([(i,) for _, i in rows], "fp bigint"), want


def test_pairs_that_share_four_bytes_only_are_found_in_split_postings(spark, monkeypatch):
    rng = random.Random(12)
    values = {rng.getrandbits(32) for _ in range(150)}
    for x in list(values)[:60]:
        # one bit in each of the four bytes that are not the same for all
        values.add(x ^ sum(1 << (8 * b + rng.randrange(8)) for b in range(4)))
    df, want = linked_frame(spark, values)
    assert len(set(want.values())) < len(want)
    for limit in (H.OVERSIZE, 20):
        monkeypatch.setattr(H, "OVERSIZE", limit)
        assert roots(want, [(r.u, r.v) for r in H.links(df).distinct().collect()]) == want


def test_links_span_the_same_components(spark, monkeypatch):
    df, want = chains(spark)
    for limit in (H.OVERSIZE, 5):
        monkeypatch.setattr(H, "OVERSIZE", limit)
        found = H.links(df).distinct().collect()
        assert roots(want, [(r.u, r.v) for r in found]) == want
        assert len(found) < 20 * len(want)


def test_components(spark):
    rng = random.Random(8)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, 2000 + i) for i in range(1, 90)] + [(5, 5), (7, None)]
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    real = [(a, b) for a, b in pairs if b is not None and a != b]
    assert got == roots({x for p in real for x in p}, real)
    assert components.connected(spark.createDataFrame([], "u bigint, v bigint")).collect() == []


def test_nulls_repeats_and_clashing_columns(spark):
    data = [(3, None, 1), (2, "", 2), (5, "same words in this text", 3), (5, "same words in this text", 4), (4, "SAME words  in this\ntext", 5), (None, "same words in this text", 6), (None, "other", 7)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, fp int")
    got = sorted(map(tuple, H.near_duplicates(df).collect()), key=repr)
    f = f"{plain_fingerprint('same words in this text'):016x}"
    assert got == sorted([(3, "0" * 16, 2), (2, "0" * 16, 2), (5, f, 4), (5, f, 4), (4, f, 4), (None, f, 4), (None, f"{plain_fingerprint('other'):016x}", None)], key=repr)
    kept = H.representatives(df, ("doc_id", "text")).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([(2, ""), (4, "SAME words  in this\ntext"), (None, "other")], key=repr)
    assert H.near_duplicates(df.limit(0)).collect() == []


def test_null_ids_bridge_components(spark, monkeypatch):
    prints = {"a": 0x0F, "b": 0xFF, "c": 0xFFF}
    made = lambda docs, columns=("doc_id",): docs.withColumn("fp", F.create_map(*[F.lit(x) for kv in prints.items() for x in kv])[F.col("text")].cast("bigint")).select(*columns, "fp")
    monkeypatch.setattr(H, "fingerprints", made)
    df = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "doc_id bigint, text string")
    assert {(r.doc_id, r.component_id) for r in H.near_duplicates(df).collect()} == {(1, 1), (None, 1), (2, 1)}
    assert [tuple(r) for r in H.representatives(df, ("doc_id", "text")).collect()] == [(1, "a")]


def test_representatives_are_rows(spark):
    a, b, c = "one text that has a copy", "another text without any copy at all", "third text of the same id but not of the same words"
    data = [(1, a), (5, a), (5, b), (5, c), (None, a), (None, a), (None, "only here under no id at all"), (None, "only here under no id at all"), (7, c)]
    for rows in (data, data[::-1]):
        df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
        kept = sorted(map(tuple, H.representatives(df, ("doc_id", "text")).collect()), key=repr)
        assert kept == sorted([(1, a), (5, b), (5, c), (None, "only here under no id at all")], key=repr)


@pytest.mark.parametrize("most", [0, 100])
def test_rows_are_removed_either_way(spark, monkeypatch, most):
    monkeypatch.setattr(W, "REMOVED_ROWS", most)
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(20)] + [(3, "again"), (None, "no number")], "k bigint, text string")
    removed = spark.createDataFrame([(3, 1), (3, 2), (7, 1), (99, 1)], "k bigint, other int")
    left = W.without(rows, removed, "k")
    assert ("BroadcastHashJoin" in left._jdf.queryExecution().executedPlan().toString()) == (most > 0)
    assert sorted(r.text for r in left.collect()) == sorted([f"text {i}" for i in range(20) if i not in (3, 7)] + ["no number"])
    assert W.without(rows, removed.limit(0), "k").count() == 22 and W.without(rows.limit(0), removed, "k").count() == 0
