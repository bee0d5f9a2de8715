"""Messages, triplets, blocks, cells, relabelled lists, statistics and lazy plans, against plain Python."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import trefoil
from tests.test_graph import DIR, brute, census, graph
from trefoil.functions.classify import TRIAD_CLASSES
from trefoil.operators import blocks as B
from trefoil.operators import cells
from trefoil.operators import kernels as K
from trefoil.operators import normalize as N
from trefoil.operators import orient as O
from trefoil.operators import stats as S
from trefoil.operators.messages import aggregate_messages, lookup, triplets
from trefoil.plans.algorithms import DIRECTED, UNDIRECTED
from trefoil.plans.statistics import measured_count
from trefoil.plans.transformers import TriangleCounter


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def random_edges(seed, n=40, m=300):
    rng = random.Random(seed)
    return [(rng.randint(0, n), rng.randint(0, n)) for _ in range(m)]


def hub_edges():
    """A vertex joined to all others, which are a ring."""
    return [(0, i) for i in range(1, 400)] + [(i, i + 1) for i in range(1, 399)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_triplets_have_null_states(spark):
    edges = spark.createDataFrame([(1, 2, "p"), (2, 3, "q"), (1, 2, "r"), (9, 1, "s"), (7, 8, "t"), (None, 1, "u")], "src bigint, dst bigint, name string")
    state = spark.createDataFrame([(1, 10, None), (2, 20, "two"), (7, None, None)], "v bigint, n int, label string")
    got = {r.name: (r.src_state and tuple(r.src_state), r.dst_state and tuple(r.dst_state)) for r in triplets(edges, state).collect()}
    one, two = (10, None), (20, "two")
    assert got == {"p": (one, two), "q": (two, None), "r": (one, two), "s": (None, one), "t": ((None, None), None), "u": (None, one)}
    assert triplets(edges.limit(0), state).collect() == [] and all(r.src_state is None for r in triplets(edges, state.limit(0)).collect())
    clash = edges.withColumnRenamed("name", "n")
    assert triplets(clash, state).columns == ["src", "dst", "n", "src_state", "dst_state"]


def test_triplets_by_block_and_shared_layout(spark):
    edges = spark.createDataFrame([(1, 2)], "src bigint, dst bigint")
    state = spark.createDataFrame([(1, 0, 5), (1, 1, 6), (2, 1, 7), (2, 2, 8)], "v bigint, block int, n int")
    got = rows(triplets(edges, state, by=["block"]).select("block", "src_state.n", "dst_state.n"))
    assert got == [(0, 5, None), (1, 6, 7)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = triplets(graph(spark, random_edges(1)), S.degrees(graph(spark, random_edges(1))))
        df.collect()
        assert "ReusedExchange" in plan_of(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_messages_merge(spark):
    edges = spark.createDataFrame([(1, 2, 5), (1, 3, 7), (2, 3, 1), (3, 1, None), (4, 4, 2)], "src bigint, dst bigint, w int")
    state = spark.createDataFrame([(1, 100), (2, 200), (3, 300)], "v bigint, x int")
    found = aggregate_messages(edges, {"total": F.sum, "most": F.max}, to_dst={"total": F.col("w"), "most": F.col("src_state.x")}, state=state)
    assert rows(found) == [(1, None, 300), (2, 5, 100), (3, 8, 200), (4, 2, None)]
    both = aggregate_messages(edges, {"n": F.sum}, {"n": F.lit(1)}, {"n": F.lit(10)}, where=F.col("src") != F.col("dst"))
    assert rows(both) == [(1, 12), (2, 11), (3, 21)]
    lists = aggregate_messages(edges, {"ids": lambda c: F.flatten(F.collect_list(c))}, to_dst={"ids": F.array("src")}, shares=3)
    assert {r.v: sorted(r.ids) for r in lists.collect()} == {1: [3], 2: [1], 3: [1, 2], 4: [4]}
    with pytest.raises(ValueError):
        aggregate_messages(edges, {"n": F.sum})
    assert "Join" not in plan_of(both) and "partial_sum" in plan_of(both)


def test_lookup_paths_agree(spark):
    edges = graph(spark, random_edges(2))
    pairs = N.pairs(edges)
    small, large = O.with_degrees(pairs, 1 << 20), O.with_degrees(pairs, 0)
    assert rows(small) == rows(large) == rows(O.with_degrees(pairs))
    assert "BroadcastHashJoin" in plan_of(small) and "Broadcast" not in plan_of(large) and "SortMergeJoin" in plan_of(large)
    table = spark.createDataFrame([(1, 5)], "k bigint, n bigint")
    asked = spark.createDataFrame([(1,), (2,), (None,)], "k bigint")
    for limit in (0, 1000, None):
        assert sorted(((r.k, r.n) for r in lookup(asked, table, "k", limit).collect()), key=repr) == [(1, 5), (2, 0), (None, 0)]
        assert {r.n for r in lookup(asked, table, "k", limit, missing=None).collect()} == {5, None}


@pytest.mark.parametrize("bits", [0, 3, 12])
def test_blocks_against_brute_force(spark, bits):
    for seed in (0, 1):
        edges = random_edges(seed) + [(-5, 3), (3, -5), (-5, 4)]
        total, counts, _ = brute(edges)
        df = graph(spark, edges)
        assert K.common_by_edge(df, bits).agg(F.sum("common")).first()[0] == 3 * total
        by_edge = K.classes_by_edge(df, bits).agg(*[F.sum(name) for name in TRIAD_CLASSES]).first()
        by_target = K.target_classes(O.by_degree(N.canonical(df)), bits).agg(*[F.sum(name) for name in TRIAD_CLASSES]).first()
        assert list(by_edge) == [3 * n for n in counts] and list(by_target) == counts


def test_no_block_grows_with_a_hub(spark):
    df = graph(spark, hub_edges())
    blocks = B.blocked(N.tagged(df), 5)
    assert blocks.agg(F.max(F.size("nbrs"))).first()[0] <= 32 and blocks.where("v = 0").count() == 13
    assert rows(blocks.select("v", F.explode("nbrs"))) == rows(N.tagged(df).select("v", "nbr"))
    assert all(list(r.nbrs) == sorted(r.nbrs) for r in blocks.collect())
    assert K.common_by_edge(df, 5).agg(F.sum("common")).first()[0] == 3 * 398
    assert trefoil.triangle_count(df, "edge_iter").first()[0] == 398 and trefoil.triad_census(df, "edge_iter").first()["Trans"] == 398


def test_vertex_triangles(spark):
    for edges in (random_edges(3), hub_edges(), []):
        near = defaultdict(set)
        for a, b in edges:
            if a != b:
                near[a].add(b)
                near[b].add(a)
        want = Counter(v for t in combinations(sorted(near), 3) if t[1] in near[t[0]] and t[2] in near[t[0]] and t[2] in near[t[1]] for v in t) if len(near) < 50 else None
        got = {r.v: r.triangles for r in K.vertex_triangles(graph(spark, edges), 4).collect()}
        assert got == want if want is not None else (got[0], got[1], got[2]) == (398, 1, 2)


@pytest.mark.parametrize("side", [1, 2, 3])
def test_cells(spark, side):
    edges = random_edges(4)
    oriented = O.by_degree(N.pairs(graph(spark, edges)))
    want = rows(K.triangles(oriented).select("x", "y", "z"))
    assert rows(cells.triangles_by_cells(oriented, side)) == want and cells.count_by_cells(oriented, side).first()[0] == len(want) == brute(edges)[0]
    sent = cells.copies(oriented, side)
    assert sent.groupBy("a", "b").count().agg(F.max("count")).first()[0] == 3 * side
    assert sent.agg(F.count_distinct("cell")).first()[0] <= side**3
    assert plan_of(cells.count_by_cells(oriented, side)).count("hashpartitioning(cell") == 1
    assert cells.triangles_by_cells(oriented.limit(0), side).collect() == []


def test_default_side(spark):
    assert cells.default_side(spark.range(1)) == 2  # 4 partitions
    hub = O.by_degree(N.pairs(graph(spark, hub_edges())))
    assert cells.count_by_cells(hub).first()[0] == 398


def test_relabelled_lists_hold_every_pair(spark):
    for edges in (random_edges(5, 60, 500), hub_edges(), [(1, 1)], []):
        df = graph(spark, edges)
        lists = O.relabelled_lists(df)
        new = {r.v: r.new_id for r in O.reindex_map(df, "lower").collect()}
        pairs = {tuple(sorted((new.get(a, a), new.get(b, b)))) for a, b in edges if a != b}
        assert sum(len(r.remaining) + len(r.removed) for r in lists.collect()) == len(pairs)
        assert {(r.v, n) for r in O.reindexed_adjacency(df).collect() for n in r.nbrs} == pairs
        assert all(list(r.nbrs) == sorted(r.nbrs) for r in O.reindexed_adjacency(df).collect())
        assert all(n > r.v for r in lists.collect() for n in r.remaining) and all(n < r.v for r in lists.collect() for n in r.removed)
    assert any(r.removed for r in O.relabelled_lists(graph(spark, hub_edges())).collect())


def test_repeated_edges_as_reciprocal_pairs(spark):
    edges = [(1, 2), (1, 2), (2, 3), (3, 1), (4, 3), (4, 1), (1, 4)]
    masks = {(r.a, r.b): r["mask"] for r in N.canonical(graph(spark, edges), "reciprocal").collect()}
    assert masks == {(1, 2): 3, (2, 3): 1, (1, 3): 2, (3, 4): 2, (1, 4): 3}
    for algo in ("fast", "fast_v3"):
        collapsed, counted = (census(trefoil.triad_census(graph(spark, edges), algo, duplicates=d)) for d in ("collapse", "reciprocal"))
        assert (sum(collapsed), sum(counted)) == (2, 2) and collapsed != counted
        assert census(trefoil.triad_census(graph(spark, list(set(edges))), algo, duplicates="reciprocal")) == collapsed
    for bad in ({"algo": "node_iter", "duplicates": "reciprocal"}, {"algo": "fast", "duplicates": "other"}):
        with pytest.raises(ValueError):
            trefoil.triad_census(graph(spark, edges), **bad)


def test_statistics_come_from_the_run(spark):
    edges = [*random_edges(6), (None, 1)]
    pairs = {tuple(sorted(e)) for e in edges if None not in e and e[0] != e[1]}
    found = measured_count(graph(spark, edges), 4, F.col("a"))
    sizes = Counter(a % 4 for a, _ in pairs)
    assert (found["loaded"], found["pairs"], found["triangles"]) == (300, len(pairs), brute(edges)[0])
    assert (found["smallest_partition"], found["largest_partition"]) == (min(sizes.values()), max(sizes.values()))
    assert found["candidates"] == K.wedges_of(O.by_degree(N.pairs(graph(spark, edges)))).count()
    few = measured_count(graph(spark, [(1, 2), (5, 6)]), 4, F.col("a"))
    assert (few["smallest_partition"], few["largest_partition"], few["candidates"]) == (0, 2, 0)
    none = measured_count(graph(spark, []), 3)
    assert [none[k] for k in ("loaded", "pairs", "candidates", "triangles", "smallest_partition", "largest_partition")] == [0] * 6


def jobs_of(spark, work):
    group = f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(group, "")
    out = work()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_transform_starts_no_job(spark):
    df = graph(spark, DIR)
    for directed, algos in ((False, UNDIRECTED), (True, DIRECTED)):
        for algo in algos:
            for ties in ("drop", "break"):
                t = TriangleCounter(algo=algo, isDirected=directed, ties=ties)
                result, jobs = jobs_of(spark, lambda: t.transform(df))
                assert jobs == 0 and [(f.name, f.dataType) for f in result.schema] == [(f.name, f.dataType) for f in t.transformSchema(df.schema)], (algo, ties)
    _, jobs = jobs_of(spark, lambda: TriangleCounter(storageLevel="MEMORY_ONLY").transform(df))
    assert jobs > 0
    with pytest.raises(ValueError, match="whole numbers"):
        TriangleCounter(srcNodeIdCol="x").transformSchema(df.schema)
    with pytest.raises(ValueError, match="whole numbers"):
        TriangleCounter().transformSchema(T.StructType([T.StructField("src", T.StringType()), T.StructField("dst", T.LongType())]))


def test_candidates_by_pivot(spark):
    df = graph(spark, random_edges(7))
    counted = {r.v: r.candidates for r in K.candidate_counts(df).collect()}
    assert counted == dict(K.wedges(df, degree_filter=True).groupBy("v").count().collect())
    tagged = K.wedges(df, True, True)
    assert rows(tagged.select("v", "a", "b")) == rows(K.wedges(df, degree_filter=True))
    tags = {(r.v, r.nbr): r.tag for r in N.tagged(df).collect()}
    assert all(tags[r.v, r.a] == r.tag_a and tags[r.v, r.b] == r.tag_b for r in tagged.collect())
