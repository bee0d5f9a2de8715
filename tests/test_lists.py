"""Triangles where lists of upper neighbours meet, against plain Python."""

import pytest

import trefoil
from pyspark.sql import functions as F
from tests.conftest import SF
from tests.test_graph import brute, graph
from tests.test_messages import plan_of, random_edges
from trefoil.functions.classify import TRIAD_CLASSES
from trefoil.operators import cells
from trefoil.operators import kernels as K
from trefoil.operators import normalize as N
from trefoil.operators import orient as O
from trefoil.operators import stats as S
from trefoil.plans import queries as Q
from trefoil.plans.statistics import Watch


def test_a_pair_is_sent_once_however_far_ids_lie_apart(spark):
    edges = [(a << 13, b << 13) for a, b in random_edges(8)]  # each neighbour would be a block of its own
    total, counts, _ = brute(edges)
    df = graph(spark, edges)
    oriented = O.by_degree(N.canonical(df))
    met = K.met_lists(oriented)
    assert met.count() <= oriented.count() and met.agg(F.sum(F.size("common"))).first()[0] == total
    by_edge, by_target, by_vertex, support = K.classes_by_edge(df), K.target_classes(oriented), K.vertex_triangles(df), K.common_by_edge(df)
    assert all("shiftright" not in plan_of(found) for found in (by_edge, by_target, by_vertex, support))
    summed = lambda found: list(found.agg(*[F.sum(name) for name in TRIAD_CLASSES]).first())
    assert summed(by_edge) == [3 * n for n in counts] and summed(by_target) == counts
    assert by_vertex.agg(F.sum("triangles")).first()[0] == support.agg(F.sum("common")).first()[0] == 3 * total
    assert trefoil.triangle_count(df, "edge_iter").first()[0] == total and list(trefoil.triad_census(df, "edge_iter").first()) == counts


def test_light_vertices_go_by_degree(spark):
    edges = [(hub, 100 + i) for hub in range(3) for i in range(60)] + [(i, i + 1) for i in range(100, 5000)] + [(0, 1)]  # 60 is less than sqrt(n)
    df = graph(spark, edges)
    pairs = N.pairs(df)
    longest = lambda oriented: oriented.groupBy("a").count().agg(F.max("count")).first()[0]
    assert O.heavy_vertices(df).count() == 0
    assert longest(O.by_heavy(pairs, df)) == 61 and longest(O.by_heavy(pairs, df, light="degree")) <= 5
    for algo in ("fast_v3", "fast_v4"):
        assert trefoil.triangle_count(df, algo).first()[0] == 3 * 59 + 60


def test_wedges_close_without_pairing_up_a_hub(spark):
    edges = [*random_edges(9), *[(1000, i) for i in range(60)]]
    df = graph(spark, edges)
    near = {(r.v, r.nbr): r.tag for r in N.tagged(df).collect()}
    degree = {r.v: r.degree for r in S.degrees(df).collect()}
    want = {(v, a, b) for v, a in near for w, b in near if v == w and a < b and (a, b) in near}
    got = K.classified_wedges(df).collect()
    assert len(got) == len(want) and {(r.v, r.a, r.b) for r in got} == want == {(r.v, r.a, r.b) for r in K.closed_wedges(df).collect()}
    assert all((near[r.v, r.a], near[r.v, r.b], near[r.a, r.b] + 1) == (r.tag_a, r.tag_b, r["mask"]) for r in got)
    low = {(v, a, b) for v, a, b in want if degree[v] < min(degree[a], degree[b])}
    assert low == {(r.v, r.a, r.b) for r in K.closed_wedges(df, True).collect()} == {(r.v, r.a, r.b) for r in K.classified_wedges(df, True).collect()}
    assert K.closed_wedges(df).columns == ["a", "b", "v"] and plan_of(K.closed_wedges(df)).count("posexplode") == plan_of(K.edge_iter_plus(df)).count("posexplode") > 0


def test_edge_iter_plus_rows(spark):
    edges = [*random_edges(10), (50, 51), (51, 52), (50, 52)]
    df = graph(spark, edges)
    near = {(r.v, r.nbr): r.tag for r in N.tagged(df).collect()}
    degree = {r.v: r.degree for r in S.degrees(df).collect()}
    higher = {v: sum(degree[w] > degree[v] for u, w in near if u == v) for v in degree}
    want = {(a, b, w) for a, b in near for u, w in near if u == a and a < b and (b, w) in near and degree[w] > max(degree[a], degree[b])}
    for guard in (False, True):
        kept = {t for t in want if not guard or max(higher[t[0]], higher[t[1]]) >= 2}
        got = K.edge_iter_plus(df, guard).collect()
        assert len(got) == len(kept) and {(r.a, r.b, r.w) for r in got} == kept
        assert all((near[r.a, r.b] + 1, near[r.a, r.w], near[r.b, r.w]) == (r["mask"], r.tag_a, r.tag_b) for r in got)


def test_cells_get_lists(spark):
    oriented = O.by_degree(N.pairs(graph(spark, random_edges(11))))
    sent = cells.list_copies(oriented, 2)
    pairs = sorted(tuple(r) for r in cells.copies(oriented, 2).collect())
    assert sorted(tuple(r) for r in sent.select("cell", "role", "a", F.explode("nbrs")).collect()) == pairs
    assert sent.groupBy("cell", "role", "a").count().agg(F.max("count")).first()[0] == 1 and sent.count() < len(pairs)


def scans_and_deals(found):
    """How often a run has read its file and dealt pairs by their lower end, without what it reused."""
    found.collect()
    lines = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    return sum("FileScan" in line for line in lines), sum("REPARTITION_BY_COL" in line and "ReusedExchange" not in line for line in lines)


@pytest.mark.parametrize("name", ["triangle_list", "classified_triangles", "triangle_list_by_degree", "census_fast_v2"])
def test_both_uses_of_pairs_and_lists_read_one_exchange(spark, name):
    scans, dealt = scans_and_deals(Q.queries()[name](spark, SF))
    assert scans == dealt == 1


def test_a_watched_plan_reads_one_exchange_too(spark):
    watch = Watch(4)
    pairs = N.pairs(watch("loaded", Q.GRAPHS["ps"](spark, SF)))
    found = K.triangles(O.by_degree(watch("pairs", pairs.repartitionById(4, F.pmod("a", F.lit(4)).cast("int")), sizes=True)), watch)
    scans, dealt = scans_and_deals(found)
    assert scans == dealt == 1 and sum(watch.partitions("pairs")) == watch.rows("pairs") == pairs.count()
