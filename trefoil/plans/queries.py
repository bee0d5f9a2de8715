"""The registered graph queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trefoil.functions.classify import TRIAD_CLASSES, triad_name
from trefoil.operators import blocks as B
from trefoil.operators import cells
from trefoil.operators import kernels as K
from trefoil.operators import normalize as N
from trefoil.operators import orient as O
from trefoil.operators import stats as S
from trefoil.operators.messages import BROADCAST_BYTES, triplets
from trefoil.plans.algorithms import DIRECTED, UNDIRECTED, triad_census, triangle_count
from trefoil.plans.statistics import run_statistics
from trefoil.session import scratch
from trefoil.sources.edges import load, save
from trefoil.sources.tables import next_part, part_supplier, table

GRAPHS = {"ps": part_supplier, "np": next_part}
SOURCE = {
    "ps": "SELECT CAST(l_partkey AS BIGINT) src, CAST(l_suppkey AS BIGINT) dst FROM lineitem WHERE l_partkey IS NOT NULL AND l_suppkey IS NOT NULL",
    "np": "SELECT * FROM (SELECT CAST(l_partkey AS BIGINT) src, CAST(lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS BIGINT) dst FROM lineitem) WHERE dst IS NOT NULL",
}
CTES = """WITH raw AS ({source}),
sym AS (SELECT src v, dst nbr FROM raw UNION SELECT dst, src FROM raw),
canon AS MATERIALIZED (SELECT least(src, dst) a, greatest(src, dst) b, bit_or(CASE WHEN src < dst THEN 1 ELSE 2 END) mask FROM raw WHERE src <> dst GROUP BY 1, 2),
more AS (SELECT least(src, dst) a, greatest(src, dst) b, CASE WHEN count(*) > 1 THEN 3 ELSE max(CASE WHEN src < dst THEN 1 ELSE 2 END) END m FROM raw WHERE src <> dst GROUP BY 1, 2),
adj AS MATERIALIZED (SELECT a v, b nbr, mask FROM canon UNION ALL SELECT b, a, CASE mask WHEN 3 THEN 3 ELSE 3 - mask END FROM canon),
deg AS MATERIALIZED (SELECT v, count(*) FILTER (v <> nbr) d FROM sym GROUP BY v),
red AS (SELECT a v, count(*) d FROM canon GROUP BY a),
heavy AS (SELECT v, d FROM red WHERE d > sqrt((SELECT count(*) FROM deg))),
heavy_lower AS (SELECT v, d FROM red WHERE d > sqrt((SELECT count(*) FROM red))),
remap_lower AS (SELECT v, (SELECT max(greatest(src, dst)) FROM raw) + row_number() OVER (ORDER BY d, v) nv FROM heavy_lower),
renamed AS (SELECT coalesce(i.nv, a) x, coalesce(j.nv, b) y FROM canon LEFT JOIN remap_lower i ON i.v = a LEFT JOIN remap_lower j ON j.v = b),
remap AS (SELECT v, (SELECT max(greatest(src, dst)) FROM raw) + row_number() OVER (ORDER BY d, v) nv FROM heavy),
ends AS MATERIALIZED (SELECT a, b, mask, x.d da, y.d db FROM canon JOIN deg x ON x.v = a JOIN deg y ON y.v = b),
up AS MATERIALIZED (SELECT CASE WHEN da < db THEN a ELSE b END v, CASE WHEN da < db THEN b ELSE a END nbr, CASE WHEN da < db OR mask = 3 THEN mask ELSE 3 - mask END mask FROM ends WHERE da <> db),
out AS (SELECT CASE WHEN da <= db THEN a ELSE b END v, CASE WHEN da <= db THEN b ELSE a END nbr FROM ends),
upn AS (SELECT v, count(*) n FROM up GROUP BY v),
wedge AS (SELECT l.v v, l.nbr a, r.nbr b, l.mask ma, r.mask mb FROM adj l JOIN adj r ON l.v = r.v AND l.nbr < r.nbr),
wedge_up AS (SELECT l.v v, l.nbr a, r.nbr b, l.mask ma, r.mask mb FROM up l JOIN up r ON l.v = r.v AND l.nbr < r.nbr),
tri AS (SELECT p.a x, p.b y, q.b z, p.mask xy, r.mask yz, q.mask xz FROM canon p JOIN canon q ON p.a = q.a AND p.b < q.b JOIN canon r ON r.a = p.b AND r.b = q.b),
low AS (SELECT v x, a y, b z, ma xy, c.mask yz, mb xz FROM wedge_up JOIN canon c USING (a, b)),
high AS (SELECT c.a x, c.b y, p.nbr z, c.mask xy, q.mask yz, p.mask xz FROM canon c JOIN up p ON p.v = c.a JOIN up q ON q.v = c.b AND q.nbr = p.nbr JOIN upn i ON i.v = c.a JOIN upn j ON j.v = c.b WHERE greatest(i.n, j.n) >= 2)
"""
CODE = """CASE WHEN xy = 3 AND yz = 3 AND xz = 3 THEN 6
WHEN CAST(xy = 3 AS INT) + CAST(yz = 3 AS INT) + CAST(xz = 3 AS INT) = 2 THEN 5
WHEN xy <> 3 AND yz <> 3 AND xz <> 3 THEN CASE WHEN (xy, yz, xz) IN ((1, 1, 2), (2, 2, 1)) THEN 3 ELSE 0 END
WHEN (xy, yz, xz) IN ((3, 2, 2), (1, 3, 1), (2, 1, 3)) THEN 1
WHEN (xy, yz, xz) IN ((3, 1, 1), (2, 3, 2), (1, 2, 3)) THEN 2 ELSE 4 END"""
CENSUS = ", ".join(f"CAST(count(*) FILTER (code = {i}) AS BIGINT) {name}" for i, name in enumerate(TRIAD_CLASSES))


def _round_trip(edges: DataFrame) -> DataFrame:
    """The edges written as delimited text and loaded again."""
    path = scratch(edges.sparkSession, "edge-text")
    edges.write.option("sep", "\t").csv(path)
    return load(edges.sparkSession, path, sep="\t")


def _listed(df: DataFrame) -> DataFrame:
    """Adjacency with the list as text, the same in any engine."""
    return df.select("v", F.array_join(F.transform("nbrs", lambda x: x.cast("string")), ",").alias("nbrs"))


def _listed_tags(df: DataFrame) -> DataFrame:
    return df.select("v", F.array_join(F.transform("nbrs", lambda x: F.concat_ws(":", x.nbr, x.tag)), ",").alias("nbrs"))


def _tag_int(df: DataFrame) -> DataFrame:
    return df.withColumn("tag", F.col("tag").cast("int"))


def _tags_int(df: DataFrame) -> DataFrame:
    return df.withColumns({"tag_a": F.col("tag_a").cast("int"), "tag_b": F.col("tag_b").cast("int")})


def _by_degree(edges: DataFrame) -> DataFrame:
    return O.by_degree(N.canonical(edges))


def _wedge_counts(edges: DataFrame) -> DataFrame:
    return K.wedges(edges).agg(F.count("*").alias("candidates"))


def _in_four(edges: DataFrame) -> DataFrame:
    """The pairs in four partitions, dealt by their lower end."""
    return N.pairs(edges).repartitionById(4, F.pmod("a", F.lit(4)).cast("int"))


def _triplets(edges: DataFrame) -> DataFrame:
    """Pairs with the reduced degrees of both ends, null for vertices without a higher neighbour."""
    found = triplets(N.pairs(edges), S.reduced_degrees(edges), "a", "b")
    return found.select("a", "b", F.col("src_state.degree").alias("src_degree"), F.col("dst_state.degree").alias("dst_degree"))


def _blocks(edges: DataFrame) -> DataFrame:
    """Blocks of 64 ids, lists as text."""
    items = F.zip_with("nbrs", "tags", lambda n, t: F.concat_ws(":", n, t))
    return B.blocked(N.tagged(edges), 6).select("v", "block", F.array_join(items, ",").alias("nbrs"))


def _lists(edges: DataFrame) -> DataFrame:
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return O.relabelled_lists(edges).select("v", text("remaining"), text("removed"))


def _saved(edges: DataFrame) -> DataFrame:
    """The census as a result file, read again."""
    path = scratch(edges.sparkSession, "result")
    save(triad_census(edges), path)
    return edges.sparkSession.read.option("sep", "\t").schema(", ".join(f"{name} bigint" for name in TRIAD_CLASSES)).csv(path)


def _weighted(spark, sf_dir: str) -> DataFrame:
    """Target, weight and source as text with a header line, loaded by place."""
    path = scratch(spark, "weighted-edges")
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").cast("float").alias("l_quantity"), "l_partkey")
    line.write.option("sep", "|").option("header", True).csv(path)
    return load(spark, path, weighted=True, header=True, src_index=2, dst_index=0, weight_index=1, sep="|")


LIST = "SELECT v, array_to_string(list(nbr ORDER BY nbr), ',') nbrs FROM {of} GROUP BY v"
#: name: (graph, edges -> rows, SQL after the CTEs)
QUERIES = {
    "edges_no_loops": ("ps", N.without_loops, "SELECT src, dst FROM raw WHERE src <> dst"),
    "edges_distinct": ("ps", N.distinct_edges, "SELECT DISTINCT src, dst FROM raw WHERE src <> dst"),
    "edges_symmetrized": ("ps", N.symmetrize, "SELECT src v, dst nbr FROM raw UNION ALL SELECT dst, src FROM raw"),
    "edges_tagged": ("ps", lambda e: _tag_int(N.tagged(e)), "SELECT v, nbr, CAST(mask - 1 AS INT) tag FROM adj"),
    "edges_canonical": ("ps", N.pairs, "SELECT a, b FROM canon"),
    "edges_canonical_tagged": ("ps", lambda e: _tag_int(N.canonical_tagged(e)), "SELECT v, nbr, CAST(mask - 1 AS INT) tag FROM adj WHERE v < nbr"),
    "edges_directed_once": ("ps", lambda e: _tag_int(N.directed_once(e)), "SELECT v, nbr, CAST(mask - 1 AS INT) tag FROM adj WHERE mask = 1 OR (mask = 3 AND v < nbr)"),
    "edges_flipped": ("ps", lambda e: _tag_int(N.flipped(e)), "SELECT v src, nbr dst, CAST(mask - 1 AS INT) tag FROM adj WHERE mask = 1 OR (mask = 3 AND v < nbr)"),
    "tag_histogram": ("ps", S.tag_histogram, "SELECT count(*) FILTER (mask <> 3) out_pairs, CAST(0 AS BIGINT) in_pairs, count(*) FILTER (mask = 3) both_pairs FROM canon"),
    "adjacency_undirected": ("ps", lambda e: _listed(N.adjacency(N.tagged(e))), LIST.format(of="adj")),
    "adjacency_directed": ("ps", lambda e: _listed_tags(N.adjacency(N.tagged(e), tags=True)), "SELECT v, array_to_string(list(nbr || ':' || (mask - 1) ORDER BY nbr), ',') nbrs FROM adj GROUP BY v"),
    "adjacency_lower": ("ps", lambda e: _listed(N.adjacency(N.tagged(e), "nbr < v")), LIST.format(of="(SELECT * FROM adj WHERE nbr < v)")),
    "adjacency_higher": ("ps", lambda e: _listed(N.adjacency(N.tagged(e), "nbr > v")), LIST.format(of="(SELECT * FROM adj WHERE nbr > v)")),
    "degrees": ("ps", S.degrees, "SELECT v, d degree FROM deg"),
    "max_degree": ("ps", S.max_degree, "SELECT max(d) max_degree FROM deg"),
    "reduced_degree": ("ps", S.reduced_degrees, "SELECT v, d degree FROM red"),
    "vertex_count": ("ps", S.vertex_count, "SELECT count(*) vertices FROM deg"),
    "edge_count": ("ps", S.edge_count, "SELECT count(*) edges FROM canon"),
    "max_vertex": ("ps", S.max_vertex, "SELECT max(greatest(src, dst)) max_vertex FROM raw"),
    "wedge_count": ("ps", S.wedge_count, "SELECT CAST(sum(d * (d - 1) // 2) AS BIGINT) wedges FROM deg"),
    "candidate_edges": ("np", lambda e: K.wedges(e), "SELECT v, a, b FROM wedge"),
    "candidate_count": ("np", _wedge_counts, "SELECT count(*) candidates FROM wedge"),
    "candidate_edges_plus": ("np", lambda e: K.wedges(e, degree_filter=True), "SELECT v, a, b FROM wedge_up"),
    "candidate_edges_tagged": ("np", lambda e: _tags_int(K.wedges(e, tags=True)), "SELECT v, a, b, CAST(ma - 1 AS INT) tag_a, CAST(mb - 1 AS INT) tag_b FROM wedge"),
    "candidate_edges_plus_tagged": ("np", lambda e: _tags_int(K.wedges(e, True, True)), "SELECT v, a, b, CAST(ma - 1 AS INT) tag_a, CAST(mb - 1 AS INT) tag_b FROM wedge_up"),
    "oriented_by_degree_strict": ("ps", lambda e: O.higher_degree_neighbors(e, "drop"), "SELECT v, nbr FROM up"),
    "oriented_by_degree": ("ps", O.higher_degree_neighbors, "SELECT v, nbr FROM adj JOIN deg x USING (v) JOIN deg y ON y.v = nbr WHERE (y.d, nbr) > (x.d, v)"),
    "heavy_vertices": ("ps", O.heavy_vertices, "SELECT v, d degree FROM heavy"),
    "heavy_vertices_lower": ("ps", lambda e: O.heavy_vertices(e, "lower"), "SELECT v, d degree FROM red WHERE d > sqrt((SELECT count(*) FROM red))"),
    "rehomed_pairs": ("ps", O.rehomed, """SELECT CASE WHEN up THEN a ELSE b END v, CASE WHEN up THEN b ELSE a END nbr, NOT up moved FROM
(SELECT a, b, (coalesce(x.d, 0), a) < (coalesce(y.d, 0), b) up FROM canon LEFT JOIN (SELECT * FROM red WHERE d > sqrt((SELECT count(*) FROM red))) x ON x.v = a LEFT JOIN (SELECT * FROM red WHERE d > sqrt((SELECT count(*) FROM red))) y ON y.v = b)"""),
    "reindex_map": ("ps", O.reindex_map, "SELECT v, CAST(nv AS BIGINT) new_id FROM remap"),
    "reindexed_edges": ("ps", O.reindexed_edges, "SELECT CAST(least(x, y) AS BIGINT) a, CAST(greatest(x, y) AS BIGINT) b FROM (SELECT coalesce(i.nv, a) x, coalesce(j.nv, b) y FROM canon LEFT JOIN remap i ON i.v = a LEFT JOIN remap j ON j.v = b)"),
    "closed_wedges": ("np", lambda e: K.closed_wedges(e).agg(F.count("*").alias("closed")), "SELECT 3 * count(*) closed FROM tri"),
    "common_neighbors": ("np", lambda e: K.common_neighbors(O.by_id(N.pairs(e))).where("common > 0"), "SELECT p.a, p.b, count(*) common FROM canon p JOIN canon q ON q.a = p.a JOIN canon r ON r.a = p.b AND r.b = q.b GROUP BY 1, 2"),
    "triangle_list": ("ps", lambda e: K.triangles(O.by_degree(N.pairs(e))).select("x", "y", "z"), "SELECT x, y, z FROM tri"),
    "triangle_list_by_degree": ("ps", lambda e: K.triangles(O.by_degree(N.pairs(e))).agg(F.count("*").alias("n"), F.sum(F.col("x") + F.col("y") + F.col("z")).alias("ids")), "SELECT count(*) n, CAST(sum(x + y + z) AS BIGINT) ids FROM tri"),
    "classified_triangles": ("ps", lambda e: K.classified(O.by_degree(N.canonical(e))).select("x", "y", "z", triad_name(F.col("code")).alias("class")), f"SELECT x, y, z, ({list(TRIAD_CLASSES)})[1 + {CODE}] AS class FROM tri"),
}
TARGET = f"SELECT v, code, count(*) n FROM (SELECT CAST({CODE} AS INT) code, list_sort([(dx.d, x), (dy.d, y), (dz.d, z)])[2][2] v FROM tri JOIN deg dx ON dx.v = x JOIN deg dy ON dy.v = y JOIN deg dz ON dz.v = z) GROUP BY 1, 2"
RECIPROCAL = f"""SELECT {CENSUS} FROM (SELECT {CODE} code FROM (SELECT p.a x, p.b y, q.b z, p.m xy, r.m yz, q.m xz FROM more p JOIN more q ON p.a = q.a AND p.b < q.b JOIN more r ON r.a = p.b AND r.b = q.b))"""
QUERIES |= {
    "partition_sizes": ("ps", lambda e: S.partition_sizes(_in_four(e)), "SELECT min(n) smallest, max(n) largest FROM (SELECT count(*) n FROM canon GROUP BY a % 4)"),
    "run_statistics": ("ps", lambda e: run_statistics(e, 4, F.col("a")), "SELECT (SELECT count(*) FROM raw) loaded, (SELECT count(*) FROM canon) pairs, (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) FROM (SELECT count(*) n FROM out GROUP BY v)) candidates, (SELECT count(*) FROM tri) triangles, min(n) smallest_partition, max(n) largest_partition FROM (SELECT count(*) n FROM canon GROUP BY a % 4)"),
    "candidate_counts_plus": ("np", K.candidate_counts, "SELECT v, n * (n - 1) // 2 candidates FROM upn WHERE n > 1"),
    "triplets": ("ps", _triplets, "SELECT a, b, i.d src_degree, j.d dst_degree FROM canon LEFT JOIN red i ON i.v = a LEFT JOIN red j ON j.v = b"),
    "degree_lookup": ("ps", lambda e: O.with_degrees(N.pairs(e), BROADCAST_BYTES), "SELECT a, b, da wa, db wb FROM ends"),
    "vertex_triangles": ("ps", K.vertex_triangles, "SELECT v, count(*) triangles FROM (SELECT unnest([x, y, z]) v FROM tri) GROUP BY v"),
    "adjacency_blocks": ("ps", _blocks, "SELECT v, nbr // 64 block, array_to_string(list(nbr || ':' || (mask - 1) ORDER BY nbr), ',') nbrs FROM adj GROUP BY 1, 2"),
    "census_by_vertex": ("ps", lambda e: K.target_classes(O.by_degree(N.canonical(e))), "SELECT v, " + ", ".join(f"CAST(coalesce(sum(n) FILTER (code = {i}), 0) AS BIGINT) {name}" for i, name in enumerate(TRIAD_CLASSES)) + f" FROM ({TARGET}) GROUP BY v"),
    "triangles_by_cells": ("ps", lambda e: cells.triangles_by_cells(O.by_degree(N.pairs(e))), "SELECT x, y, z FROM tri"),
    "triangle_count_by_cells": ("ps", lambda e: cells.count_by_cells(O.by_degree(N.pairs(e))), "SELECT count(*) triangles FROM tri"),
    "relabelled_lists_v3": ("ps", _lists, "SELECT CAST(x AS BIGINT) v, coalesce(array_to_string(list(CAST(y AS BIGINT) ORDER BY y) FILTER (x < y), ','), '') remaining, coalesce(array_to_string(list(CAST(y AS BIGINT) ORDER BY y) FILTER (x > y), ','), '') removed FROM renamed GROUP BY x"),
    "reindexed_adjacency_v3": ("ps", lambda e: _listed(O.reindexed_adjacency(e)), "SELECT CAST(least(x, y) AS BIGINT) v, array_to_string(list(CAST(greatest(x, y) AS BIGINT) ORDER BY greatest(x, y)), ',') nbrs FROM renamed GROUP BY least(x, y)"),
    "census_fast_reciprocal": ("ps", lambda e: triad_census(e, "fast", duplicates="reciprocal"), RECIPROCAL),
    "result_round_trip": ("ps", _saved, f"SELECT {CENSUS} FROM (SELECT {CODE} code FROM tri)"),
    "census_by_target": ("ps", lambda e: K.target_counts(O.by_degree(N.canonical(e))), TARGET),
    "edge_iter_plus_unguarded": ("np", lambda e: K.edge_iter_plus(e, guard=False).agg(F.count("*").alias("n")), "SELECT count(*) n FROM canon c JOIN up p ON p.v = c.a JOIN up q ON q.v = c.b AND q.nbr = p.nbr"),
    "tri_node_iter_plus_exact": ("np", lambda e: triangle_count(e, "node_iter_plus", ties="break"), "SELECT CAST(count(*) AS DOUBLE) TriangleNum FROM tri"),
    "tri_edge_iter_plus_exact": ("np", lambda e: triangle_count(e, "edge_iter_plus", ties="break"), "SELECT CAST(count(*) AS DOUBLE) TriangleNum FROM tri"),
    "census_node_iter_plus_exact": ("np", lambda e: triad_census(e, "node_iter_plus", ties="break"), f"SELECT {CENSUS} FROM (SELECT {CODE} code FROM tri)"),
    "edge_text_round_trip": ("np", _round_trip, "SELECT src, dst FROM raw"),
}
EXACT = "SELECT CAST(count(*) AS DOUBLE) TriangleNum FROM {of}"
OF = {"node_iter_plus": "low", "edge_iter_plus": "high"}
for _algo in UNDIRECTED:
    QUERIES[f"tri_{_algo}"] = ("np" if "iter" in _algo else "ps", lambda e, a=_algo: triangle_count(e, a), EXACT.format(of=OF.get(_algo, "tri")))
for _algo in DIRECTED:
    _whole = _algo == "edge_iter_plus"  # with the triangles whose highest degree is tied
    QUERIES[f"census_{_algo}"] = ("np" if "iter" in _algo else "ps", lambda e, a=_algo, t="break" if _whole else "drop": triad_census(e, a, t), f"SELECT {CENSUS} FROM (SELECT {CODE} code FROM {'tri' if _whole else OF.get(_algo, 'tri')})")


WEIGHTED = "SELECT CAST(l_partkey AS BIGINT) src, CAST(l_suppkey AS BIGINT) dst, CAST(l_quantity AS FLOAT) weight FROM lineitem WHERE l_partkey IS NOT NULL AND l_suppkey IS NOT NULL"


def queries() -> dict:
    return {name: lambda spark, sf_dir, g=g, f=f: f(GRAPHS[g](spark, sf_dir)) for name, (g, f, _) in QUERIES.items()} | {"edges_weighted": _weighted}


def oracle_sql() -> dict[str, str]:
    return {name: CTES.format(source=SOURCE[g]) + sql for name, (g, _, sql) in QUERIES.items()} | {"edges_weighted": WEIGHTED}
