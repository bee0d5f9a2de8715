"""Total orders of the vertices. Orienting every pair by one makes each triangle appear exactly once.

``id`` needs no shuffle. ``degree`` bounds every out-neighbourhood by sqrt(2m), which is what keeps hubs
from exploding. ``heavy`` applies the degree order only to vertices above sqrt(n).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trefoil.functions.classify import flip, tag_of
from trefoil.operators import normalize as N
from trefoil.operators import stats as S
from trefoil.operators.messages import lookup, triplets

#: Put under the degrees of vertices that aren't heavy: no degree reaches it.
BELOW_HEAVY = 1 << 62


def _oriented(pairs: DataFrame) -> DataFrame:
    """``(a, b, wa, wb[, mask])`` with (wa, a) below (wb, b). Masks stay as seen from the end with the smaller id."""
    up = F.expr("wa < wb or (wa = wb and a < b)")
    turned = {p + q: F.when(up, F.col(p + q)).otherwise(F.col(p + o)) for p in ("", "w") for q, o in ("ab", "ba")}
    return pairs.select(*[c.alias(name) for name, c in turned.items()], *(["mask"] if "mask" in pairs.columns else []))


def by_id(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({"wa": F.lit(0).cast("long"), "wb": F.lit(0).cast("long")})


def with_degrees(pairs: DataFrame, limit: int | None = None) -> DataFrame:
    """Pairs with the degrees ``wa`` and ``wb`` of their ends.

    By default nothing runs before the plan does, and Spark broadcasts the degrees only if it measures them small. With a ``limit`` in
    bytes the degrees are counted first; see :func:`trefoil.operators.messages.lookup`.
    """
    degree = S.pair_degrees(pairs)
    if limit is None:
        found = triplets(pairs, degree, "a", "b")
        return found.select(*pairs.columns, F.col("src_state.degree").alias("wa"), F.col("dst_state.degree").alias("wb"))
    for end in "ab":
        pairs = lookup(pairs, degree.select(F.col("v").alias(end), F.col("degree").alias(f"w{end}")), end, limit)
    return pairs


def by_degree(pairs: DataFrame, limit: int | None = None) -> DataFrame:
    return _oriented(with_degrees(pairs, limit))


def heavy_vertices(edges: DataFrame, of: str = "all") -> DataFrame:
    """``(v, degree)`` of vertices with more than sqrt(n) higher neighbours, n counting ``all`` vertices or those that are the ``lower`` end of a pair."""
    n = S.vertex_count(edges) if of == "all" else N.pairs(edges).agg(F.count_distinct("a").alias("vertices"))
    return S.reduced_degrees(edges).join(F.broadcast(n)).where("degree > sqrt(vertices)").select("v", "degree")


def reindex_map(edges: DataFrame, of: str = "all") -> DataFrame:
    """``(v, new_id)``: heavy vertices (see :func:`heavy_vertices` on ``of``) ranked by reduced degree, then id, above the largest id.

    The rank is the count of heavy vertices with smaller degree plus the place among equals, so no single
    task sorts them all.
    """
    heavy = heavy_vertices(edges, of)
    below = heavy.groupBy("degree").agg(F.count("*").alias("n")).withColumn("below", F.sum("n").over(Window.orderBy("degree").rowsBetween(Window.unboundedPreceding, -1)))
    place = heavy.withColumn("place", F.row_number().over(Window.partitionBy("degree").orderBy("v")))
    top = S.max_vertex(edges)
    return place.join(below.select("degree", "below"), "degree").join(F.broadcast(top)).select("v", (F.col("max_vertex") + F.coalesce("below", F.lit(0)) + F.col("place")).alias("new_id"))


def by_heavy(pairs: DataFrame, edges: DataFrame, of: str = "all", light: str = "id") -> DataFrame:
    """Heavy vertices last, by reduced degree then id. No ranking is needed to compare.

    The others have no state and go by ``id``, up to sqrt(n) upper neighbours each; with ``light='degree'`` they go by degree first, so that their lists
    stay short however many vertices the threshold counts.
    """
    heavy = heavy_vertices(edges, of)
    if light == "degree":
        degree = S.pair_degrees(pairs).join(heavy.withColumnRenamed("degree", "heavy"), "v", "left")
        heavy = degree.select("v", F.coalesce("heavy", F.col("degree") - F.lit(BELOW_HEAVY)).alias("degree"))
    found = triplets(pairs, heavy, "a", "b")
    weight = lambda end: F.coalesce(f"{end}_state.degree", F.lit(0).cast("long"))
    return _oriented(found.select(*pairs.columns, weight("src").alias("wa"), weight("dst").alias("wb")))


def rehomed(edges: DataFrame) -> DataFrame:
    """``(v, nbr, moved)``: each pair under the end that is lower among heavy vertices; ``moved`` says that by id it was the other end's."""
    return by_heavy(N.pairs(edges), edges, "lower").select(F.col("a").alias("v"), F.col("b").alias("nbr"), (F.col("a") > F.col("b")).alias("moved"))


def _renamed(edges: DataFrame, of: str) -> DataFrame:
    """Pairs ``(a, b)`` with ``x`` and ``y``, the new ids of a and b; ids without a new one stay."""
    found = triplets(N.pairs(edges), reindex_map(edges, of), "a", "b")
    return found.select("a", "b", F.coalesce("src_state.new_id", "a").alias("x"), F.coalesce("dst_state.new_id", "b").alias("y"))


def reindexed_edges(edges: DataFrame) -> DataFrame:
    """Pairs under their new ids, lower new id first."""
    return _renamed(edges, "all").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def relabelled_lists(edges: DataFrame, of: str = "lower") -> DataFrame:
    """``(v, remaining, removed)``: each vertex with a higher neighbour, under its new id, and these neighbours under theirs, ascending.

    ``remaining`` are those that the new ids still put above v, ``removed`` those that they put below it.
    """
    stays = F.col("x") < F.col("y")
    grouped = _renamed(edges, of).groupBy(F.col("x").alias("v"))
    return grouped.agg(F.array_sort(F.collect_list(F.when(stays, F.col("y")))).alias("remaining"), F.array_sort(F.collect_list(F.when(~stays, F.col("y")))).alias("removed"))


def reindexed_adjacency(edges: DataFrame, of: str = "lower") -> DataFrame:
    """``(v, nbrs)``: each pair under the end with the lower new id. Removed neighbours become owners of their own; both tables are put together as bags, regrouped, flattened and sorted."""
    lists = relabelled_lists(edges, of)
    remaining = lists.where(F.size("remaining") > 0).select("v", F.col("remaining").alias("nbrs"))
    turned = lists.select(F.explode("removed").alias("owner"), "v").groupBy(F.col("owner").alias("v")).agg(F.collect_list("v").alias("nbrs"))
    return remaining.unionByName(turned).groupBy("v").agg(F.array_sort(F.flatten(F.collect_list("nbrs"))).alias("nbrs"))


def higher_degree_neighbors(edges: DataFrame, ties: str = "break", tags: bool = False) -> DataFrame:
    """``(v, nbr[, tag])`` with nbr above v in degree; ``ties='break'`` orders equals by id, ``'drop'`` leaves them out.

    One row per pair: the pairs meet the degrees of both ends and each stays with its lower one.
    """
    pairs = with_degrees(N.canonical(edges) if tags else N.pairs(edges))
    pairs = pairs.where("wa <> wb") if ties == "drop" else pairs
    up = F.expr("wa <= wb")  # pairs have a < b
    end = lambda one, other, name: F.when(up, F.col(one)).otherwise(F.col(other)).alias(name)
    tag = [tag_of(F.when(up, F.col("mask")).otherwise(flip(F.col("mask")))).alias("tag")] if tags else []
    return pairs.select(end("a", "b", "v"), end("b", "a", "nbr"), *tag)
