"""Triangle kernels over pair relations: wedges, lists of upper neighbours that meet, array intersection, merges of blocks.

Every kernel only describes a plan: no job runs and nothing is written before an action asks for rows. A relation that is used more than once
has the same columns in each use, so that Spark shuffles it once and reuses the exchange.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trefoil.functions.classify import TRIAD_CLASSES, flip, tag_of, triad_code
from trefoil.operators import blocks as B
from trefoil.operators import normalize as N
from trefoil.operators import orient as O
from trefoil.operators.messages import aggregate_messages


def wedges(edges: DataFrame, tags: bool = False, degree_filter: bool = False) -> DataFrame:
    """Candidate pairs ``(v, a, b)``, ``a < b``, around every pivot v; with the pivot's tags if asked.

    ``degree_filter`` keeps only pivots of strictly lower degree than both ends: each pair then belongs to its lower end alone, so
    a hub never pairs up its neighbours.
    """
    side = O.higher_degree_neighbors(edges, "drop", tags) if degree_filter else N.tagged(edges) if tags else N.tagged(edges).drop("tag")
    tag = lambda name: [F.col("tag").alias(name)] if tags else []
    left, right = side.select("v", F.col("nbr").alias("a"), *tag("tag_a")), side.select("v", F.col("nbr").alias("b"), *tag("tag_b"))
    return left.join(right, "v").where("a < b")


def candidate_counts(edges: DataFrame) -> DataFrame:
    """``(v, candidates)``: how many pairs :func:`wedges` has around each pivot with ``degree_filter``, without pairing anything up."""
    up = O.higher_degree_neighbors(edges, "drop").groupBy("v").agg(F.count("*").alias("n"))
    return up.select("v", F.expr("n * (n - 1) div 2").alias("candidates")).where("candidates > 0")


def _pivots(edges: DataFrame, tags: bool, degree_filter: bool) -> DataFrame:
    """``(a, b, v[, tag_a, tag_b, mask])``: triangles as pivots v with their ends, ``a < b``; with v's tags and the ends' mask if asked.

    Each triangle is found once, where the lists of its two lower vertices meet, and turned to its three pivots, so a hub's neighbours aren't paired up.
    """
    found = closed(O.by_degree(N.canonical(edges) if tags else N.pairs(edges)), strict="low" if degree_filter else None)
    sides = {"ab": "ab", "ba": "ab", "bc": "bc", "cb": "bc", "ac": "ac", "ca": "ac"}

    def turned(v: str, one: str, other: str) -> Column:
        first = F.col(one) < F.col(other)
        pick = lambda x, y: F.when(first, x).otherwise(y)
        seen = lambda w: tag_of(F.when(F.col(v) < F.col(w), F.col(sides[v + w])).otherwise(flip(F.col(sides[v + w]))))
        ends = [pick(F.col(one), F.col(other)).alias("a"), pick(F.col(other), F.col(one)).alias("b"), F.col(v).alias("v")]
        return F.struct(*ends, *([pick(seen(one), seen(other)).alias("tag_a"), pick(seen(other), seen(one)).alias("tag_b"), F.col(sides[one + other]).alias("mask")] if tags else []))

    pivots = [turned("a", "b", "c")] if degree_filter else [turned("a", "b", "c"), turned("b", "a", "c"), turned("c", "a", "b")]
    return found.select(F.explode(F.array(*pivots)).alias("w")).select("w.*")


def closed_wedges(edges: DataFrame, degree_filter: bool = False) -> DataFrame:
    """``(a, b, v)``: wedges whose ends are adjacent; without the filter each triangle appears three times."""
    return _pivots(edges, False, degree_filter)


def classified_wedges(edges: DataFrame, degree_filter: bool = False) -> DataFrame:
    """Closed wedges with the class code of their triangle."""
    return _pivots(edges, True, degree_filter).withColumn("code", triad_code(F.col("tag_a") + 1, F.col("mask"), F.col("tag_b") + 1))


def wedges_of(oriented: DataFrame) -> DataFrame:
    """``(a, b, c)``: two upper neighbours of a, the lower one first, in the orientation's order; with pair masks ``ab`` and ``ac`` if there are any."""
    m = lambda name: [F.col("mask").alias(name)] if "mask" in oriented.columns else []
    first = oriented.select("a", "b", F.col("wb").alias("w"), *m("ab"))
    second = oriented.select("a", F.col("b").alias("c"), F.col("wb").alias("wc"), *m("ac"))
    return first.join(second, "a").where("w < wc or (w = wc and b < c)").drop("w", "wc")


def upper_lists(oriented: DataFrame, weights: bool = False) -> DataFrame:
    """``(a, nbrs[, masks][, tied])``: the upper neighbours of each vertex, ascending in the orientation's order, with pair masks if there are any; ``weights`` counts
    those that weigh as much as a, which come first. The pairs are dealt by a as they are, as few of a vertex would meet before. A join on a asks that it isn't null; asked
    of every use, all read one exchange."""
    masks = "mask" in oriented.columns
    items = F.sort_array(F.collect_list(F.struct("wb", "b", *(["mask"] if masks else [])))).alias("items")
    tied = [F.count_if(F.col("wa") == F.col("wb")).cast("int").alias("tied")] if weights else []
    found = oriented.where("a is not null").repartition("a").groupBy("a").agg(items, *tied)
    return found.select("a", F.col("items.b").alias("nbrs"), *([F.col("items.mask").alias("masks")] if masks else []), *(["tied"] if weights else []))


def met_lists(oriented: DataFrame, watch: Callable[[str, DataFrame, Column], DataFrame] | None = None, strict: str | None = None) -> DataFrame:
    """``(a, b, ends, own, common[, ab, end_masks, own_masks])``: for each oriented pair a's upper neighbours beyond b, those of b, and what they share, which is never empty.

    A pair goes to its upper end with the rest of its lower end's list, so wedges travel as arrays and only those that close become more. ``strict='low'`` takes only triangles
    whose lowest vertex weighs less than the second, ``'high'`` those whose second weighs less than the third; then ``na`` and ``nb`` say how many neighbours weigh more than a and b.
    ``watch`` may look at the wedges as they pass, as ``candidates`` with an expression that counts them.
    """
    masks = "mask" in oriented.columns
    lists = upper_lists(oriented, strict is not None)
    rest = lambda c: F.slice(c, F.col("i") + 2, F.size("nbrs"))
    above = lambda c: F.slice(c, F.col("tied") + 1, F.size("nbrs")) if strict == "high" else F.col(c)
    n = lambda end: [(F.size("nbrs") - F.col("tied")).alias(f"n{end}")] if strict == "high" else []
    asked = lists.select("*", F.posexplode("nbrs").alias("i", "b"))
    if not watch:  # a watched plan sends empty rests, too: if Spark saw none sent, it would take the pairs' metrics out with them
        asked = asked.where("i + 1 < size(nbrs)")
    asked = asked.where("i >= tied") if strict == "low" else asked
    asked = asked.select("a", "b", rest("nbrs").alias("ends"), *([F.get("masks", "i").alias("ab"), rest("masks").alias("end_masks")] if masks else []), *n("a"))
    asked = watch("candidates", asked, F.sum(F.size("ends"))) if watch else asked
    owned = lists.select(F.col("a").alias("b"), above("nbrs").alias("own"), *([above("masks").alias("own_masks")] if masks else []), *n("b"))
    return asked.join(owned, "b").withColumn("common", F.array_intersect("ends", "own")).where("size(common) > 0")


def closed(oriented: DataFrame, watch: Callable[[str, DataFrame, Column], DataFrame] | None = None, strict: str | None = None) -> DataFrame:
    """``(a, b, c[, ab, bc, ac])``: each triangle once in the orientation's order, with pair masks if there are any; with ``strict='high'`` also ``na`` and ``nb``, see :func:`met_lists`."""
    found = met_lists(oriented, watch, strict)
    of = lambda masks, ids: F.element_at(masks, F.array_position(ids, F.col("c")).cast("int"))
    pairs = ["ab", of("own_masks", "own").alias("bc"), of("end_masks", "ends").alias("ac")] if "mask" in oriented.columns else []
    return found.select("*", F.explode("common").alias("c")).select("a", "b", "c", *pairs, *(["na", "nb"] if strict == "high" else []))


def coded(found: DataFrame) -> DataFrame:
    """Triangles of :func:`closed` with their class ``code``."""
    seen = lambda v, w: F.when(F.col(v) < F.col(w), F.col(v + w)).otherwise(flip(F.col(v + w)))
    return found.withColumn("code", triad_code(seen("a", "b"), seen("b", "c"), seen("a", "c")))


def triangles(oriented: DataFrame, watch: Callable[[str, DataFrame, Column], DataFrame] | None = None) -> DataFrame:
    """Each triangle once as ``(x, y, z)`` in the order of ids, ``middle`` being the second one in the orientation's order, with pair masks if there are any.

    Wedges hang on their lowest end, so the orientation decides how many there are; see :func:`met_lists`, also on ``watch``.
    """
    masks = "mask" in oriented.columns
    found = closed(oriented, watch)
    x, z = F.least("a", "b", "c"), F.greatest("a", "b", "c")
    without = lambda v: F.when(F.col("c") == v, F.col("ab")).when(F.col("a") == v, F.col("bc")).otherwise(F.col("ac"))
    y = F.when((F.col("a") != x) & (F.col("a") != z), F.col("a")).when((F.col("b") != x) & (F.col("b") != z), F.col("b")).otherwise(F.col("c"))
    pairs = [without(z).alias("xy"), without(x).alias("yz"), without(y).alias("xz")] if masks else []
    return found.select(x.alias("x"), y.alias("y"), z.alias("z"), F.col("b").alias("middle"), *pairs)


def classified(oriented: DataFrame) -> DataFrame:
    """:func:`triangles` with their class code."""
    return triangles(oriented).withColumn("code", triad_code(F.col("xy"), F.col("yz"), F.col("xz")))


def counted(rows: DataFrame) -> DataFrame:
    """``(v, *TRIAD_CLASSES)`` from rows that have a vertex ``v`` and a class ``code``."""
    return rows.groupBy("v").agg(*[F.count_if(F.col("code") == i).alias(name) for i, name in enumerate(TRIAD_CLASSES)])


def target_classes(oriented: DataFrame, bits: int | None = None) -> DataFrame:
    """``(v, *TRIAD_CLASSES)``: the classes of the triangles that each vertex is the second one of, where its list meets those sent to it. With ``bits`` lists are
    counted in blocks of ``2 ** bits`` ids, so that none is a row of its own, at the price of a row for each pair and block."""
    if bits is None:
        return counted(coded(closed(oriented)).select(F.col("b").alias("v"), "code"))
    return B.class_messages(oriented, B.blocked(B.upper_ends(oriented), bits))


def target_counts(oriented: DataFrame, bits: int | None = None) -> DataFrame:
    """:func:`target_classes` as ``(v, code, n)``, without zeros."""
    counts = F.filter(F.array(*[F.struct(F.lit(i).alias("code"), F.col(name).alias("n")) for i, name in enumerate(TRIAD_CLASSES)]), lambda c: c["n"] > 0)
    return target_classes(oriented, bits).select("v", F.explode(counts).alias("c")).select("v", "c.code", "c.n")


def common_neighbors(oriented: DataFrame) -> DataFrame:
    """``(a, b, common)``: out-neighbours shared by the ends of each pair, by array intersection.

    Arrays are bounded by the largest out-degree, so give hub-heavy graphs a degree orientation. The pairs are taken from the lists
    themselves, so that the oriented pairs are grouped once and only the lists meet.
    """
    out = oriented.groupBy("a").agg(F.collect_list("b").alias("out_a"))
    upper = out.select(F.col("a").alias("b"), F.col("out_a").alias("out_b"))
    both = out.select("a", F.explode("out_a").alias("b"), "out_a").join(upper, "b", "left")
    return both.select("a", "b", F.coalesce(F.size(F.array_intersect("out_a", "out_b")), F.lit(0)).cast("long").alias("common"))


def edge_iter_plus(edges: DataFrame, guard: bool = True) -> DataFrame:
    """Triangles seen from their two lower ends, the third having strictly the highest degree.

    ``(a, b, w, mask, tag_a, tag_b)``. With ``guard`` a pair also needs one end with at least two strictly
    higher neighbours, a condition of the tie-dropping edge iterator that loses some triangles.
    """
    found = closed(O.by_degree(N.canonical(edges)), strict="high")
    found = found.where("greatest(na, nb) >= 2") if guard else found
    first = F.col("a") < F.col("b")
    pick = lambda x, y: F.when(first, x).otherwise(y)
    a, b, w = F.col("a"), F.col("b"), F.col("c")
    tag = lambda v, mask: tag_of(F.when(v < w, F.col(mask)).otherwise(flip(F.col(mask))))
    return found.select(pick(a, b).alias("a"), pick(b, a).alias("b"), w.alias("w"), F.col("ab").alias("mask"), pick(tag(a, "ac"), tag(b, "bc")).alias("tag_a"), pick(tag(b, "bc"), tag(a, "ac")).alias("tag_b"))


def classified_edge_iter_plus(edges: DataFrame, guard: bool = True) -> DataFrame:
    """:func:`edge_iter_plus` with class codes."""
    return edge_iter_plus(edges, guard).withColumn("code", triad_code(F.col("mask"), F.col("tag_b") + 1, F.col("tag_a") + 1))


def common_by_edge(edges: DataFrame, bits: int | None = None) -> DataFrame:
    """``(a, b, common)``: neighbours that the ends of a pair share, for pairs that share any; three in all for every triangle.

    Each triangle is found once, from its lowest vertex, and counted for its three pairs. With ``bits`` a pair looks through the blocks of ``2 ** bits`` ids of its end
    with the lower degree instead, a row for each pair and block.
    """
    oriented = O.by_degree(N.pairs(edges))
    if bits is None:
        sides = F.explode(F.array(*[F.struct(F.col(p).alias("a"), F.col(q).alias("b")) for p, q in ("ab", "ac", "bc")])).alias("p")
        return closed(oriented).select(sides).groupBy("p.a", "p.b").agg(F.count("*").alias("common"))
    return B.common_by_block(oriented, B.blocked(B.both_ends(oriented), bits))


def vertex_triangles(edges: DataFrame, bits: int | None = None) -> DataFrame:
    """``(v, triangles)`` of every vertex in one. With ``bits`` each pair sends both ends how many neighbours these share, counted in blocks (:func:`common_by_edge`),
    which counts a triangle twice at each of its vertices."""
    if bits is None:
        return closed(O.by_degree(N.pairs(edges))).select(F.explode(F.array("a", "b", "c")).alias("v")).groupBy("v").agg(F.count("*").alias("triangles"))
    shared = {"common": F.col("common")}
    found = aggregate_messages(common_by_edge(edges, bits), {"common": F.sum}, shared, shared, src="a", dst="b", where=F.col("common") > 0)
    return found.select("v", F.expr("common div 2").alias("triangles"))


def classes_by_edge(edges: DataFrame, bits: int | None = None) -> DataFrame:
    """``(v, *TRIAD_CLASSES)``: what :func:`common_by_edge` counts, by class and by the pair's upper end; every triangle three times."""
    oriented = O.by_degree(N.canonical(edges))
    if bits is None:
        return counted(coded(closed(oriented)).select(F.explode(F.array("b", "c", "c")).alias("v"), "code"))
    return B.class_messages(oriented, B.blocked(B.both_ends(oriented), bits))


__all__ = [
    "wedges", "candidate_counts", "closed_wedges", "classified_wedges", "wedges_of", "upper_lists", "met_lists", "closed", "coded", "counted", "triangles", "classified", "target_classes", "target_counts", "vertex_triangles", "common_neighbors", "edge_iter_plus",
    "classified_edge_iter_plus", "common_by_edge", "classes_by_edge",
]
