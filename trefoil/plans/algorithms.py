"""The fifteen named algorithms as orientation x kernel choices over one shared set of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trefoil.functions.classify import TRIAD_CLASSES
from trefoil.operators import kernels as K
from trefoil.operators import normalize as N
from trefoil.operators import orient as O

UNDIRECTED = ("node_iter", "node_iter_plus", "edge_iter", "edge_iter_plus", "fast", "fast_v2", "fast_v3", "fast_v4")
DIRECTED = ("node_iter", "node_iter_plus", "edge_iter", "edge_iter_plus", "fast", "fast_v2", "fast_v3")


def _count(rows: DataFrame, divisor: int = 1) -> DataFrame:
    return rows.agg((F.count("*") / F.lit(divisor)).cast("double").alias("TriangleNum"))


def _sum(rows: DataFrame, divisor: int = 1) -> DataFrame:
    return rows.agg((F.coalesce(F.sum("common"), F.lit(0)) / F.lit(divisor)).cast("double").alias("TriangleNum"))


def triangle_count(edges: DataFrame, algo: str = "fast_v2", ties: str = "drop") -> DataFrame:
    """One row ``(TriangleNum double)``; 0.0 for an empty graph.

    ``fast`` lets the lists of degree-ordered pairs meet, ``fast_v2`` intersects them pair by pair, ``fast_v3`` and ``fast_v4`` put heavy
    vertices last (each with its own threshold) and intersect or meet, the iterators close wedges or edges.
    All algorithms are exact but the two ``*_plus``, which by definition leave out triangles whose lowest
    (node) or highest (edge) degree is tied; ``ties='break'`` makes these exact too.
    """
    if algo not in UNDIRECTED:
        raise ValueError(f"unknown algorithm {algo!r}; one of {', '.join(UNDIRECTED)}")
    edges = N.endpoints(edges)
    if algo == "node_iter":
        return _count(K.closed_wedges(edges), 3)
    if algo == "edge_iter":
        return _sum(K.common_by_edge(edges), 3)
    if algo == "node_iter_plus" and ties == "drop":
        return _count(K.closed_wedges(edges, degree_filter=True))
    if algo == "edge_iter_plus" and ties == "drop":
        return _count(K.edge_iter_plus(edges))
    pairs = N.pairs(edges)
    oriented = O.by_heavy(pairs, edges, "lower" if algo == "fast_v3" else "all", light="degree") if algo in ("fast_v3", "fast_v4") else O.by_degree(pairs)
    if algo in ("node_iter_plus", "fast", "fast_v4"):
        return _count(K.triangles(oriented))
    return _sum(K.common_neighbors(oriented))


def census(coded: DataFrame, divisor: int = 1) -> DataFrame:
    """One row with a count for each class, zeros included, from rows that have a class ``code``."""
    return coded.agg(*[(F.count_if(F.col("code") == i) / F.lit(divisor)).cast("long").alias(name) for i, name in enumerate(TRIAD_CLASSES)])


def _total(classes: DataFrame, divisor: int = 1) -> DataFrame:
    """One row of the classes' sums over all vertices."""
    return classes.agg(*[(F.coalesce(F.sum(name), F.lit(0)) / F.lit(divisor)).cast("long").alias(name) for name in TRIAD_CLASSES])


def triad_census(edges: DataFrame, algo: str = "fast_v2", ties: str = "drop", duplicates: str = "collapse") -> DataFrame:
    """One row of seven bigint columns named in ``TRIAD_CLASSES``; see :func:`triangle_count` on ``ties``.

    ``duplicates='reciprocal'`` (``fast`` and ``fast_v3``) takes a repeated edge for a reciprocal pair; see
    :func:`trefoil.operators.normalize.canonical`.
    """
    if algo not in DIRECTED:
        raise ValueError(f"unknown algorithm {algo!r}; one of {', '.join(DIRECTED)}")
    if duplicates != "collapse" and algo not in ("fast", "fast_v3"):
        raise ValueError(f"duplicates={duplicates!r} needs fast or fast_v3")
    edges = N.endpoints(edges)
    if algo == "node_iter":
        return census(K.classified_wedges(edges), 3)
    if algo == "edge_iter":
        return _total(K.classes_by_edge(edges), 3)
    if algo == "node_iter_plus" and ties == "drop":
        return census(K.classified_wedges(edges, degree_filter=True))
    if algo == "edge_iter_plus" and ties == "drop":
        return census(K.classified_edge_iter_plus(edges))
    oriented = O.by_degree(N.canonical(edges, duplicates))
    return _total(K.target_classes(oriented)) if algo == "fast_v3" else census(K.classified(oriented))
