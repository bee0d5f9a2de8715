"""From a raw edge list to the relations that every plan below starts from.

Rows with a null endpoint are dropped, self-loops never reach a pair relation and duplicates collapse.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trefoil.functions.classify import direction_bit, flip, tag_of


def endpoints(df: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(src, dst)`` as bigint without null rows; other columns are pruned from the scan."""
    return df.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst")).where("src is not null and dst is not null")


def without_loops(edges: DataFrame) -> DataFrame:
    """Edges whose ends differ; duplicates stay."""
    return edges.where("src <> dst")


def distinct_edges(edges: DataFrame) -> DataFrame:
    """The directed simple graph."""
    return without_loops(edges).distinct()


def symmetrize(edges: DataFrame) -> DataFrame:
    """Each edge seen from both ends as ``(v, nbr)``, in one scan."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("v"), F.col("dst").alias("nbr")), F.struct(F.col("dst").alias("v"), F.col("src").alias("nbr"))))
    return edges.select(ends.alias("e")).select("e.v", "e.nbr")


def vertices(edges: DataFrame) -> DataFrame:
    """Every id that occurs, those with self-loops only included."""
    return symmetrize(edges).select("v").distinct()


def canonical(edges: DataFrame, duplicates: str = "collapse") -> DataFrame:
    """One row ``(a, b, mask)`` per adjacent pair with ``a < b``, in one partial aggregation.

    ``duplicates='collapse'`` folds repeated edges into one; ``'reciprocal'`` counts rows first, so that a pair with two edges
    or more is joined both ways, even if all run the same way.
    """
    if duplicates not in ("collapse", "reciprocal"):
        raise ValueError(f"duplicates={duplicates!r}; one of collapse, reciprocal")
    pair = without_loops(edges).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), direction_bit(F.col("src"), F.col("dst")).alias("bit"))
    mask = F.bit_or("bit") if duplicates == "collapse" else F.when(F.count("*") > 1, F.lit(3)).otherwise(F.first("bit"))
    return pair.groupBy("a", "b").agg(mask.alias("mask"))


def pairs(edges: DataFrame) -> DataFrame:
    """The undirected simple graph as ``(a, b)`` with ``a < b``."""
    return without_loops(edges).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def tagged(edges: DataFrame) -> DataFrame:
    """``(v, nbr, tag)``: each adjacent pair seen from both ends with its direction tag."""
    both = F.explode(
        F.array(
            F.struct(F.col("a").alias("v"), F.col("b").alias("nbr"), tag_of(F.col("mask")).alias("tag")),
            F.struct(F.col("b").alias("v"), F.col("a").alias("nbr"), tag_of(flip(F.col("mask"))).alias("tag")),
        )
    )
    return canonical(edges).select(both.alias("e")).select("e.v", "e.nbr", "e.tag")


def canonical_tagged(edges: DataFrame) -> DataFrame:
    """The half of :func:`tagged` that has ``v < nbr``."""
    return canonical(edges).select(F.col("a").alias("v"), F.col("b").alias("nbr"), tag_of(F.col("mask")).alias("tag"))


def directed_once(edges: DataFrame) -> DataFrame:
    """One row per adjacent pair, seen from its sender; reciprocal pairs from the lower id."""
    return tagged(edges).where("tag = 0 or (tag = 2 and v < nbr)")


def flipped(edges: DataFrame) -> DataFrame:
    """:func:`canonical_tagged` with IN rows turned round, so that only OUT and BOTH remain."""
    swap = F.col("tag") == 1
    return canonical_tagged(edges).select(
        F.when(swap, F.col("nbr")).otherwise(F.col("v")).alias("src"), F.when(swap, F.col("v")).otherwise(F.col("nbr")).alias("dst"), F.when(swap, F.lit(0)).otherwise(F.col("tag")).cast("tinyint").alias("tag")
    )


def adjacency(relation: DataFrame, where: str = "true", tags: bool = False) -> DataFrame:
    """``(v, nbrs)`` with ascending neighbours of a ``(v, nbr[, tag])`` relation, filtered before the exchange."""
    item = F.struct("nbr", "tag") if tags else F.col("nbr")
    return relation.where(where).groupBy("v").agg(F.array_sort(F.collect_set(item)).alias("nbrs"))
