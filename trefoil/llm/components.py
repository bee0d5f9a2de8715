"""Connected components of a link table by alternating large-star and small-star steps, all in joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trefoil.session import discard, materialize


def _smallest(edges: DataFrame) -> DataFrame:
    """``(u, v, m)``: each directed edge with the smallest id among u and its neighbours."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return edges.join(least, "u")


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")


def connected(links: DataFrame) -> DataFrame:
    """``(node, component)`` of every id in ``links(u bigint, v bigint)``; a component is named by its smallest id.

    Hubs are safe: minima are aggregated before the shuffle and the join back is a plain equi-join, which Spark
    splits when skewed. Each round is written to the shared folder and replaces the one before. Null ends and loops are ignored.
    """
    edges = materialize(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    print_of = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = print_of(edges)
    while before[0]:
        large = _smallest(_both(edges)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # all edges of `large` point down, so a node's lower neighbours are its v's
        small = _smallest(large).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), F.col("m")))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        last, edges = edges, materialize(small.where("u <> v").distinct(), "links")
        discard(last)
        now = print_of(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
