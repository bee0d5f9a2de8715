"""Counts and degree statistics. Each is one aggregation; none brings a vertex-sized map to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trefoil.operators import normalize as N
from trefoil.operators.messages import aggregate_messages


def degrees(edges: DataFrame) -> DataFrame:
    """``(v, degree)`` of the undirected simple graph: each pair sends 1 to both its ends. A vertex with self-loops only has degree 0, which its loops send it."""
    ends = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    one = {"degree": (F.col("a") != F.col("b")).cast("long")}
    return aggregate_messages(ends, {"degree": F.sum}, one, one, src="a", dst="b")


def pair_degrees(pairs: DataFrame) -> DataFrame:
    """``(v, degree)`` from distinct pairs; vertices without a neighbour don't occur. Masks, if there are any, are read though each counts 1, so that pairs with masks are shuffled once for both uses."""
    one = {"degree": (F.col("mask").isNotNull() if "mask" in pairs.columns else F.lit(1)).cast("long")}
    return aggregate_messages(pairs, {"degree": F.sum}, one, one, src="a", dst="b")


def max_degree(edges: DataFrame) -> DataFrame:
    return degrees(edges).agg(F.coalesce(F.max("degree"), F.lit(0)).alias("max_degree"))


def reduced_degrees(edges: DataFrame) -> DataFrame:
    """``(v, degree)`` counting only neighbours with a higher id; only vertices that have one."""
    return N.pairs(edges).groupBy(F.col("a").alias("v")).agg(F.count("*").alias("degree"))


def vertex_count(edges: DataFrame) -> DataFrame:
    return N.vertices(edges).agg(F.count("*").alias("vertices"))


def edge_count(edges: DataFrame) -> DataFrame:
    return N.pairs(edges).agg(F.count("*").alias("edges"))


def max_vertex(edges: DataFrame) -> DataFrame:
    return edges.agg(F.max(F.greatest("src", "dst")).alias("max_vertex"))


def wedge_count(edges: DataFrame) -> DataFrame:
    """Pairs of edges that share a vertex, in 64 bits."""
    return degrees(edges).agg(F.coalesce(F.sum(F.expr("degree * (degree - 1) div 2")), F.lit(0)).cast("long").alias("wedges"))


def tag_histogram(edges: DataFrame) -> DataFrame:
    """Pairs joined one way and both ways; one row, zeros for an empty graph."""
    tag = F.col("tag")
    return N.directed_once(edges).agg(F.count_if(tag == 0).alias("out_pairs"), F.count_if(tag == 1).alias("in_pairs"), F.count_if(tag == 2).alias("both_pairs"))


def partition_sizes(df: DataFrame) -> DataFrame:
    """Smallest and largest partition, for a look at skew."""
    return df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.min("count").alias("smallest"), F.max("count").alias("largest"))
