"""A stream of edges kept as running statistics by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trefoil.operators.normalize import endpoints, symmetrize, without_loops


def running_degrees(edges: DataFrame) -> DataFrame:
    """``(v, edges)``: edge rows seen per vertex so far, loops left out, repeats counted. For complete or update mode."""
    return symmetrize(without_loops(endpoints(edges))).groupBy("v").agg(F.count("*").alias("edges"))


def distinct_pairs(edges: DataFrame, time: str, delay: str) -> DataFrame:
    """Each unordered pair once within the watermark ``delay`` of column ``time``; state older than that is dropped."""
    pairs = edges.where("src is not null and dst is not null").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.col(time)).where("a <> b")
    return pairs.withWatermark(time, delay).dropDuplicatesWithinWatermark(["a", "b"])
