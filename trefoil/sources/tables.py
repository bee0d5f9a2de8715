"""Edge lists derived from the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trefoil.operators.normalize import endpoints


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part to supplier in one id space: duplicates, loops and hubs."""
    return endpoints(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


def next_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part to the next one of its order, by line number, part and supplier."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return endpoints(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst")))
