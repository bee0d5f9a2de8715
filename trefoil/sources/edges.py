"""Edge-list text files, result files and runner arguments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Delimiter names and what they stand for.
DELIMITERS = {"comma": ",", "space": " ", "semicolon": ";", "tab": "\t", "pipe": "|", "double_quote": '"', "star": "*"}


def delimiter(name: str) -> str:
    """The character for a delimiter's name; an unknown name means a space."""
    return DELIMITERS.get(name, " ")


def parse_args(args: list[str]) -> dict[str, str]:
    """``key:value`` words as a dict: split at the first colon, trimmed, last one wins; empty and ``Nan`` values are left out."""
    pairs = ((k.strip(), v.strip()) for k, colon, v in (a.partition(":") for a in args) if colon)
    return {k: v for k, v in pairs if v not in ("", "Nan")}


def load(spark: SparkSession, path: str, weighted: bool = False, header: bool = False, src_index: int = 0, dst_index: int = 1, weight_index: int = 2, sep: str = " ", comment: str | None = "#", mode: str = "PERMISSIVE") -> DataFrame:
    """``(src bigint, dst bigint[, weight float])`` from delimited text at any Hadoop path.

    Rows whose endpoints don't parse are dropped (or fail, with ``mode='FAILFAST'``); lines that start with
    ``comment`` are skipped.
    """
    want = {"src": (src_index, T.LongType()), "dst": (dst_index, T.LongType())} | ({"weight": (weight_index, T.FloatType())} if weighted else {})
    kinds = {i: kind for i, kind in want.values()}
    schema = T.StructType([T.StructField(f"c{i}", kinds.get(i, T.StringType())) for i in range(max(kinds) + 1)])
    reader = spark.read.schema(schema).option("sep", sep).option("header", header).option("mode", mode).option("enforceSchema", True)
    rows = (reader.option("comment", comment) if comment else reader).csv(path)
    return rows.select(*[F.col(f"c{i}").alias(name) for name, (i, _) in want.items()]).where("src is not null and dst is not null")


def save(df: DataFrame, path: str, sep: str = "\t") -> None:
    """Write a result as delimited text without a header, replacing what is there. One file: results are one row."""
    df.coalesce(1).write.mode("overwrite").option("sep", sep).option("header", False).csv(path)
