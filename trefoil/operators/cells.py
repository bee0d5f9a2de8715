"""Triangles on a grid of shares: every pair goes to the cells that may need it, and triangles close within a cell.

Vertices are dealt into ``side`` shares by hash. The cell ``(i, j, k)`` finds the triangles whose first vertex is of share i, whose second of
share j and whose third of share k, in the orientation's order. A pair is the first edge of triangles in one line of cells, the last edge in
another and the long edge in a third, so it is sent ``3 * side`` times, and to no more tasks than that however many there are. Pairs of a vertex
and a share travel as one list. Lists, their meeting and closing keep its layout. Give it oriented pairs of bounded out-degree: a cell lists a vertex's upper neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What a copy of a pair is in its cell: first to second vertex, first to third, second to third.
FIRST, LONG, LAST = 0, 1, 2


def default_side(df: DataFrame) -> int:
    """The least side that gives each shuffle partition a cell."""
    partitions, side = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1
    while side**3 < partitions:
        side += 1
    return side


def _sent(rows: DataFrame, side: int, *payload: str) -> DataFrame:
    """``(cell, role, *payload)``: rows with the shares ``__a`` and ``__b`` of their ends, each once for every cell and role."""
    cell = lambda i, j, k, role: F.struct(((i * side + j) * side + k).alias("cell"), F.lit(role).alias("role"))
    a, b, line = F.col("__a"), F.col("__b"), F.sequence(F.lit(0), F.lit(side - 1))
    sent = F.concat(F.transform(line, lambda k: cell(a, b, k, FIRST)), F.transform(line, lambda j: cell(a, j, b, LONG)), F.transform(line, lambda i: cell(i, a, b, LAST)))
    return rows.select(F.explode(sent).alias("c"), *payload).select("c.cell", "c.role", *payload)


def _shares(oriented: DataFrame, side: int) -> DataFrame:
    """Pairs with the shares of their ends."""
    share = lambda end: F.pmod(F.xxhash64(end), F.lit(side)).cast("int")
    return oriented.select("a", "b", share("a").alias("__a"), share("b").alias("__b"))


def copies(oriented: DataFrame, side: int) -> DataFrame:
    """``(cell, role, a, b)``: each oriented pair once for every cell and role."""
    return _sent(_shares(oriented, side), side, "a", "b")


def list_copies(oriented: DataFrame, side: int) -> DataFrame:
    """``(cell, role, a, nbrs)``: :func:`copies` with a's upper neighbours of one share as one row. A vertex has at most one row of a role in a cell."""
    lists = _shares(oriented, side).repartition("a").groupBy("a", "__a", "__b").agg(F.collect_list("b").alias("nbrs"))
    return _sent(lists, side, "a", "nbrs")


def _closed(oriented: DataFrame, side: int | None) -> DataFrame:
    """``(x, y, thirds)``: the third vertices of the triangles that a cell has over x and y, in the orientation's order."""
    dealt = list_copies(oriented, side or default_side(oriented)).repartition("cell")
    of = lambda role: F.first(F.when(F.col("role") == role, F.col("nbrs")), ignorenulls=True)
    owned = dealt.groupBy("cell", "a").agg(of(FIRST).alias("seconds"), of(LONG).alias("thirds"), of(LAST).alias("last"))
    # x's thirds go to each of its second vertices, where the last edges of these are
    none = F.array().cast("array<bigint>")
    asked = F.when(F.col("thirds").isNotNull(), F.coalesce("seconds", none)).otherwise(none)
    owner = F.when(F.col("last").isNotNull(), F.array("a")).otherwise(none)
    met = owned.select("cell", "a", "thirds", "last", F.size(asked).alias("n"), F.posexplode(F.concat(asked, owner)).alias("i", "y"))
    asks = F.col("i") < F.col("n")
    met = met.select("cell", "y", F.when(asks, F.col("a")).alias("x"), F.when(asks, F.col("thirds")).otherwise(F.col("last")).alias("ends"))
    last = F.first(F.when(F.col("x").isNull(), F.col("ends")), ignorenulls=True).over(Window.partitionBy("cell", "y"))
    met = met.withColumn("last", last).where("x is not null and last is not null")
    return met.select("x", "y", F.array_intersect("ends", "last").alias("thirds")).where(F.size("thirds") > 0)


def triangles_by_cells(oriented: DataFrame, side: int | None = None) -> DataFrame:
    """Each triangle of oriented pairs ``(a, b)`` once as ``(x, y, z)`` in the order of ids."""
    found = _closed(oriented, side).select("x", "y", F.explode("thirds").alias("z"))
    low, high = F.least("x", "y", "z"), F.greatest("x", "y", "z")
    inner = lambda v: (F.col(v) != low) & (F.col(v) != high)
    return found.select(low.alias("x"), F.when(inner("x"), F.col("x")).when(inner("y"), F.col("y")).otherwise(F.col("z")).alias("y"), high.alias("z"))


def count_by_cells(oriented: DataFrame, side: int | None = None) -> DataFrame:
    """One row ``(triangles)``, without listing any."""
    return _closed(oriented, side).agg(F.coalesce(F.sum(F.size("thirds")), F.lit(0)).cast("long").alias("triangles"))


__all__ = ["default_side", "copies", "list_copies", "triangles_by_cells", "count_by_cells"]
