"""What a run has read, paired and tried, taken from the run itself: observed metrics on the plan, no second scan."""

from __future__ import annotations

from time import perf_counter

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from trefoil.operators import kernels as K
from trefoil.operators import normalize as N
from trefoil.operators import orient as O


class Watch:
    """Observations of the relations that a plan passes through, by name.

    Use it as a function while the plan is built; after an action, :meth:`rows` and :meth:`partitions` have what it saw.
    """

    def __init__(self, partitions: int = 0):
        self.partitions_of = partitions
        self.seen: dict[str, Observation] = {}

    def __call__(self, name: str, df: DataFrame, counted: Column | None = None, sizes: bool = False) -> DataFrame:
        """``df`` under observation. ``counted`` is an aggregate that says how many there are, if not as many as rows."""
        self.seen[name] = Observation(f"{name}-{id(self)}")
        rows = (F.count(F.lit(1)) if counted is None else F.coalesce(counted, F.lit(0))).cast("long").alias("rows")
        if not sizes:
            return df.observe(self.seen[name], rows)
        # a histogram with a bin for every partition counts exactly
        histogram = F.histogram_numeric("__partition", F.lit(max(self.partitions_of, 2))).alias("sizes")
        return df.withColumn("__partition", F.spark_partition_id()).observe(self.seen[name], rows, histogram).drop("__partition")

    def _get(self, name: str) -> dict:
        try:
            return self.seen[name].get
        except Py4JJavaError:
            # Spark found the relation to be empty while it ran and took it out of the plan, metrics and all
            return {}

    def rows(self, name: str) -> int:
        return self._get(name).get("rows", 0)

    def partitions(self, name: str) -> list[int]:
        """Rows of each partition; those without a row were not seen and count as 0."""
        found = [int(b.y) for b in self._get(name).get("sizes") or []]
        return sorted(found + [0] * (self.partitions_of - len(found)))


def measured_count(edges: DataFrame, partitions: int, by=None) -> dict[str, float]:
    """Count the triangles of ``edges`` with the pairs in ``partitions`` partitions, and say what the run met on its way.

    ``loaded`` edge rows, distinct ``pairs``, their ``smallest_partition`` and ``largest_partition``, wedge ``candidates``, ``triangles`` and
    ``seconds``. ``by`` deals pairs to partitions by an integer expression, else by a hash of both ends. One action runs.
    """
    watch, began = Watch(partitions), perf_counter()
    pairs = N.pairs(watch("loaded", N.endpoints(edges)))
    dealt = pairs.repartition(partitions, "a", "b") if by is None else pairs.repartitionById(partitions, F.pmod(by, F.lit(partitions)).cast("int"))
    found = K.triangles(O.by_degree(watch("pairs", dealt, sizes=True)), watch)
    triangles = found.agg(F.count("*").alias("n")).first().n
    sizes = watch.partitions("pairs")
    return {
        "loaded": watch.rows("loaded"), "pairs": watch.rows("pairs"), "candidates": watch.rows("candidates"), "triangles": triangles,
        "smallest_partition": sizes[0], "largest_partition": sizes[-1], "seconds": perf_counter() - began,
    }


def run_statistics(edges: DataFrame, partitions: int, by=None) -> DataFrame:
    """:func:`measured_count` as one row, without the time."""
    found = measured_count(edges, partitions, by)
    names = [name for name in found if name != "seconds"]
    return edges.sparkSession.createDataFrame([tuple(found[n] for n in names)], ", ".join(f"{n} bigint" for n in names))
