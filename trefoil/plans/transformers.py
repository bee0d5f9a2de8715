"""``pyspark.ml`` transformers over the plans, so that they fit into pipelines."""

from __future__ import annotations

from pyspark import StorageLevel, keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from pyspark.sql.types import ByteType, DoubleType, IntegerType, LongType, ShortType, StructField, StructType

from trefoil.functions.classify import TRIAD_CLASSES
from trefoil.operators.normalize import endpoints
from trefoil.plans.algorithms import triad_census, triangle_count


class TriangleCounter(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """An edge list to one row: the triangle count, or with ``isDirected`` the triad census.

    ``transform`` describes a plan and starts no job, so it can be explained, joined on or streamed into. ``partitionNum`` and ``storageLevel`` are
    left to AQE unless set; the level's name is one of ``pyspark.StorageLevel``'s. Only with a level is the row worked out at once, so that the edges can be let go.
    """

    srcNodeIdCol = Param(Params._dummy(), "srcNodeIdCol", "source id column", TypeConverters.toString)
    dstNodeIdCol = Param(Params._dummy(), "dstNodeIdCol", "target id column", TypeConverters.toString)
    isDirected = Param(Params._dummy(), "isDirected", "census instead of count", TypeConverters.toBoolean)
    algo = Param(Params._dummy(), "algo", "algorithm key", TypeConverters.toString)
    ties = Param(Params._dummy(), "ties", "drop or break degree ties in *_plus", TypeConverters.toString)
    partitionNum = Param(Params._dummy(), "partitionNum", "partitions of the edges, 0 for Spark's choice", TypeConverters.toInt)
    storageLevel = Param(Params._dummy(), "storageLevel", "storage level of the edges, empty for none", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, srcNodeIdCol="src", dstNodeIdCol="dst", isDirected=False, algo="fast_v2", ties="drop", partitionNum=0, storageLevel=""):
        super().__init__()
        self._setDefault(srcNodeIdCol="src", dstNodeIdCol="dst", isDirected=False, algo="fast_v2", ties="drop", partitionNum=0, storageLevel="")
        self._set(**self._input_kwargs)

    def transformSchema(self, schema: StructType) -> StructType:
        """The result's schema, which depends on ``isDirected`` alone; fails if the input has not both id columns as whole numbers."""
        for name in (self.getOrDefault(self.srcNodeIdCol), self.getOrDefault(self.dstNodeIdCol)):
            found = next((f.dataType for f in schema.fields if f.name == name), None)
            if not isinstance(found, (ByteType, ShortType, IntegerType, LongType)):
                raise ValueError(f"{name!r} must be a column of whole numbers, not {found.simpleString() if found else 'missing'}; columns: {', '.join(schema.names)}")
        if self.getOrDefault(self.isDirected):
            return StructType([StructField(name, LongType()) for name in TRIAD_CLASSES])
        return StructType([StructField("TriangleNum", DoubleType())])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        get = lambda p: self.getOrDefault(p)
        schema = self.transformSchema(dataset.schema)
        edges = endpoints(dataset, get(self.srcNodeIdCol), get(self.dstNodeIdCol))
        if n := get(self.partitionNum):
            edges = edges.repartition(n, "src", "dst")
        if level := get(self.storageLevel):
            edges = edges.persist(getattr(StorageLevel, level))
        result = (triad_census if get(self.isDirected) else triangle_count)(edges, get(self.algo), get(self.ties))
        if not level:
            return result
        row = dataset.sparkSession.createDataFrame(result.collect(), schema)
        edges.unpersist()
        return row
