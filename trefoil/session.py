"""Session helpers shared by the graph operators and the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


_homes: set[str] = set()
_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: Bytes of a Parquet row group: what a task holds of a file that it writes, and later of one that it reads.
ROW_GROUP_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    Clusters name it in ``spark.checkpoint.dir``. Only where that is unset (a local session, as in the
    tests) is a temporary folder made, and it is written back to the session so later calls agree.
    """
    found = spark.conf.get("spark.trefoil.shared.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="trefoil-")
        spark.conf.set("spark.trefoil.shared.dir", found)
    return found.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    """The path and its file system, as the driver's JVM has them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's own folder under the shared one, which is deleted when the driver ends."""
    home = f"{shared_dir(spark)}/trefoil-{spark.sparkContext.applicationId}"
    if home not in _homes:
        at, system = _hadoop(spark, home)
        system.mkdirs(at)
        system.deleteOnExit(at)
        _homes.add(home)
    return f"{home}/{name}-{uuid.uuid4().hex}"


def bounded_row_groups(spark: SparkSession) -> None:
    """Hold what a task buffers of Parquet files: row groups written from now on have ROW_GROUP_BYTES, and those read aren't copied.

    Parquet's own 128 MB are held by each task that writes and by each that reads, besides its own work. Its vectored reads take a
    row group's columns in one piece, of which the JVM keeps a copy of that size outside the heap for each thread. Smaller values that are set stay.
    """
    set_before = spark.conf.get("parquet.block.size", None) or spark.sparkContext._jsc.hadoopConfiguration().get("parquet.block.size")
    if not set_before or int(set_before) > ROW_GROUP_BYTES:
        spark.conf.set("parquet.block.size", str(ROW_GROUP_BYTES))
    spark.conf.set("parquet.hadoop.vectored.io.enabled", "false")
    spark.conf.set("parquet.read.allocation.size", str((1 << 20) - 64))  # with its header a piece fills whole regions of the heap; 8 MB and a header take nine of 1 MB


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    _written[found] = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete what :func:`materialize` wrote for these tables, once nothing that is still to run reads them."""
    for table in tables:
        if path := _written.pop(table, None):
            at, system = _hadoop(table.sparkSession, path)
            system.delete(at, True)
