"""``spark-submit trefoil/cli.py input:PATH output:PATH algo:fast_v2 sep:tab directed:true ...``

``mode`` is the master (``spark-submit``'s own if not given), ``cpDir`` the folder that driver and executors share; without it
the session's ``spark.checkpoint.dir`` counts, then the application's folder in YARN's staging directory.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

if not __package__:
    # started as a file: the package's parent isn't on the path
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from trefoil.plans.transformers import TriangleCounter
from trefoil.sources.edges import delimiter, load, parse_args, save


def staging_dir(spark: SparkSession) -> str | None:
    """The application's folder in YARN's staging directory, if there is one."""
    base = spark.sparkContext.getConf().get("spark.yarn.stagingDir")
    return base and f"{base}/.sparkStaging/{spark.sparkContext.applicationId}"


def run(spark: SparkSession, args: list[str]) -> DataFrame:
    """Load, count, save if there is an ``output``; returns the result row."""
    a = parse_args(args)
    yes = lambda key: a.get(key, "false").lower() == "true"
    if shared := a.get("cpDir") or spark.conf.get("spark.checkpoint.dir", None) or staging_dir(spark):
        spark.conf.set("spark.trefoil.shared.dir", shared)
    edges = load(spark, a["input"], yes("weighted"), yes("header"), int(a.get("srcIndex", 0)), int(a.get("dstIndex", 1)), int(a.get("weightIndex", 2)), delimiter(a.get("sep", "space")))
    job = TriangleCounter(isDirected=yes("directed"), algo=a.get("algo", "fast_v2"), ties=a.get("ties", "drop"), partitionNum=int(a.get("partitionNum", 0)), storageLevel=a.get("storageLevel", ""))
    result = job.transform(edges)
    if "output" in a:
        save(result, a["output"])
    return result


if __name__ == "__main__":
    builder = SparkSession.builder.appName("trefoil")
    master = parse_args(sys.argv[1:]).get("mode")
    session = (builder.master(master) if master else builder).getOrCreate()
    run(session, sys.argv[1:]).show()
    session.stop()
