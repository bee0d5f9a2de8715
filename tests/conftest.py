import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parents[1]}:{os.environ.get('PYTHONPATH', '')}"
    conf = {
        "spark.sql.shuffle.partitions": "4", "spark.default.parallelism": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "6g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")), "spark.ui.showConsoleProgress": "false",
    }
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows_of(df):
    """Rows as sorted tuples in the order of the sorted column names."""
    names = sorted(df.columns)
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def duck_rows(sql, sf_dir=SF):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in Path(sf_dir).iterdir():
        con.execute(f"create view {p.name.split('.')[0]} as select * from '{p}'")
    rel = con.sql(sql)
    at = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    return sorted(rel.columns), sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)
