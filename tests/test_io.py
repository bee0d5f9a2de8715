"""Text sources, sinks, arguments, transformers, command line and streams."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from trefoil import cli
from trefoil.plans.transformers import TriangleCounter
from trefoil.session import discard, materialize
from trefoil.sources.edges import delimiter, load, parse_args, save
from trefoil.streaming.edges import distinct_pairs, running_degrees


def test_delimiters_and_arguments():
    assert [delimiter(x) for x in ("comma", "space", "semicolon", "tab", "pipe", "double_quote", "star", "other")] == [",", " ", ";", "\t", "|", '"', "*", " "]
    assert parse_args(["input:hdfs://h/x", " algo : fast ", "sep:", "mode:Nan", "junk", "algo:fast_v2"]) == {"input": "hdfs://h/x", "algo": "fast_v2"}


def test_load_drops_what_does_not_parse(spark, tmp_path):
    (tmp_path / "e.txt").write_text("1 2\n# note\nx 3\n8\n5 6 7\n\n2 3\n")
    assert sorted(map(tuple, load(spark, str(tmp_path / "e.txt")).collect())) == [(1, 2), (2, 3), (5, 6)]
    (tmp_path / "w.csv").write_text("w,to,from\n0.5,2,1\n1.5,3,2\n")
    got = load(spark, str(tmp_path / "w.csv"), weighted=True, header=True, src_index=2, dst_index=1, weight_index=0, sep=",")
    assert sorted(map(tuple, got.collect())) == [(1, 2, 0.5), (2, 3, 1.5)]
    (tmp_path / "bad.txt").write_text("x 3\n")
    with pytest.raises(Exception):
        load(spark, str(tmp_path / "bad.txt"), mode="FAILFAST").collect()


def test_save_round_trip_and_cli(spark, tmp_path):
    (tmp_path / "e.txt").write_text("1\t2\n2\t3\n3\t1\n2\t1\n")
    out = str(tmp_path / "out")
    row = cli.run(spark, [f"input:{tmp_path}/e.txt", f"output:{out}", "sep:tab", "directed:true", "algo:fast", "partitionNum:3", "storageLevel:MEMORY_AND_DISK", f"cpDir:{tmp_path}/cp"])
    assert list(row.collect()[0]) == [0, 0, 0, 0, 1, 0, 0]
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert text == "0\t0\t0\t0\t1\t0\t0\n"
    assert not spark.sparkContext._jsc.getPersistentRDDs() and spark.conf.get("spark.trefoil.shared.dir") == f"{tmp_path}/cp"
    assert not (tmp_path / "cp").exists()  # graph plans write nothing on the way
    spark.conf.unset("spark.trefoil.shared.dir")
    save(spark.range(1), out)
    assert cli.run(spark, [f"input:{tmp_path}/e.txt", "sep:tab"]).collect()[0][0] == 1.0


def test_command_line_starts_as_a_file(tmp_path):
    (tmp_path / "e.txt").write_text("1 2\n2 3\n3 1\n")
    script = Path(cli.__file__)
    done = subprocess.run([sys.executable, str(script), "mode:local[1]", f"input:{tmp_path}/e.txt", f"output:{tmp_path}/out"], capture_output=True, text=True, timeout=300, cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.returncode == 0, done.stderr[-2000:]
    assert "".join(p.read_text() for p in (tmp_path / "out").glob("part-*")) == "1.0\n"


def test_written_tables_are_discarded(spark):
    table = materialize(spark.range(3), "gone")
    files = table.inputFiles()
    discard(table)
    assert files and not any(Path(f.removeprefix("file:")).exists() for f in files)


def test_transformer_params(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, "x"), (2, 3, "y"), (1, 3, "z")], "f bigint, t bigint, src string")
    t = TriangleCounter(srcNodeIdCol="f", dstNodeIdCol="t")
    assert t.transform(df).columns == ["TriangleNum"] and t.transform(df).collect()[0][0] == 1.0
    assert t.copy({t.isDirected: True}).transform(df).collect()[0]["Trans"] == 1
    t.save(str(tmp_path / "t"))
    assert TriangleCounter.load(str(tmp_path / "t")).getOrDefault("srcNodeIdCol") == "f"


def test_streams(spark, tmp_path):
    rows = [(1, None, 5), (1, 2, 0), (2, 1, 10), (2, 3, 20), (3, 3, 30), (1, 2, 40)]
    spark.createDataFrame(rows, "src bigint, dst bigint, s int").selectExpr("src", "dst", "timestamp_seconds(s) as ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("src bigint, dst bigint, ts timestamp").parquet(str(tmp_path / "in"))
    for name, df, mode in (("deg", running_degrees(stream), "complete"), ("pairs", distinct_pairs(stream, "ts", "1 hour"), "append")):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert dict(spark.table("deg").collect()) == {1: 3, 2: 4, 3: 1}
    assert sorted((r.a, r.b) for r in spark.table("pairs").collect()) == [(1, 2), (2, 3)]
