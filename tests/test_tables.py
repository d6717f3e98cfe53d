"""Checked writers, resumable streaming and the entry registry."""

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

import __spark_entry__ as entry
from duelframe.sources import tables
from duelframe.streaming import ingest
from duelframe.streaming.ingest import ingest_stream
from tests.test_logs import LOG


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a'b"), (2, None)], "n long, s string")
    schema = StructType([StructField("n", LongType()), StructField("s", StringType()), StructField("more", StringType())])
    tables.write_all({"t": df}, str(tmp_path), {"t": schema})
    with pytest.raises(tables.LoadError):
        tables.write_all({"t": df}, str(tmp_path))
    with pytest.raises(tables.LoadError):
        tables.check_target(df.withColumnRenamed("s", "zz"), schema)
    assert tables.read_first(spark, str(tmp_path), "t").count() == 2 and tables.read_first(spark, str(tmp_path), "u") is None
    assert {r.value for r in tables.insert_lines(df, "t").collect()} == {"INSERT INTO t (n, s) VALUES (1, 'a\\'b');", "INSERT INTO t (n, s) VALUES (2, NULL);"}
    assert tables.conform(df, schema).columns == ["n", "s", "more"]
    assert tables.log_column(spark.createDataFrame([(1, "x|player|p1")], "i long, stuff string")) == "stuff"


def test_stream_resumes_and_skips_known(spark, tmp_path):
    schema = StructType([StructField("battle_id", StringType()), StructField("log", StringType())])
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for ids in (["b1", "b2"], ["b2", "b3"]):
        spark.createDataFrame([(i, LOG) for i in ids], schema).coalesce(1).write.mode("append").parquet(src)
        ingest_stream(spark, src, schema, out, check).awaitTermination()
    assert sorted(r.battle_id for r in spark.read.parquet(f"{out}/battle").collect()) == ["b1", "b2", "b3"]


def test_layouts_and_resume_points(spark, tmp_path):
    df = spark.createDataFrame([(i % 7, f"n{i % 3}") for i in range(50)], "n long, s string")
    with pytest.raises(tables.LoadError):
        tables.index_statements(df, "t", [["n"], ["absent"]])
    assert tables.index_statements(df, "t", [["n"], ["s", "n"]]) == ["CREATE INDEX idx_t_1 ON t (n)", "CREATE INDEX idx_t_2 ON t (s, n)"]
    tables.write_indexed(df, str(tmp_path / "i"), ["n"], ["s"], 2)
    tables.write_sorted(df, str(tmp_path / "s"), [("n", True)], ["s"])
    tables.write_json(df, str(tmp_path / "j"))
    for name in "is":
        assert sorted(map(tuple, spark.read.parquet(str(tmp_path / name)).collect())) == sorted(map(tuple, df.collect()))
    assert spark.read.json(str(tmp_path / "j")).count() == 50
    chunks = spark.createDataFrame([(0, 3), (1, 4), (2, 5)], "chunk int, rows long")
    assert [tables.resume_point(chunks, n) for n in (0, 3, 7, 12)] == [0, 1, 2, 3] and tables.resume_point(chunks.limit(0), 0) == 0
    for n in (1, 5, 13):
        with pytest.raises(tables.LoadError):
            tables.resume_point(chunks, n)
    (tmp_path / "l.csv").write_text("a,b\n\u00a0x\t,y\n,z\n")
    assert [tuple(r) for r in tables.read_lookup(spark, str(tmp_path / "l.csv")).collect()] == [("x", "y")]


def test_logs_of_several_sources(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "battle_id string, log string, uploadtime double"
    spark.createDataFrame([("b1", LOG, 5.0), ("b2", " ", None), ("b3", "|poke|p9|X|", 1.0), ("b4", "|turn|1", 7.4)], schema).coalesce(1).write.parquet(src)
    counts = ingest.write_batch(ingest.source_logs(spark.read.parquet(src)), 0, out)
    assert counts["battle"] == 2 and counts["errors"] == 2 and counts["battle_move"] == 4
    errors = {r.battle_id: (r.error, r.source_file is not None) for r in spark.read.parquet(f"{out}/errors").collect()}
    assert errors == {"b2": ("Empty or non-string log", True), "b3": ("roster line of an unknown side", False)}
    rows = {r.battle_id: r for r in ingest.read_parts(spark, out, "battle").collect()}
    assert rows["b4"].upload_time == 7 and rows["b1"].upload_time == 1704110400 and rows["b1"].replay_path.endswith(".parquet")
    assert ingest.source_logs(spark.read.parquet(src), id_col=None, limit_rows=2).count() == 2


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
