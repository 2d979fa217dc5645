"""Streams over files, and the registry."""

from pyspark.sql import functions as F

from sievetrace.plans import registry
from sievetrace.sources import jsonl
from sievetrace.streaming import traces


def test_streams(spark, tmp_path):
    rows = spark.range(200).select((F.col("id") % 50).alias("k"), (F.timestamp_seconds(F.col("id") * 60)).alias("ts"), (F.col("id") % 3 == 0).alias("success"))
    src = str(tmp_path / "in")
    rows.repartition(4).write.parquet(src)
    ddl = "k bigint, ts timestamp, success boolean"
    got = []
    traces.run_all(traces.drop_copies(traces.read(spark, src, ddl), ["k"], "ts", "10 hours"), lambda df, n: got.extend(r.k for r in df.collect()), str(tmp_path / "c1"))
    assert sorted(got) == list(range(50))
    out = {}
    traces.run_all(traces.windowed_rates(traces.read(spark, src, ddl), "ts", "k", F.col("success"), lateness="10 hours"), lambda df, n: out.update({(r.window_start, r.k): r.attempts for r in df.collect()}), str(tmp_path / "c2"), "update")
    assert out == {(r.window_start, r.k): r.attempts for r in traces.windowed_rates(rows, "ts", "k", F.col("success")).collect()}
    traces.write_routed(traces.read(spark, src, ddl), str(tmp_path / "routed"), str(tmp_path / "c3")).awaitTermination()
    assert jsonl.read_routed(spark, str(tmp_path / "routed")).filter("success").count() == rows.filter("success").count()


def test_registry(spark):
    queries, sql = registry.queries(), registry.oracle_sql()
    assert len(queries) > 50 and set(sql) <= set(queries)
    df = queries["dataset_build"](spark, "/root/testdata/sf0.001")
    assert df.columns == ["split", "n_rows", "n_groups"] and df.count() > 0


def test_numbered(spark):
    from sievetrace.sources.working import numbered

    rows = spark.range(1000).select((F.col("id") * 7919 % 997).alias("a"), F.col("id").alias("b")).repartition(5)
    got = numbered(rows, "n", "a", "b").collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.n)] == sorted((r.a, r.b) for r in rows.collect()) and sorted(r.n for r in got) == list(range(1000))
    assert numbered(rows.limit(0), "n", "a").count() == 0
    assert [(r._line_no, r._file_ord) for r in jsonl.with_order(spark.range(3), "id").orderBy("id").collect()] == [(1, 0), (2, 0), (3, 0)]
