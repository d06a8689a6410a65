"""Profiles from footers give what a scan gives."""

import re

from pyspark.sql import functions as F

from lattica.sources import footers


def profile(spark, path, *columns):
    return [tuple(r) for r in footers.footer_profile(spark, [path], columns).collect()]


def test_footers_answer_counts_and_ranges(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).select("id", F.when(F.col("id") % 7 > 0, F.col("id") * 0.5).alias("x")).repartition(3).write.parquet(path)
    assert profile(spark, path, "id", "x") == [("id", 1000, 0, 0.0, 999.0), ("x", 1000, 143, 0.5, 499.5)]
    with footers.pushed_aggregates(spark):
        plan = footers.aggregated(spark, [path], ["id", "x"])._jdf.queryExecution().toString()
    assert re.search(r"PushedAggregation: \[\w", plan)
    assert "parquet" in spark.conf.get("spark.sql.sources.useV1SourceList")


def test_columns_without_statistics_are_scanned(spark, tmp_path):
    path = str(tmp_path / "t")
    nan = F.when(F.col("id") == 3, float("nan")).otherwise(F.col("id").cast("double"))
    spark.range(10).select("id", F.lit(None).cast("double").alias("none"), nan.alias("x")).write.parquet(path)
    rows = profile(spark, path, "id", "none", "x")
    assert rows[:2] == [("id", 10, 0, 0.0, 9.0), ("none", 10, 10, None, None)]
    assert rows[2][:4] == ("x", 10, 0, 0.0)
    spark.range(0).write.parquet(str(tmp_path / "empty"))
    assert profile(spark, str(tmp_path / "empty"), "id") == [("id", 0, 0, None, None)]


def test_row_groups(spark, tmp_path, monkeypatch):
    import hashlib

    import pyarrow as pa
    import pyarrow.parquet as pq

    table = pa.table({"t": list(range(10)), "x": [None if k < 4 else k * 0.5 for k in range(10)], "s": [f"s{k}" for k in range(10)]})
    (tmp_path / "deep").mkdir()
    pq.write_table(table, tmp_path / "a.parquet", row_group_size=4)
    pq.write_table(table.slice(0, 0), tmp_path / "deep" / "b.parquet")
    want = {("a", 0, 4, ("t", 0, "0", "3"), ("x", 4, None, None)), ("a", 1, 4, ("t", 0, "4", "7"), ("x", 0, "2.0", "3.5")), ("a", 2, 2, ("t", 0, "8", "9"), ("x", 0, "4.0", "4.5"))}
    for opened, with_hash in ((footers.OPENED, False), (footers.OPENED, True), ((), False)):
        monkeypatch.setattr(footers, "OPENED", opened)
        rows = footers.row_groups(spark, str(tmp_path), ["t", "x", "absent"], with_hash).collect()
        got = {(r.path.rsplit("/", 1)[1][0], r.group, r.group_rows, *[tuple(x) for x in r.ranges[:2]]) for r in rows if r.group_rows}
        assert got == want and all(tuple(r.ranges[2]) == ("absent", None, None, None) for r in rows if r.group is not None)
        empty = [r for r in rows if not r.group_rows]
        assert len(empty) == 1 and (empty[0].rows, empty[0].columns) == (0, ["t", "x", "s"])
        for r in rows:
            raw = open(r.path.removeprefix("file:"), "rb").read()
            assert r.bytes == len(raw) and r.sha256 == (hashlib.sha256(raw).hexdigest() if with_hash else None) and "t: int64" in r.schema
