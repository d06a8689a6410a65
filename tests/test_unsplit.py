"""Folds whose training rows all fall in one bin: nothing to split, so no fit."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lattica.operators import arms, boosting, fullfold
from lattica.operators.split import Fold


@pytest.fixture(scope="module")
def late_days(spark, tmp_path_factory):
    """A line a day: bins differ before day 401 only, so that the first fold alone can split."""
    folder = str(tmp_path_factory.mktemp("unsplit"))
    day = F.col("id") + 1
    small = day <= 400
    spark.range(2000).select(
        F.timestamp_add("DAY", day.cast("int"), F.lit("1995-01-01").cast("timestamp")).alias("l_shipdate"),
        F.lit(0).cast("long").alias("l_suppkey"),
        (1.0 + day % 7).alias("l_quantity"),
        F.when(small, 0.01 * (day % 90)).otherwise(0.9 + 0.01 * (day % 50)).alias("l_discount"),
        F.when(small, 0.01 * (day % 50)).otherwise(0.45 + 0.01 * (day % 11)).alias("l_tax"),
        F.when(small, 1000.0 * (day % 320)).otherwise(400_000.0 + 1000 * (day % 13)).alias("l_extendedprice"),
    ).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    return folder


@pytest.mark.parametrize("name", ["model_boosted_arms", "model_out_of_fold_full"])
def test_folds_without_a_split_as_in_sql(spark, late_days, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{late_days}/lineitem.parquet/*.parquet')")
    want = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    want = Counter(want.fetchall())
    assert Counter(map(tuple, __spark_entry__.queries()[name](spark, late_days).select(*columns).collect())) == want
    # some folds have a fit, some haven't
    if name == "model_boosted_arms":
        assert {r[0] for r in want} == {0}
    else:
        assert {(r[columns.index("fold")], r[columns.index("prediction")] is None) for r in want} == {(-1, True), (0, False), (1, True), (2, True)}


def test_constants_where_no_split_is_needed(spark):
    """By default a forest that can't split predicts the mean, and says that it couldn't."""
    df = spark.createDataFrame([(t, 0, 1.0, float(t % 2), 0.0) for t in range(40)], "time_id long, asset_id long, weight double, target double, a double")
    how, folds = boosting.Settings(rounds=1, leaves=2, least_rows=5), [Fold(0, 0, 19, 20, 39)]
    assert not boosting.boost(df, ["a"], [boosting.Job(("one",))], how, edges={"a": [1.0]})["one",].could_split
    runs = {r.arm: r.v for r in arms.run_arms(df, folds, [arms.BoostedArm("x", ("a",), how), arms.BoostedArm("y", ("a",), how, need_split=True)], edges={"a": [1.0]}).collect()}
    assert runs == {"x": pytest.approx(5.0)}
    out = fullfold.out_of_fold(df, folds, ["a"], fullfold.Recipe(1, 1.0, how), edges={"a": [1.0]}).filter("fold = 0").select("prediction").distinct().collect()
    assert [r.prediction for r in out] == [pytest.approx(0.5)]
