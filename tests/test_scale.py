"""Merkle trees, exact sums, slices of time, numbered rows: the same rows as plain code gives, however rows are dealt out."""

import hashlib
import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lattica.operators import exact, merkle, metrics, split, temporal


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_root(rows):
    level = {}
    for t in sorted({t for t, _, _ in rows}):
        level[t] = sha(",".join("null" if v is None else str(v) for _, _, v in sorted((r for r in rows if r[0] == t), key=lambda r: r[1])))
    while len(level) > merkle.FANOUT:
        up = {}
        for t in sorted(level):
            up.setdefault(t // merkle.FANOUT, []).append(level[t])
        level = {k: sha(",".join(v)) for k, v in up.items()}
    return sha(",".join(level[k] for k in sorted(level)))


def frame(spark, rows, parts):
    return spark.createDataFrame(rows, "time_id long, asset_id long, v long").repartition(parts)


def test_one_root_for_any_partitions_and_changes_found_by_going_down(spark):
    rng = random.Random(1)
    rows = [(t, k, rng.choice([None, 1, 2, 3])) for t in rng.sample(range(-9000, 9000), 700) for k in range(rng.randint(1, 4))]
    one = merkle.tree(frame(spark, rows, 1), "v")
    assert len(one) == 4 and one[-1].first().d == plain_root(rows) and one[-1].first().rows == len(rows)
    assert merkle.tree(frame(spark, rows, 7), "v")[-1].first().d == plain_root(rows)
    other = list(rows)
    other[5] = (*rows[5][:2], 9)
    del other[100]
    other.append((rows[300][0], 77, 1))
    wrong = {rows[5][0], rows[100][0], rows[300][0]}
    assert {r.node for r in merkle.changed(one, merkle.tree(frame(spark, other, 3), "v")).collect()} == wrong
    assert merkle.changed(one, merkle.tree(frame(spark, rows, 4), "v")).count() == 0
    few = merkle.tree(frame(spark, rows[:20], 2), "v")
    assert {r.node for r in merkle.changed(one, few).collect()} >= {t for t, _, _ in rows} - {t for t, _, _ in rows[:20]}
    assert merkle.tree(frame(spark, [], 1), "v")[-1].first() == (0, sha(""), 0)
    with pytest.raises(Exception, match="without a time"):
        merkle.tree(frame(spark, [(None, 1, 1)], 1), "v")


def test_sums_are_exact_and_of_no_order(spark):
    rng = random.Random(2)
    values = [rng.uniform(-1, 1) * 10.0 ** rng.randint(-12, 20) for _ in range(3000)] + [1e30, -1e30, 0.1, 0.5, -0.5, 1.5, 2.5, 5e-324, math.nan, None, math.inf, 2.0**53 + 2, -(2.0**52) - 0.5]
    cut = 1 << 90
    want = float(sum((Fraction(math.trunc(Fraction(v) * cut), cut) for v in values if v is not None and math.isfinite(v)), Fraction(0)))
    df = spark.createDataFrame([(k % 3, v) for k, v in enumerate(values)], "g int, v double")
    found = {exact.exact_sums(df.repartition(n).orderBy(F.rand(n)), {"s": F.col("v")})["s"] for n in (1, 2, 9)}
    assert found == {want}
    assert sum(Fraction(x["s"]) for x in exact.exact_sums(df, {"s": F.col("v")}, by="g").values()) == pytest.approx(want)
    assert exact.exact_sums(df.limit(0), {"s": F.col("v")}) == {"s": 0.0}


def test_reruns_give_the_same_bits(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(rng.gauss(0, 1), rng.gauss(0, 1e6), rng.random(), rng.gauss(1, 1)) for _ in range(2000)], "a double, b double, w double, y double")
    runs = exact.rerun(df, ["a", "b"], "y", "w", 1.0, [1, 2, 5, 8])
    assert all(exact.largest_difference(m, runs[0][1]) == 0 for _, m in runs)
    from lattica.operators import linear

    plain = linear.ridge(linear.gram(df, ["a", "b"], ["y"], "w"), 1.0)
    assert runs[0][1].weights.ravel().tolist() == pytest.approx(plain.weights.ravel().tolist())


@pytest.mark.parametrize("length,steps,rows", [(50, 20, 5), (7, 20, 5), (50, 0, 30), (1000, 3, 0), (3, 0, 2)])
def test_slices_give_what_whole_windows_give(spark, length, steps, rows):
    rng = random.Random(length)
    data = [(t, k, float(rng.randint(0, 9))) for k, share in enumerate((1.0, 0.5, 0.05, 0.01)) for t in range(-150, 250) if rng.random() < share]
    df = spark.createDataFrame(data, "time_id long, asset_id long, x double").repartition(4)

    def columns(by):
        out = {}
        if rows:
            out |= {"mean": F.avg("x").over(by.rowsBetween(-rows, -1)), "lag": F.lag("x", rows).over(by)}
        if steps:
            out |= {"sum": F.sum("x").over(by.rangeBetween(-steps, 0))}
        return out

    want = df.withColumns(columns(Window.partitionBy("asset_id").orderBy("time_id")))
    got = temporal.sliced(df, length, steps, rows, columns)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_numbered_rows_and_times(spark):
    df = spark.createDataFrame([(t, k, 1.0) for t in range(0, 400, 4) for k in range(3)], "time_id long, asset_id long, x double").repartition(5)
    got = sorted((r.time_id, r.asset_id) for r in split.evenly_spaced(df, 4).collect())
    order = sorted((t, k) for t in range(0, 400, 4) for k in range(3))
    assert got == [order[round(i * 299 / 3)] for i in range(4)]
    assert split.evenly_spaced(df, 1).count() == 1 and split.evenly_spaced(df, 1000).count() == 300 and split.evenly_spaced(df.limit(0), 3).count() == 0
    assert split.sample_times(df, 10, 1, most_rows=17).count() == 17
    assert split.sample_times(df, 10, 1, most_rows=17).exceptAll(split.sample_times(df, 10, 1)).count() == 0
    assert [(r.time_id, r.place, r.rows) for r in split.distinct_times(df.unionByName(df.limit(1).withColumn("time_id", F.lit(None).cast("long")))).orderBy("time_id").limit(2).collect()] == [(0, 0, 3), (4, 1, 3)]
    assert split.keep_times(df, spark.createDataFrame([(4,), (4,), (None,), (5,)], "time_id long")).count() == 3
    blocks = {(r.block, r.n) for r in split.purged_blocks(df, 4).groupBy("block").agg(F.count("*").alias("n")).collect()}
    assert blocks == {(-1, 15), (0, 22), (1, 21), (2, 21), (3, 21)}
    for plan in (split.purge(split.purged_blocks(df, 4), 1, 2), split.quantile_segments(df, 4)):
        windows = [line for line in plan._jdf.queryExecution().toString().split("Physical Plan")[-1].splitlines() if "Window [" in line]
        assert all("[_range#" in line for line in windows)


def test_robust_figures_of_columns_without_values(spark):
    df = spark.createDataFrame([(math.nan, 1.0), (None, 3.0)], "a double, b double")
    assert [tuple(r) for r in metrics.fit_robust(df, ["a", "b"]).collect()] == [("a", None, None, None, 1e-4), ("b", 1.002, pytest.approx(2.998), 2.0, 1.0)]


def test_long_means_do_not_drift(spark):
    """Differences of running sums over a long series of large values stay within 1e-9 of the windows' own means."""
    rng = random.Random(9)
    x = [1e6 + rng.gauss(0, 1) for _ in range(20_000)]
    df = spark.createDataFrame([(k, 0, v) for k, v in enumerate(x)], "time_id long, asset_id long, x double")
    got = {r.time_id: r.m for r in temporal.with_long_mean(df, "x", 300, "m").collect()}
    for k in (1, 5, 299, 300, 301, 9_999, 19_999):
        own = x[max(0, k - 300) : k]
        assert got[k] == pytest.approx(math.fsum(own) / len(own), rel=1e-9)
    assert got[0] == 0.0
