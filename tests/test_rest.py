"""Sources that survive interruptions, pushed ranges, picked penalties, ladders and selections."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import infer, linear, metrics, temporal
from lattica.sources import panels, tables

SF = "/root/testdata/sf0.001"


def test_a_cache_that_was_interrupted_is_written_anew(spark, tmp_path, monkeypatch):
    df, path = spark.range(10).toDF("x"), f"file://{tmp_path}/cache"
    rename = tables._rename

    def killed(*args):
        raise KeyboardInterrupt

    monkeypatch.setattr(tables, "_rename", killed)
    with pytest.raises(KeyboardInterrupt):
        tables.cached_sample(df, path, {"modulo": 3})
    assert not (tmp_path / "cache").exists()
    monkeypatch.setattr(tables, "_rename", rename)
    assert tables.cached_sample(df, path, {"modulo": 3}).count() == 10
    assert tables.cached_sample(df.limit(1), path, {"modulo": 3}).count() == 10
    with pytest.raises(ValueError, match="something else"):
        tables.cached_sample(df, path, {"modulo": 4})


def test_the_first_of_two_writers_counts(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/cache"
    read, calls = tables._read_text, []

    def late(s, p):  # another writer commits after this one has looked
        calls.append(p)
        if len(calls) == 1:
            monkeypatch.setattr(tables, "_read_text", read)
            tables.cached_sample(spark.range(3).toDF("x"), path, {"a": 1})
            return None
        return read(s, p)

    monkeypatch.setattr(tables, "_read_text", late)
    assert tables.cached_sample(spark.range(5).toDF("x"), path, {"a": 1}).count() == 3
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["cache"]


def test_a_range_of_time_reaches_the_scan(spark):
    plan = panels.ship_panel(spark, SF, 300, 420)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan and "LessThan(l_shipdate" in plan
    whole = panels.ship_panel(spark, SF).filter(F.col("time_id").between(300, 420))
    assert panels.ship_panel(spark, SF, 300, 420).exceptAll(whole).count() == 0 and panels.ship_panel(spark, SF, 300, 420).count() == whole.count()


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b\nc", None)], "k int, text string, x double")
    tables.write_markdown(df, f"file://{tmp_path}/report", "Scores")
    assert "\n".join(r.value for r in spark.read.text(f"file://{tmp_path}/report").collect()) == "# Scores\n\n| k | text | x |\n| - | - | - |\n| 1 | a\\|b c |  |"
    with pytest.raises(Exception, match="exists"):
        tables.write_markdown(df, f"file://{tmp_path}/report", "Scores")
    tables.write_markdown(df, f"file://{tmp_path}/report", "Scores", overwrite=True)
    rows = spark.createDataFrame([(t, 1, 1, 1.0, 5.0, "extra") for t in range(40)], "time_id long, asset_id long, target int, weight double, f double, other string")
    rows.write.parquet(f"file://{tmp_path}/in")
    got = tables.load_sample(spark, [f"file://{tmp_path}/in"], ["f"], 4)
    assert got.columns == ["time_id", "asset_id", "target", "weight", "f"] and got.count() == 10 and dict(got.dtypes)["target"] == "double"
    with pytest.raises(ValueError, match="sampling"):
        tables.load_sample(spark, [f"file://{tmp_path}/in"], ["f"], 4, "other")


def test_ladders(spark):
    def rungs(*pairs):
        return spark.createDataFrame(pairs, "k int, gain double")

    got = infer.ladder(rungs((12, 0.02), (48, 0.06), (24, 0.04)), "k", anchor=(12, 0.02))
    assert tuple(got.first()) == (48, 0.06, True, True, False)
    assert tuple(infer.ladder(rungs((1, 0.06), (2, 0.05)), "k").first()) == (1, 0.06, True, False, True)
    assert tuple(infer.ladder(rungs((1, 0.01)), "k").first()) == (1, 0.01, False, False, False)
    with pytest.raises(ValueError, match="anchor"):
        infer.ladder(rungs((12, 0.02), (24, 0.04)), "k", anchor=(12, 0.03))
    with pytest.raises(ValueError, match="anchor"):
        infer.ladder(rungs((24, 0.04)), "k", anchor=(12, 0.03))
    with pytest.raises(ValueError, match="distinct"):
        infer.ladder(rungs((1, 0.1), (1, 0.2)), "k")


def test_penalties_picked_inside(spark):
    rng = np.random.default_rng(0)
    x, t = rng.normal(size=(300, 2)), np.repeat(np.arange(100), 3)
    y = x[:, 0] + rng.normal(size=300) * 3
    df = spark.createDataFrame([(int(a), *map(float, b), float(c)) for a, b, c in zip(t, x, y)], "time_id long, a double, b double, y double")
    best, scores, model = linear.pick_alpha(df, ["a", "b"], "y", None, [0.1, 30.0, 1e6])
    first, last = t < 80, t >= 80
    for alpha, score in scores.items():
        xc, m = x[first] - x[first].mean(0), y[first].mean()
        beta = np.linalg.solve(xc.T @ xc + alpha * np.eye(2), xc.T @ (y[first] - m))
        p = m + (x[last] - x[first].mean(0)) @ beta
        assert score == pytest.approx(1 - ((y[last] - p) ** 2).sum() / (y[last] ** 2).sum())
    assert best == max(scores, key=scores.get)
    whole = linear.ridge(linear.gram(df, ["a", "b"], ["y"]), best)
    assert np.allclose(model.weights, whole.weights)
    with pytest.raises(ValueError, match="too few"):
        linear.pick_alpha(df.filter("time_id = 1"), ["a"], "y", None, [1.0])


def test_smoothed_peaks():
    a, al, b, r, d = 3.0, 1.5, 2.0, 0.4, 10.0
    rho = linear.smoothing(al / a, r / b)
    best = linear.smoothing_peak(a, al, b, r, d, rho)
    assert all(best >= linear.smoothing_peak(a, al, b, r, d, x) for x in np.linspace(-2, 2, 41)) and linear.smoothing_peak(a, al, 0.0, 0.0, d, 0.0) is None


def test_selections_that_differ(spark):
    profile = spark.createDataFrame([("a", 1, 3), ("b", 2, 1), ("c", 3, 2)], "feature string, base_rank int, consistency_rank int")
    same = spark.createDataFrame([("b",), ("a",)], "feature string")
    assert metrics.same_selection(profile, same, 2) is profile
    with pytest.raises(ValueError, match="'b', 'c'"):
        metrics.same_selection(profile, spark.createDataFrame([("a",), ("c",)], "feature string"), 2)
    assert sorted(map(tuple, metrics.churn(profile, 2).collect())) == [("a", "out", 1, -1), ("c", "in", 3, 1)]


def test_deltas_and_pairs(spark):
    df = spark.createDataFrame([(t, k, float(t * t + k), t // 4) for t in range(10) for k in range(2) if t != 5], "time_id long, asset_id long, x double, part long")
    got = {(r.time_id, r.asset_id): r.d for r in df.withColumn("d", temporal.delta("x", 3)).collect()}
    times = [t for t in range(10) if t != 5]
    for i, t in enumerate(times):
        assert got[t, 1] == t * t + 1 - (times[i - 3] ** 2 + 1 if i >= 3 else 0)
    pairs = {(r.lag, r.time_id): (r.x, r.then_x) for r in temporal.step_pairs(df, ["x"], [1, -2], "part").filter("asset_id = 0").collect()}
    want = {(k, t): (float(t * t), float((t - k) ** 2)) for k in (1, -2) for t in times if t - k in times and t // 4 == (t - k) // 4}
    assert pairs == want and not math.isnan(sum(a for a, _ in pairs.values()))
