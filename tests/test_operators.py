import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import numeric
from lattica.operators import cross, infer, joins, linear, metrics, models, split, temporal
from lattica.sources import audit, tables
from lattica.streaming import panel as streams


@pytest.fixture(scope="module")
def toy(spark):
    """Six assets, 40 times with a gap, some rows missing; a NaN and an infinity."""
    rng = np.random.default_rng(3)
    rows = []
    for t in [*range(25), *range(32, 47)]:
        for a in range(6):
            if rng.random() < 0.85:
                rows.append((t, a, float(rng.normal()), float(rng.integers(0, 4)), float(rng.random())))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "time_id long, asset_id long, x double, tied double, weight double")


def test_hand_case(spark):
    df = spark.createDataFrame([(10, 0, 1.0), (12, 0, 3.0), (17, 0, 8.0)], "time_id long, asset_id long, v double")
    out = df.select("time_id", temporal.lag("v").alias("l1"), temporal.lag("v", 2).alias("l2"), temporal.difference("v").alias("d"), temporal.acceleration("v").alias("a"), temporal.gap().alias("g"), temporal.ema_before("v", 3).alias("e")).orderBy("time_id").collect()
    assert [r.l1 for r in out] == [0, 1, 3] and [r.l2 for r in out] == [0, 0, 1] and [r.d for r in out] == [1, 2, 5]
    assert [r.a for r in out] == [1, 1, 3] and [r.g for r in out] == [0, 2, 5]
    assert np.allclose([r.e for r in out], [0, 1, 7 / 3])


def test_slope_and_trailing_mean(spark):
    df = spark.createDataFrame([(t, 0, float(t + 1)) for t in range(6)], "time_id long, asset_id long, v double")
    assert [r.s for r in temporal.with_slope(df, "v", 5, "s").orderBy("time_id").collect()] == [0, 0, 1, 1, 1, 1]
    late = spark.createDataFrame([(0, 0, 5.0), (3, 0, 7.0), (50, 0, 1.0), (53, 0, 2.0)], "time_id long, asset_id long, v double")
    assert [r.m for r in late.select("time_id", temporal.mean_by_steps("v", 3).alias("m")).orderBy("time_id").collect()] == [5, 5, 0, 1]


def test_history_excludes_the_present(spark, toy):
    whole = {(r.time_id, r.asset_id): r.m for r in frame(spark, toy).select("time_id", "asset_id", temporal.mean_before("x", 5).alias("m")).collect()}
    early = {(r.time_id, r.asset_id): r.m for r in frame(spark, [r for r in toy if r[0] <= 20]).select("time_id", "asset_id", temporal.mean_before("x", 5).alias("m")).collect()}
    assert all(whole[k] == v for k, v in early.items())
    series: dict = {}
    for t, a, x, *_ in sorted(toy):
        past = series.setdefault(a, [])
        assert whole[t, a] == pytest.approx(np.mean(past[-5:]) if past else 0.0)
        past.append(x)


def test_time_slices_are_exact(spark, toy):
    from pyspark.sql import Window

    df = frame(spark, toy)
    w = Window.partitionBy("asset_id", "slice").orderBy("time_id")
    sliced = temporal.in_time_slices(df, 10, 4).withColumn("m", F.avg("x").over(w.rangeBetween(-4, -1))).filter("not warm_up")
    whole = df.withColumn("m", F.avg("x").over(Window.partitionBy("asset_id").orderBy("time_id").rangeBetween(-4, -1)))
    key = lambda d: {(r.time_id, r.asset_id): r.m for r in d.collect()}
    a, b = key(sliced), key(whole)
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) if b[k] is not None else a[k] is None for k in b)


def test_ranks_break_ties_by_asset(spark):
    df = spark.createDataFrame([(0, 2, 1.0), (0, 1, 1.0), (0, 0, float("nan")), (1, 0, 4.0)], "time_id long, asset_id long, x double")
    got = {(r.time_id, r.asset_id): r["rank"] for r in cross.symmetric_rank(df, "x").collect()}
    assert got == {(0, 1): -1.0, (0, 2): 0.0, (0, 0): 1.0, (1, 0): 0.0}


def test_missing_values(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (2.0,)], "x double")
    assert [r[0] for r in df.select(numeric.zero_if_missing(F.col("x"))).collect()] == [0, 0, 0, 2]
    with pytest.raises(Exception, match="not finite"):
        metrics.score(df.withColumns({"target": F.lit(1.0), "prediction": F.col("x"), "weight": F.lit(1.0)})).collect()


def test_score_is_best_at_best_scale(spark, toy):
    df = frame(spark, toy).withColumns({"target": F.col("x"), "prediction": F.col("x") * 0.3 + F.col("tied") * 0.1})
    s = metrics.score(df).first()
    assert s.score == pytest.approx(2 * s.a - s.b)
    scaled = metrics.score(df.withColumn("prediction", F.col("prediction") * s.best_scale)).first()
    assert scaled.score == pytest.approx(s.peak) and s.peak >= s.score
    nothing = metrics.score(df.withColumn("target", F.lit(0.0))).first()
    assert nothing.score == 0


def test_twice_at_one_time_is_an_error(spark):
    df = spark.createDataFrame([(0, 1, 1.0), (0, 1, 2.0)], "time_id long, asset_id long, x double")
    with pytest.raises(Exception, match="twice"):
        cross.asset_panel(df, "x", [0, 1]).collect()


def test_joins_state_what_must_hold(spark):
    left = spark.createDataFrame([(1,), (2,)], "k long")
    with pytest.raises(Exception, match="no partner"):
        joins.join_covered(left, spark.createDataFrame([(1, 5)], "k long, v long"), "k").collect()
    with pytest.raises(Exception, match="several"):
        joins.join_one_to_one(left, spark.createDataFrame([(1, 5), (1, 6)], "k long, v long"), "k").collect()


def test_folds():
    times = list(range(0, 2000, 2))
    folds = split.rolling_folds(times, 4, 300, 20)
    assert all(f.train_high < f.valid_low for f in folds) and folds[-1].valid_high == times[-1]
    assert [b.valid_low - a.valid_high for a, b in zip(folds, folds[1:])] == [2, 2, 2]
    moved = split.rolling_folds(times, 4, 300, 20, offset=5, reserved=10)
    assert moved[0].train_low == times[5]
    with pytest.raises(ValueError):
        split.rolling_folds(times[:300], 4, 300, 20)
    seal = split.sealed_period(888_480, 1_105_919, 60_000, 4, 30)
    assert seal.start == 1_045_920 and seal.cutoff == 1_045_889 and len(seal.blocks) == 4
    with pytest.raises(ValueError):
        split.sealed_period(0, 100, 50, 3, 1)
    assert split.partition_folds([2, 3], 2) == [([0, 1], 2), ([1, 2], 3)]
    with pytest.raises(ValueError):
        split.cut_training(folds[0], front=10**9)


def test_phase_balanced_sampling_keeps_every_phase(spark):
    got = split.sample_phase_balanced(spark.range(4000).withColumnRenamed("id", "time_id"), 5)
    counts = {r["p"]: r["count"] for r in got.groupBy(F.pmod("time_id", F.lit(10)).alias("p")).count().collect()}
    assert len(counts) == 10 and set(counts.values()) == {80}
    with pytest.raises(ValueError):
        split.sample_periodic(got, 0)
    assert split.sample_times(got, 7, 1).count() == 7
    assert split.evenly_spaced(got.withColumn("asset_id", F.lit(0)), 5).count() == 5


def test_ridge_against_numpy(spark, toy):
    df = frame(spark, toy)
    m = linear.ridge(linear.gram(df, ["tied", "weight"], ["x"]), 2.0)
    x = np.array([[r[3], r[4]] for r in toy])
    y = np.array([r[2] for r in toy])
    xc, yc = x - x.mean(axis=0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 2 * np.eye(2), xc.T @ yc)
    assert np.allclose(m.weights[:, 0], want) and np.allclose(m.intercept[0], y.mean() - x.mean(axis=0) @ want)


def test_small_algebra():
    assert linear.vertex(0, 3, 4, 2) == pytest.approx(2.0) and linear.vertex(0, 1, 4, 2) is None
    assert linear.blend_gain(1.0, 0.0) == pytest.approx(2**0.5 - 1)
    assert infer.sign_test(5, 0) == pytest.approx(0.0625) and infer.sign_test(0, 0) == 1
    assert infer.one_axis([{"a": 1, "b": 2}, {"a": 1, "b": 3}]) == "b"
    with pytest.raises(ValueError):
        infer.one_axis([{"a": 1, "b": 2}, {"a": 2, "b": 3}])
    assert infer.verdict([infer.Gate("x", 1.0, 0.5), infer.Gate("y", None, 0)]) == "PENDING"
    assert infer.verdict([infer.Gate("x", 0.1, 0.5), infer.Gate("y", None, 0)]) == "FAIL"
    assert linear.average_linkage(np.array([[0, 1, 9], [1, 0, 9], [9, 9, 0]], float), clusters=2) == [0, 0, 1]
    assert np.allclose(linear.two_basis(np.array([1.0, 2.0, 5.0, 7.0])), [1, 2, 4, 5])
    with pytest.raises(ValueError):
        models.Network([], hidden="tanh")
    assert numeric.feature_index(numeric.feature_names()[322]) == 322


def test_blocks_of_a_bootstrap(spark):
    cube = spark.createDataFrame([(t, float(t)) for t in range(20)], "time_id long, d double")
    got = infer.block_bootstrap(cube, ["d"], 20, 3, 1).collect()
    assert [r.d for r in got] == [190.0] * 3
    sums = {r.d for r in infer.block_bootstrap(cube, ["d"], 10, 50, 1).collect()}
    assert min(sums) >= 90 and max(sums) <= 290 and len(sums) > 5


def test_forest_prefixes_nest(spark):
    from lattica.plans.model_queries import _FOREST

    trees = models.parse_forest(_FOREST)
    x = np.array([[1.0, 2.0, 1.0], [20.0, 9.0, 2.0], [np.nan, 5.0, 3.0]])
    assert models.Forest(trees, 1)(x).tolist() == [0.25, 1.0, -0.5]
    assert models.Forest(trees)(x).tolist() == [2.25, -1.0, 1.5]


def test_oof_checks(spark):
    good = spark.createDataFrame([(10, 0, 1.0, 1.0, 0, 0.5), (10, 1, 1.0, 1.0, 0, 0.5), (11, 0, 1.0, 1.0, -1, None)], "time_id long, asset_id long, target double, weight double, fold int, prediction double")
    audit.check_oof(good)
    with pytest.raises(ValueError, match="several folds"):
        audit.check_oof(good.withColumn("fold", F.when(F.col("asset_id") == 1, 1).otherwise(F.col("fold"))))
    with pytest.raises(ValueError, match="missing"):
        audit.check_oof(good.drop("weight"))
    assert audit.backfill_verdict(good, ["prediction", "target"]) == "with"
    assert audit.backfill_verdict(good.withColumn("e", F.lit(None).cast("double")), ["e", "target"]) == "inconsistent"


def test_files(spark, toy, tmp_path):
    base = frame(spark, [r for r in toy if r[0] < 20])
    more = frame(spark, [r for r in toy if r[0] >= 20])
    assert tables.combine(base, more, "extended").count() == len(toy)
    assert tables.combine(base, more, "decision", 24).agg(F.max("time_id")).first()[0] == 24
    with pytest.raises(ValueError):
        tables.combine(base, more, "other")
    path = str(tmp_path / "cut")
    tables.truncated_copy(base, 9, path)
    assert tables.scan(spark, [path], ["time_id"]).agg(F.max("time_id")).first()[0] == 9
    assert tables.inspect_files(spark, path, True).agg(F.sum("rows")).first()[0] == base.filter("time_id <= 9").count()
    with pytest.raises(Exception):
        tables.truncated_copy(base, 9, path)
    kept = tables.cached_sample(base, str(tmp_path / "cache"), {"modulo": 3})
    assert kept.count() == base.count() == tables.cached_sample(more, str(tmp_path / "cache"), {"modulo": 3}).count()
    with pytest.raises(ValueError):
        tables.cached_sample(base, str(tmp_path / "cache"), {"modulo": 4})
    tables.write_predictions(base.select(F.col("time_id").alias("row_id"), F.col("x").alias("target")), str(tmp_path / "csv"), 6)
    assert tables.read_predictions(spark, str(tmp_path / "csv")).count() == base.count()
    (tmp_path / "root").mkdir()
    (tmp_path / "root" / "manifest.json").write_text('{"files": {"train": ["b.parquet", "a.parquet"]}}')
    assert [f.rsplit("/", 1)[1] for f in tables.manifest_files(spark, str(tmp_path / "root"))] == ["b.parquet", "a.parquet"]


def test_stream_equals_batch(spark, toy, tmp_path):
    source = str(tmp_path / "in")
    rows = frame(spark, toy).select("time_id", "asset_id", "x")
    for k, (low, high) in enumerate([(0, 14), (15, 30), (31, 60)]):
        rows.filter(F.col("time_id").between(low, high)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("time_id long, asset_id long, x double").option("maxFilesPerTrigger", 1).parquet(source)
    query = streams.online_features(stream, "x").writeStream.format("memory").queryName("online").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.time_id, r.asset_id): r for r in spark.table("online").collect()}
    want = {(r.time_id, r.asset_id): r for r in streams.batch_features(rows, "x").collect()}
    last = max(t for t, _ in want)
    assert set(got) == {k for k in want if k[0] < last}
    for k, r in got.items():
        for c in ("dev", "lag1", "mean", "long_mean", "slow"):
            assert r[c] == pytest.approx(want[k][c], abs=1e-12), (k, c)


def test_empty_panel(spark):
    empty = frame(spark, [])
    assert metrics.score(empty.withColumns({"target": F.col("x"), "prediction": F.col("x")})).first().n == 0
    assert temporal.temporal_features(empty, ["x"], "t3_full").count() == 0
    with pytest.raises(ValueError):
        temporal.temporal_features(empty, ["x"], "nothing")


def test_errors_of_designs_and_blocks(spark):
    import pytest

    from lattica.functions.numeric import pack_key
    from lattica.operators import design, joins, metrics

    df = spark.createDataFrame([(1, 0, 2.0, 1.0, 1.0), (2, 0, 3.0, 1.0, 2.0)], "time_id long, asset_id long, target double, weight double, prediction double")
    with pytest.raises(ValueError):
        design.cross_design(df, ["target"], ["weight"])
    with pytest.raises(ValueError):
        design.two_bases(["target"], "other")
    for bad in (metrics.block_scores(df, [("none", 9, 10)]), metrics.without_clip_hits(df, "prediction", 2.0), joins.with_subset_check(df.select("time_id"), df.filter("time_id = 1"), "time_id"), df.select(pack_key(F.col("time_id"), F.lit(256)).alias("k"))):
        with pytest.raises(Exception, match="block none|at the clip|wide selection|0 to 255"):
            bad.collect()


def test_state_of_fewer_rows_than_asked_for(spark):
    from lattica.operators import design

    df = spark.createDataFrame([(1, 0, 2.0), (2, 0, 3.0), (1, 1, 5.0)], "time_id long, asset_id long, x double")
    state = {r.asset_id: [tuple(s) for s in r.state] for r in design.saved_state(df, ["x"], 5).collect()}
    assert state == {0: [(1, 2.0), (2, 3.0)], 1: [(1, 5.0)]}
    assert design.saved_state(df.filter("false"), ["x"], 5).count() == 0
