"""Queries of linear models, forests and networks, streams and windows of events."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.numeric import q
from ..operators import cross, linear, metrics, models, split, temporal
from ..sources import panels
from ..streaming import panel as streams
from .registry import query
from .sql import MOMENTS, PREDICTED, WITH, r

KEYS = ("time_id", "asset_id")
FEATURES = [f"feature_{k:03d}" for k in range(64)]


def _rows(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@query(f"""{WITH}, s AS (SELECT sum(weight) AS w, sum(weight * f0) AS x, sum(weight * f1) AS z, sum(weight * target) AS y, sum(weight * f0 * f0) AS xx, sum(weight * f0 * f1) AS xz, sum(weight * f1 * f1) AS zz, sum(weight * f0 * target) AS xy, sum(weight * f1 * target) AS zy FROM panel),
c AS (SELECT *, xx - x * x / w + 100 AS a, xz - x * z / w AS b, zz - z * z / w + 100 AS c, xy - x * y / w AS p, zy - z * y / w AS q FROM s),
k AS (SELECT *, (p * c - q * b) / (a * c - b * b) AS b0, (q * a - p * b) / (a * c - b * b) AS b1 FROM c)
SELECT {r('(y - b0 * x - b1 * z) / w')} AS intercept, {r('b0')} AS f0, {r('b1')} AS f1 FROM k""")
def linear_ridge(spark, sf_dir):
    m = linear.ridge(linear.gram(panels.ship_panel(spark, sf_dir), ["f0", "f1"], ["target"], "weight"), 100.0)
    return _rows(spark, [(float(m.intercept[0]), float(m.weights[0, 0]), float(m.weights[1, 0]))], "intercept double, f0 double, f1 double").select(*[q(F.col(c)).alias(c) for c in ("intercept", "f0", "f1")])


@query()
def linear_alpha_path(spark, sf_dir):
    g = linear.gram(panels.vector_panel(spark, sf_dir), FEATURES, ["target"], "weight")
    rows = [(a, *linear.residual_share(g, m)) for a, m in linear.alpha_path(g, [0.01, 0.1, 1.0], relative=True).items()]
    return _rows(spark, rows, "alpha double, r2 double, r2_zero double")


_SUMS2 = {"w": "weight", "x": "weight * f0", "z": "weight * f1", "y": "weight * target", "xx": "weight * f0 * f0", "xz": "weight * f0 * f1", "zz": "weight * f1 * f1", "xy": "weight * f0 * target", "zy": "weight * f1 * target"}


@query(f"""{WITH}, per AS (SELECT asset_id, {', '.join(f'sum({e}) AS {n}' for n, e in _SUMS2.items())} FROM panel GROUP BY asset_id), p AS (SELECT {', '.join(f'sum({n}) AS {n}' for n in _SUMS2)} FROM per),
s AS (SELECT asset_id, {', '.join(f'per.{n} + 0.5 * per.w / p.w * p.{n} AS {n}' for n in _SUMS2)} FROM per, p),
c AS (SELECT *, xx - x * x / w + 10 AS a, xz - x * z / w AS b, zz - z * z / w + 10 AS c, xy - x * y / w AS p, zy - z * y / w AS q FROM s),
k AS (SELECT *, (p * c - q * b) / (a * c - b * b) AS b0, (q * a - p * b) / (a * c - b * b) AS b1 FROM c)
SELECT asset_id, {r('(y - b0 * x - b1 * z) / w')} AS intercept, {r('b0')} AS f0, {r('b1')} AS f1 FROM k""")
def linear_per_asset(spark, sf_dir):
    per = linear.grams(panels.ship_panel(spark, sf_dir), ["f0", "f1"], ["target"], "weight", by="asset_id")
    fitted = linear.shrunk_ridge(per, 10.0, 0.5)
    out = _rows(spark, [(int(k), float(m.intercept[0]), *map(float, m.weights[:, 0])) for k, m in fitted.items()], "asset_id long, intercept double, f0 double, f1 double")
    return out.withColumns({c: q(F.col(c)) for c in ("intercept", "f0", "f1")})


@query(f"{WITH}, {PREDICTED} SELECT asset_id, {r('(sum(weight * prediction * target) + 1000) / (sum(weight * prediction * prediction) + 1000)')} AS slope FROM predicted GROUP BY asset_id")
def linear_slopes(spark, sf_dir):
    df = panels.ship_panel(spark, sf_dir).withColumn("prediction", temporal.mean_before("target", 5))
    return linear.slopes(df, ["asset_id"], "prediction", shrink=1000.0).withColumn("slope", q(F.col("slope")))


@query(f"""{WITH}, {PREDICTED}, s AS (SELECT sum(weight * target * target) AS d, sum(weight * target * prediction) AS v0, sum(weight * target * f1) AS v1, sum(weight * prediction * prediction) AS g00, sum(weight * prediction * f1) AS g01, sum(weight * f1 * f1) AS g11 FROM predicted),
c AS (SELECT *, (v0 * g11 - v1 * g01) / (g00 * g11 - g01 * g01) AS c0, (v1 * g00 - v0 * g01) / (g00 * g11 - g01 * g01) AS c1 FROM s)
SELECT {r('c0')} AS c0, {r('c1')} AS c1, {r('(c0 * v0 + c1 * v1) / d')} AS peak FROM c""")
def linear_best_blend(spark, sf_dir):
    df = panels.ship_panel(spark, sf_dir).withColumn("prediction", temporal.mean_before("target", 5))
    s = metrics.cube(df, ["prediction", "f1"], keys=()).first()
    c, peak = linear.best_blend(np.array([[s["g_0_0"], s["g_0_1"]], [s["g_0_1"], s["g_1_1"]]]), np.array([s["v_0"], s["v_1"]]))
    return _rows(spark, [(float(c[0]), float(c[1]), peak / s["d"])], "c0 double, c1 double, peak double").select(*[q(F.col(x)).alias(x) for x in ("c0", "c1", "peak")])


@query(f"""{WITH}, {PREDICTED}, s AS (SELECT time_id % 10 AS phase, {MOMENTS} FROM predicted GROUP BY 1), t AS (SELECT sum(v) AS v, sum(g) AS g FROM s)
SELECT phase, {r('(s.v + 0.5 * t.v) / (s.g + 0.5 * t.g)')} AS scale FROM s, t""")
def linear_phase_scales(spark, sf_dir):
    df = panels.ship_panel(spark, sf_dir).withColumn("prediction", temporal.mean_before("target", 5))
    totals = df.groupBy(F.pmod("time_id", F.lit(10)).alias("phase")).agg(*metrics.moments())
    return linear.shrunk_phase_scales(totals, 0.5).withColumn("scale", q(F.col("scale")))


@query()
def linear_lasso(spark, sf_dir):
    g = linear.gram(panels.vector_panel(spark, sf_dir), FEATURES, ["target"], "weight")
    w = linear.lasso(g, 8)
    return _rows(spark, [(f, float(v)) for f, v in zip(FEATURES, w) if v], "feature string, weight double")


@query()
def linear_principal_axes(spark, sf_dir):
    g = linear.gram(panels.vector_panel(spark, sf_dir), FEATURES, ["target"], "weight")
    values, vectors = linear.principal_axes(g, 3)
    return _rows(spark, [(k, float(v), [float(x) for x in vectors[:, k]]) for k, v in enumerate(values)], "axis int, variance double, direction array<double>")


@query()
def linear_feature_clusters(spark, sf_dir):
    g = linear.gram(panels.vector_panel(spark, sf_dir), FEATURES, ["target"])
    labels = linear.average_linkage(1 - np.abs(linear.correlation_matrix(g)), clusters=4)
    return _rows(spark, list(zip(FEATURES, labels)), "feature string, cluster int")


@query()
def linear_fourier(spark, sf_dir):
    df = panels.vector_panel(spark, sf_dir).withColumn("row", F.col("time_id") * 15 + F.col("asset_id"))
    width = linear.median_distance(df, FEATURES, "row")
    g = linear.fourier_gram(df, FEATURES, "target", 32, width, 5)
    return _rows(spark, [(width, *linear.residual_share(g, linear.ridge(g, 1.0)))], "bandwidth double, r2 double, r2_zero double")


_FOREST = """Tree=0
num_leaves=3
split_feature=0 1
threshold=10.5 3.5
decision_type=2 2
left_child=1 -1
right_child=-3 -2
leaf_value=0.25 -0.5 1.0

Tree=1
num_leaves=2
split_feature=2
threshold=0
decision_type=1
left_child=-1
right_child=-2
leaf_value=2.0 -2.0
cat_boundaries=0 1
cat_threshold=10
"""


@query(f"""{WITH} SELECT time_id, asset_id, (CASE WHEN f0 <= 10.5 THEN CASE WHEN f1 <= 3.5 THEN 0.25 ELSE -0.5 END ELSE 1.0 END + CASE WHEN asset_id IN (1, 3) THEN 2.0 ELSE -2.0 END)::DOUBLE AS prediction FROM panel""")
def model_forest(spark, sf_dir):
    forest = models.Forest(models.parse_forest(_FOREST))
    df = panels.ship_panel(spark, sf_dir).select(*KEYS, "f0", "f1")
    return models.apply_model(df.withColumn("asset", F.col("asset_id").cast("double")), forest, ["f0", "f1", "asset"]).select(*KEYS, "prediction")


@query(f"{WITH} SELECT time_id, asset_id, {r('greatest(0.5 * f0 - f1 + 1, 0) * 2 - greatest(f1 - 0.25 * f0, 0) + 0.125')} AS prediction FROM panel")
def model_network(spark, sf_dir):
    net = models.Network([(np.array([[0.5, -0.25], [-1.0, 1.0]]), np.array([1.0, 0.0])), (np.array([[2.0], [-1.0]]), np.array([0.125]))])
    return models.apply_model(panels.ship_panel(spark, sf_dir).select(*KEYS, "f0", "f1"), net.predict, ["f0", "f1"]).select(*KEYS, q(F.col("prediction")).alias("prediction"))


@query()
def model_boosted(spark, sf_dir):
    df = panels.vector_panel(spark, sf_dir)
    fitted = models.train_boosted(df, FEATURES, rounds=5, depth=3)
    return fitted.transform(df).select(*KEYS, "target", "weight", "prediction")


@query(f"""{WITH}, m AS (SELECT *, avg(f1) OVER (PARTITION BY time_id) AS m1, avg(f2) OVER (PARTITION BY time_id) AS m2 FROM panel)
SELECT time_id, asset_id, {r('least(greatest((0.75 * m1 + 0.25 * m2 + 0.5 * (f1 - m1) + 0.5 * (f2 - m2)) * 0.9, -15), 15)')} AS prediction, {r('(f1 + f2) / 2')} AS seeds FROM m""")
def model_hybrid(spark, sf_dir):
    df = panels.ship_panel(spark, sf_dir).withColumns({"m1": cross.mean_of_time("f1"), "m2": cross.mean_of_time("f2")})
    out = models.hybrid(F.col("m1"), F.col("m2"), F.col("f1") - F.col("m1"), F.col("f2") - F.col("m2"), 0.25, 0.5, 0.9, 15.0)
    return df.select(*KEYS, q(out).alias("prediction"), q(models.seed_mean([F.col("f1"), F.col("f2")])).alias("seeds"))


_PAIRS = [(1, 2), (0, 2), (0, 1)]  # what stays if feature 0, 1 or 2 is left out


def _left(k: str) -> str:
    """A sum of the first or second feature that stays, by which one is left out."""
    return "CASE least_of " + " ".join(f"WHEN {d} THEN {k.format(i=i, j=j)}" for d, (i, j) in enumerate(_PAIRS)) + " END"


@query(f"""{WITH}, t AS (SELECT time_id, row_number() OVER (ORDER BY time_id) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT time_id FROM panel)),
g AS (SELECT k AS fold, 830 + k * ((n - 830) // 3) AS first, CASE WHEN k = 2 THEN n - 1 ELSE 830 + (k + 1) * ((n - 830) // 3) - 1 END AS last FROM (SELECT unnest(range(3)) AS k), (SELECT max(n) AS n FROM t)),
p AS (SELECT panel.*, fold, CASE WHEN place BETWEEN first - 830 AND first - 31 THEN 'train' WHEN place BETWEEN first AND last THEN 'valid' END AS role FROM panel JOIN t USING (time_id), g),
s AS (SELECT fold, sum(weight) AS w, sum(weight * target) AS y, sum(weight * target * target) AS yy, {', '.join(f'sum(weight * f{i}) AS s{i}, sum(weight * f{i} * target) AS y{i}' for i in range(3))}, {', '.join(f'sum(weight * f{i} * f{j}) AS s{i}{j}' for i in range(3) for j in range(i, 3))} FROM p WHERE role = 'train' GROUP BY fold),
c AS (SELECT *, {', '.join(f'abs(w * y{i} - s{i} * y) / sqrt((w * s{i}{i} - s{i} * s{i}) * (w * yy - y * y)) AS c{i}' for i in range(3))} FROM s),
d AS (SELECT *, CASE WHEN c0 <= c1 AND c0 <= c2 THEN 0 WHEN c1 <= c2 THEN 1 ELSE 2 END AS least_of FROM c),
e AS (SELECT fold, least_of, w, y, {_left('s{i}')} AS x, {_left('s{j}')} AS z, {_left('s{i}{i}')} AS xx, {_left('s{i}{j}')} AS xz, {_left('s{j}{j}')} AS zz, {_left('y{i}')} AS xy, {_left('y{j}')} AS zy FROM d),
k AS (SELECT *, xx - x * x / w + 100 AS a, xz - x * z / w AS b, zz - z * z / w + 100 AS c, xy - x * y / w AS p, zy - z * y / w AS q FROM e),
m AS (SELECT fold, least_of, (p * c - q * b) / (a * c - b * b) AS b0, (q * a - p * b) / (a * c - b * b) AS b1, w, x, y, z FROM k),
v AS (SELECT p.fold, weight, target, (y - b0 * x - b1 * z) / w + b0 * CASE WHEN least_of = 0 THEN f1 ELSE f0 END + b1 * CASE WHEN least_of = 2 THEN f1 ELSE f2 END AS prediction FROM p JOIN m USING (fold) WHERE role = 'valid'),
o AS (SELECT fold, count(*) AS n, {MOMENTS} FROM v GROUP BY fold)
SELECT fold::INT AS fold, n, d, {r('v / d')} AS a, {r('g / d')} AS b, {r('v * v / (g * d)')} AS peak, {r('v / g')} AS best_scale, {r('(2 * v - g) / d')} AS score FROM o""")
def model_out_of_fold(spark, sf_dir):
    df = panels.ship_panel(spark, sf_dir)
    return metrics.score(models.out_of_fold(df, split.rolling_folds_of(df, 3, 800, 30), ["f0", "f1", "f2"], 2, 100.0), ["fold"]).withColumns({c: q(F.col(c)) for c in ("a", "b", "peak", "best_scale", "score")})


@query(f"""{WITH}, dev AS (SELECT time_id, asset_id, f0 - avg(f0) OVER (PARTITION BY time_id) AS dev FROM panel)
SELECT time_id, asset_id, {r('dev')} AS dev, {r('coalesce(lag(dev) OVER w, 0)')} AS lag1, {r('coalesce(avg(dev) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0)')} AS mean,
  {r('coalesce(avg(dev) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0)')} AS long_mean,
  {r('coalesce(avg(dev) OVER (w RANGE BETWEEN 10 PRECEDING AND 1 PRECEDING), CASE WHEN row_number() OVER w = 1 THEN dev ELSE 0 END)')} AS slow FROM dev WINDOW w AS (PARTITION BY asset_id ORDER BY time_id)""")
def stream_features_batch(spark, sf_dir):
    out = streams.batch_features(panels.ship_panel(spark, sf_dir), "f0")
    return out.select(*KEYS, *[q(F.col(c)).alias(c) for c in ("dev", "lag1", "mean", "long_mean", "slow")])


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, sum(floor(value)::BIGINT)::BIGINT AS total FROM events GROUP BY 1, 2")
def stream_event_windows(spark, sf_dir):
    return streams.event_windows(panels.table(spark, sf_dir, "events"))


@query("""WITH e AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes', true)::INT AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_user_sessions(spark, sf_dir):
    return streams.user_sessions(panels.table(spark, sf_dir, "events"))
