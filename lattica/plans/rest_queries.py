"""Queries of sources and sinks, selections, ladders and small models, each over whole given tables."""

from __future__ import annotations

import json
import math

from pyspark.sql import functions as F

from ..functions.numeric import columns_with_prefix, feature_index, feature_names, q
from ..operators import cross, design, infer, linear, metrics, models, split, temporal
from ..sources import audit, footers, panels, tables
from .registry import query
from .sql import ASSET, MOMENTS, PREDICTED, WITH, over, r

KEYS = ("time_id", "asset_id")


def _q(df, *columns):
    return df.withColumns({c: q(F.col(c)) for c in columns})


def _parts(spark, sf_dir, name):
    """The panel in three files of time, with a manifest that lists two of them for training."""
    root = tables.scratch(spark, name)
    df = panels.ship_panel(spark, sf_dir).withColumn("row_id", F.col("time_id") * 100 + F.col("asset_id"))
    for k, (low, high) in enumerate(((-10_000, 800), (801, 1600), (1601, 10_000))):
        df.filter(F.col("time_id").between(low, high)).coalesce(1).write.parquet(f"{root}/train/p{k}.parquet")
    spark.createDataFrame([(json.dumps({"files": {"train": ["train/p2.parquet", "train/p0.parquet"]}}),)], "value string").coalesce(1).write.text(f"{root}/manifest.json")
    return root, df


# --- sources and sinks


@query(f"{WITH} SELECT time_id, asset_id, f0 FROM panel WHERE (time_id <= 800 OR time_id > 1600) AND time_id BETWEEN 100 AND 2000")
def scan_manifest(spark, sf_dir):
    root, _ = _parts(spark, sf_dir, "manifest")
    return tables.scan(spark, tables.manifest_files(spark, root), [*KEYS, "f0"], 100, 2000)


@query(f"{WITH} SELECT time_id, asset_id, target, weight, f1 FROM panel WHERE (floor(time_id / 10.0)::BIGINT + time_id % 10) % 4 = 0")
def scan_loaded_sample(spark, sf_dir):
    root, _ = _parts(spark, sf_dir, "loaded")
    return tables.load_sample(spark, [f"{root}/train/*"], ["f1"], 4, "phase")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 7 IN (2, 5)")
def sample_row_ids(spark, sf_dir):
    return split.sample_residues(panels.table(spark, sf_dir, "orders"), 7, [2, 5], "o_orderkey").select("o_orderkey", "o_custkey")


@query(f"{WITH} SELECT time_id, asset_id, target FROM panel WHERE time_id <= 1000")
def sink_truncated_copy(spark, sf_dir):
    path = tables.scratch(spark, "truncated")
    tables.truncated_copy(panels.ship_panel(spark, sf_dir).select(*KEYS, "target"), 1000, path)
    return spark.read.parquet(path)


@query(f"""{WITH}, b AS (SELECT * FROM panel WHERE time_id <= 1200), l AS (SELECT * FROM panel WHERE time_id > 1200)
SELECT 'original' AS role, count(*) AS rows, max(time_id) AS last FROM b UNION ALL SELECT 'extended', count(*), max(time_id) FROM panel UNION ALL SELECT 'decision', count(*), max(time_id) FROM panel WHERE time_id <= 1500""")
def source_roles(spark, sf_dir):
    df = panels.ship_panel(spark, sf_dir)
    base, late = df.filter("time_id <= 1200"), df.filter("time_id > 1200")
    out = [tables.combine(base, late, role, cutoff).agg(F.lit(role).alias("role"), F.count("*").alias("rows"), F.max("time_id").alias("last")) for role, cutoff in (("original", None), ("extended", None), ("decision", 1500))]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"{WITH} SELECT time_id * 100 + asset_id AS row_id, round(target / 7, 10) AS target FROM panel")
def sink_predictions(spark, sf_dir):
    path = tables.scratch(spark, "predictions")
    tables.write_predictions(panels.ship_panel(spark, sf_dir).select((F.col("time_id") * 100 + F.col("asset_id")).alias("row_id"), (F.col("target") / 7).alias("target")), path)
    return tables.read_predictions(spark, path)


@query(f"{WITH} SELECT time_id, asset_id, f0 FROM panel WHERE time_id % 6 = 0")
def source_cached_sample(spark, sf_dir):
    path = tables.scratch(spark, "cached")
    df = split.sample_periodic(panels.ship_panel(spark, sf_dir).select(*KEYS, "f0"), 6)
    tables.cached_sample(df, path, {"modulo": 6})
    return tables.cached_sample(df.limit(0), path, {"modulo": 6})  # the second call reads what the first has written


@query("SELECT vec_id // 15 AS time_id, vec_id % 15 AS asset_id, round(list_sum(embedding[1:64]::DOUBLE[]), 6) AS total, 63 AS last FROM embeddings")
def design_feature_columns(spark, sf_dir):
    df = panels.vector_panel(spark, sf_dir)
    found = columns_with_prefix(df.columns, "feature_")
    assert found == feature_names(len(found))
    return df.select(*KEYS, q(sum((F.col(c) for c in found), F.lit(0.0))).alias("total"), F.lit(max(map(feature_index, found))).alias("last"))


# --- folds


@query(f"""{WITH}, p AS (SELECT floor(time_id / 500.0)::INT AS part FROM panel), f(fold, valid) AS (VALUES (0, 2), (1, 3), (2, 4))
SELECT fold, CASE WHEN part = valid THEN 'valid' ELSE 'train' END AS role, count(*) AS rows FROM p, f WHERE part BETWEEN valid - 2 AND valid GROUP BY ALL""")
def fold_partitions(spark, sf_dir):
    part = F.floor(F.col("time_id") / 500).cast("int").alias("part")
    folds = [(k, p, role) for k, (train, valid) in enumerate(split.partition_folds([2, 3, 4], 2)) for p, role in [*((t, "train") for t in train), (valid, "valid")]]
    table = spark.createDataFrame(folds, "fold int, part int, role string")
    return panels.ship_panel(spark, sf_dir).select(part).join(F.broadcast(table), "part").groupBy("fold", "role").agg(F.count("*").alias("rows"))


@query(f"""{WITH}, p AS (SELECT CASE WHEN time_id BETWEEN 2100 AND 2499 THEN 'block ' || ((time_id - 2100) // 100) WHEN time_id BETWEEN 1570 AND 2069 THEN 'train' WHEN time_id <= 2069 THEN 'before' ELSE 'embargo' END AS part FROM panel)
SELECT part, count(*) AS rows FROM p GROUP BY part""")
def fold_sealed_period(spark, sf_dir):
    """The last 400 times in 4 sealed blocks, an embargo of 30 times before them, and a training window of 500 times before that."""
    seal = split.sealed_period(1, 2499, 400, 4, 30)
    window = split.cut_training(split.Fold(0, 1, seal.cutoff, seal.start, 2499), most=500)
    t = F.col("time_id")
    part = F.when(t > seal.cutoff, "embargo").when(t.between(window.train_low, window.train_high), "train").otherwise("before")
    for k, (low, high) in enumerate(seal.blocks):
        part = F.when(t.between(low, high), f"block {k}").otherwise(part)
    return panels.ship_panel(spark, sf_dir).groupBy(part.alias("part")).agg(F.count("*").alias("rows"))


# --- time


@query(f"""{WITH}, p AS (SELECT *, time_id // 300 AS part FROM panel), k AS (SELECT unnest([1, 7, -3])::INT AS lag)
SELECT k.lag, a.asset_id, a.time_id, a.f0, a.part, b.f0 AS then_f0 FROM p a CROSS JOIN k JOIN p b ON b.asset_id = a.asset_id AND b.part = a.part AND b.time_id = a.time_id - k.lag""")
def temporal_step_pairs(spark, sf_dir):
    df = panels.ship_panel(spark, sf_dir).withColumn("part", F.floor(F.col("time_id") / 300))
    return temporal.step_pairs(df, ["f0"], [1, 7, -3], "part")


@query(f"""{WITH}, k AS (SELECT unnest([1, 5])::INT AS lag)
SELECT k.lag, a.asset_id, count(*) AS pairs, {r('sum(a.weight * b.f0 * a.f0) / sqrt(sum(a.weight * b.f0 * b.f0) * sum(a.weight * a.f0 * a.f0))')} AS correlation FROM panel a CROSS JOIN k JOIN panel b ON b.asset_id = a.asset_id AND b.time_id = a.time_id - k.lag GROUP BY k.lag, a.asset_id""")
def temporal_autocorrelation_by_asset(spark, sf_dir):
    return _q(temporal.autocorrelation(panels.ship_panel(spark, sf_dir), "f0", [1, 5], by="asset_id", weight="weight"), "correlation")


@query(f"""{WITH}, v AS (SELECT *, least(greatest((least(greatest(f0, 20.0), 400.0) - 150) / 70, -10), 10) AS x FROM panel),
n AS (SELECT *, row_number() OVER ({ASSET}) AS k, coalesce(avg(x) OVER w5, 0) AS m, coalesce(stddev_pop(x) OVER w5, 0) AS s FROM v WINDOW w5 AS ({ASSET} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, CASE WHEN count(x) OVER ({ASSET} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) >= 2 THEN regr_slope(x, k) OVER ({ASSET} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) ELSE 0 END AS slope5, list(x) OVER ({ASSET} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS past FROM n)
SELECT time_id, asset_id, {r('(x - m) / greatest(s, 1e-3) / sqrt(2)', 3)} AS zscore5, {r('slope5', 5)} AS slope5,
  {r('coalesce(list_sum(list_transform(past, lambda v, i: v * power(0.5, len(past) - i))) / list_sum(list_transform(past, lambda v, i: power(0.5, len(past) - i))), 0)', 5)} AS ema3 FROM l""")
def design_shapes_from_lags(spark, sf_dir):
    """z-scores are divided by the root of 2, so that none lies just between two rounded values."""
    df = panels.ship_panel(spark, sf_dir).withColumn("past", temporal.lag_cache("f0", 20))
    fitted = [F.lit(float(v)) for v in (20, 400, 150, 70)]
    atoms = design.atoms_from_lags(design.robust(F.col("f0"), *fitted), F.col("past"), *fitted)
    return df.select(*KEYS, q(atoms["zscore5"] / math.sqrt(2), 3).alias("zscore5"), q(atoms["slope5"], 5).alias("slope5"), q(atoms["ema3"], 5).alias("ema3"))


@query(f"""{WITH}, s AS (SELECT time_id, {', '.join(f'coalesce(max(target) FILTER (asset_id = {a}), 0) AS a{a}' for a in (0, 7))} FROM panel GROUP BY time_id)
SELECT time_id, a0, a7, coalesce(lag(a0) OVER w, 0) AS lag0, coalesce(lag(a7) OVER w, 0) AS lag7, a0 - coalesce(lag(a0) OVER w, 0) AS delta0, a7 - coalesce(lag(a7) OVER w, 0) AS delta7 FROM s WINDOW w AS (ORDER BY time_id)""")
def cross_asset_changes(spark, sf_dir):
    return cross.asset_panel(panels.ship_panel(spark, sf_dir), "target", [0, 7], dynamics=True).drop("has0", "has7")


@query(f"""{WITH}, s AS (SELECT time_id, avg(target) AS m FROM panel WHERE time_id % 9 <> 4 GROUP BY time_id)
SELECT time_id, {r('m')} AS mean, {r('abs(m - coalesce(lag(m) OVER w, 0))')} AS abs_delta, least(coalesce(time_id - lag(time_id) OVER w, 0), 1) AS gap FROM s WINDOW w AS (ORDER BY time_id)""")
def cross_market_gaps(spark, sf_dir):
    df = panels.ship_panel(spark, sf_dir).filter("time_id % 9 <> 4")
    return _q(cross.market_summary(df, "target", dynamics=True, most_gap=1), "mean", "abs_delta").select("time_id", "mean", "abs_delta", "gap")


# --- inference


_EIGHTHS = f"{WITH}, {PREDICTED}, b AS (SELECT time_id // 313 AS block, sum(weight * target * prediction) ** 2 / (sum(weight * prediction ** 2) * sum(weight * target ** 2)) AS arm, sum(weight * target * f1) ** 2 / (sum(weight * f1 ** 2) * sum(weight * target ** 2)) AS base FROM predicted GROUP BY 1)"


def _eighths(spark, sf_dir):
    df = panels.ship_panel(spark, sf_dir).withColumn("prediction", temporal.mean_before("target", 5))

    def peak(p):
        return F.sum(F.col("weight") * F.col("target") * F.col(p)) ** 2 / (F.sum(F.col("weight") * F.col(p) ** 2) * F.sum(F.col("weight") * F.col("target") ** 2))

    return df.groupBy(F.floor(F.col("time_id") / 313).alias("block")).agg(peak("prediction").alias("arm"), peak("f1").alias("base"))


@query(f"""{_EIGHTHS}, c AS (SELECT count(*) FILTER (arm > base) AS p, count(*) FILTER (arm < base) AS n FROM b)
SELECT p AS positive, n AS negative, {r('least(1.0, 2 * (SELECT sum(factorial((p + n)::INT) / (factorial(k::INT) * factorial((p + n - k)::INT))) FROM (SELECT unnest(range(greatest(p, n), p + n + 1)) AS k)) / power(2, p + n))')} AS tail FROM c""")
def infer_sign_test(spark, sf_dir):
    c = _eighths(spark, sf_dir).agg(F.count_if(F.col("arm") > F.col("base")).alias("p"), F.count_if(F.col("arm") < F.col("base")).alias("n")).first()
    return _q(spark.createDataFrame([(c["p"], c["n"], infer.sign_test(c["p"], c["n"]))], "positive long, negative long, tail double"), "tail")


@query(f"""{_EIGHTHS}, d AS (SELECT arm - base AS gain FROM b), i AS (SELECT quantile_cont(gain, 0.025) AS low, quantile_cont(gain, 0.975) AS high FROM d) SELECT {r('low')} AS low, {r('high')} AS high, {r('abs(high - low) / 2')} AS floor FROM i""")
def infer_detection_floor(spark, sf_dir):
    """Half the width of the range of the gains of blocks of time."""
    gain = F.col("arm") - F.col("base")
    i = _eighths(spark, sf_dir).agg(F.percentile(gain, F.lit(0.025)).alias("low"), F.percentile(gain, F.lit(0.975)).alias("high")).first()
    return _q(spark.createDataFrame([(i["low"], i["high"], infer.detection_floor(i["low"], i["high"]))], "low double, high double, floor double"), "low", "high", "floor")


@query(f"{WITH}, {PREDICTED}, s AS (SELECT {MOMENTS} FROM predicted) SELECT true AS agrees, {r('(2 * v - g) / d')} AS score FROM s")
def infer_moment_check(spark, sf_dir):
    df = panels.ship_panel(spark, sf_dir).withColumn("prediction", temporal.mean_before("target", 5))
    direct = metrics.score(df, [])
    agrees = infer.moment_check(metrics.cube(df, ["prediction"]), direct)
    return direct.select(F.lit(agrees).alias("agrees"), q(F.col("score")).alias("score"))


@query(f"""{WITH}, """ + ", ".join(f"p{n} AS (SELECT {n} AS rows, weight, target, coalesce({over('avg(target)', -n, -1)}, 0) AS prediction FROM panel)" for n in (1, 2, 4, 8, 16)) + f""",
u AS ({' UNION ALL '.join(f'SELECT * FROM p{n}' for n in (1, 2, 4, 8, 16))}), s AS (SELECT rows, {MOMENTS} FROM u GROUP BY rows), k AS (SELECT rows, v * v / (g * d) AS peak FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY rows) AS i, row_number() OVER (ORDER BY peak DESC, rows) AS j FROM k)
SELECT (SELECT rows::DOUBLE FROM o WHERE j = 1) AS best, {r('(SELECT peak FROM o WHERE j = 1)')} AS best_value, (SELECT peak >= 0.05 FROM o WHERE j = 1) AS passes, (SELECT (SELECT peak FROM o WHERE i = 5) / peak - 1 >= 0.2 FROM o WHERE i = 4) AS climbing, (SELECT peak < (SELECT peak FROM o WHERE j = 1) FROM o WHERE i = 5) AS turned""")
def infer_ladder(spark, sf_dir):
    """A ladder of windows of 1 to 16 rows behind the prediction; its first rung is the anchor, worked out once more from the rows."""
    df = panels.ship_panel(spark, sf_dir)
    widths = (1, 2, 4, 8, 16)
    infer.one_axis([{"rows": n, "target": "target"} for n in widths])
    wide = df.select("weight", "target", *[temporal.mean_before("target", n).alias(f"p{n}") for n in widths])
    w, y = F.col("weight"), F.col("target")
    peaks = wide.agg(*[(F.sum(w * y * F.col(f"p{n}")) ** 2 / (F.sum(w * F.col(f"p{n}") ** 2) * F.sum(w * y * y))).alias(f"p{n}") for n in widths]).first()
    again = metrics.score(df.withColumn("prediction", temporal.mean_before("target", 1)), []).first()["peak"]
    rungs = spark.createDataFrame([(n, peaks[f"p{n}"]) for n in widths], "rows int, gain double")
    return _q(infer.ladder(rungs, "rows", anchor=(1, again)), "best_value")


# --- linear models


@query(f"""{WITH}, s AS (SELECT sum(weight) AS w, sum(weight * f0) AS x, sum(weight * f1) AS z, sum(weight * f0 * f0) AS xx, sum(weight * f0 * f1) AS xz, sum(weight * f1 * f1) AS zz, sum(weight * target) AS y1, sum(weight * f0 * target) AS xy1, sum(weight * f1 * target) AS zy1, sum(weight * f2) AS y2, sum(weight * f0 * f2) AS xy2, sum(weight * f1 * f2) AS zy2 FROM panel),
c AS (SELECT w, x, z, xx - x * x / w + 100 AS a, xz - x * z / w AS b, zz - z * z / w + 100 AS c, unnest(['target', 'f2']) AS name, unnest([y1, y2]) AS y, unnest([xy1 - x * y1 / w, xy2 - x * y2 / w]) AS p, unnest([zy1 - z * y1 / w, zy2 - z * y2 / w]) AS q FROM s),
k AS (SELECT *, (p * c - q * b) / (a * c - b * b) AS b0, (q * a - p * b) / (a * c - b * b) AS b1 FROM c)
SELECT name AS target, {r('(y - b0 * x - b1 * z) / w')} AS intercept, {r('b0')} AS f0, {r('b1')} AS f1 FROM k""")
def linear_two_targets(spark, sf_dir):
    m = linear.ridge(linear.gram(panels.ship_panel(spark, sf_dir), ["f0", "f1"], ["target", "f2"], "weight"), 100.0)
    rows = [(t, float(m.intercept[k]), float(m.weights[0, k]), float(m.weights[1, k])) for k, t in enumerate(("target", "f2"))]
    return _q(spark.createDataFrame(rows, "target string, intercept double, f0 double, f1 double"), "intercept", "f0", "f1")


_ONE = "sum(weight) AS w, sum(weight * f1) AS x, sum(weight * target) AS y, sum(weight * f1 * f1) AS xx, sum(weight * f1 * target) AS xy, sum(weight * target * target) AS yy"


@query(f"""{WITH}, t AS (SELECT time_id, row_number() OVER (ORDER BY time_id) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT time_id FROM panel)), e AS (SELECT max(time_id) AS e FROM t WHERE k <= floor(n * 0.8)),
a AS (SELECT {_ONE} FROM panel, e WHERE time_id <= e), b AS (SELECT {_ONE} FROM panel, e WHERE time_id > e), c AS (SELECT {_ONE} FROM panel), p AS (SELECT unnest([1.0, 10000.0, 100000000.0]) AS alpha),
m AS (SELECT alpha, (a.xy - a.x * a.y / a.w) / (a.xx - a.x * a.x / a.w + alpha) AS slope, a.x / a.w AS mx, a.y / a.w AS my FROM a, p),
s AS (SELECT alpha, slope, my - slope * mx AS i, 1 - (b.yy - 2 * ((my - slope * mx) * b.y + slope * b.xy) + (my - slope * mx) ** 2 * b.w + 2 * (my - slope * mx) * slope * b.x + slope * slope * b.xx) / b.yy AS score FROM m, b)
SELECT alpha, {r('score')} AS score, alpha = (SELECT alpha FROM s ORDER BY score DESC, alpha DESC LIMIT 1) AS chosen, {r('(SELECT (c.xy - c.x * c.y / c.w) / (c.xx - c.x * c.x / c.w + (SELECT alpha FROM s ORDER BY score DESC, alpha DESC LIMIT 1)) FROM c)')} AS slope FROM s""")
def linear_picked_alpha(spark, sf_dir):
    best, scores, m = linear.pick_alpha(panels.ship_panel(spark, sf_dir), ["f1"], "target", "weight", [1.0, 1e4, 1e8])
    return _q(spark.createDataFrame([(a, s, a == best, float(m.weights[0, 0])) for a, s in scores.items()], "alpha double, score double, chosen boolean, slope double"), "score", "slope")


@query(f"""{WITH}, per AS (SELECT asset_id, sum(weight) AS w, sum(weight * f1) AS x, sum(weight * target) AS y, sum(weight * f1 * f1) AS xx, sum(weight * f1 * target) AS xy FROM panel GROUP BY asset_id), p AS (SELECT sum(w) AS w, sum(x) AS x, sum(y) AS y, sum(xx) AS xx, sum(xy) AS xy FROM per),
s AS (SELECT asset_id, per.w + 0.5 * per.w / p.w * p.w AS w, per.x + 0.5 * per.w / p.w * p.x AS x, per.y + 0.5 * per.w / p.w * p.y AS y, per.xx + 0.5 * per.w / p.w * p.xx AS xx, per.xy + 0.5 * per.w / p.w * p.xy AS xy FROM per, p),
b AS (SELECT *, (xy - x * y / w) / (xx - x * x / w + 10) AS slope FROM s) SELECT asset_id, {r('y / w - slope * x / w')} AS intercept, {r('slope')} AS slope FROM b""")
def linear_shrunk_per_asset(spark, sf_dir):
    per = linear.grams(panels.ship_panel(spark, sf_dir), ["f1"], ["target"], "weight", by="asset_id")
    rows = [(int(k), float(m.intercept[0]), float(m.weights[0, 0])) for k, m in linear.shrunk_ridge(per, 10.0, 0.5).items()]
    return _q(spark.createDataFrame(rows, "asset_id long, intercept double, slope double"), "intercept", "slope")


@query(f"""{WITH}, {PREDICTED}, o AS (SELECT *, lag(prediction) OVER ({ASSET}) AS p1, time_id - lag(time_id) OVER ({ASSET}) AS step FROM predicted),
m AS (SELECT sum(weight * target * prediction) AS a, sum(weight * target * p1) AS al, sum(weight * prediction * prediction) AS b, sum(weight * prediction * p1) AS rr, sum(weight * target * target) AS d, sum(weight * f1 * prediction) / sqrt(sum(weight * f1 * f1) * sum(weight * prediction * prediction)) AS rho, sqrt(sum(weight * target * f1) ** 2 / sum(weight * f1 * f1)) / sqrt(sum(weight * target * prediction) ** 2 / sum(weight * prediction * prediction)) AS ratio FROM o WHERE step = 1),
s AS (SELECT *, (al / a - rr / b) / (1 - al / a * rr / b) AS best FROM m)
SELECT {r('best')} AS rho, {r('a * a / (d * b)')} AS before, {r('(a + best * al) ** 2 / (d * (b * (1 + best * best) + 2 * best * rr))')} AS after, {r('a / b')} AS vertex, {r('sqrt((1 + ratio * ratio - 2 * rho * ratio) / (1 - rho * rho)) - 1')} AS blend FROM s""")
def linear_smoothing(spark, sf_dir):
    """The best share of the previous prediction and the peak it reaches; where the parabola of scores by scale peaks; and what a blend with f1 gains."""
    from pyspark.sql import Window

    by = Window.partitionBy("asset_id").orderBy("time_id")
    df = panels.ship_panel(spark, sf_dir).withColumn("prediction", temporal.mean_before("target", 5))
    df = df.withColumns({"p1": F.lag("prediction").over(by), "step": F.col("time_id") - F.lag("time_id").over(by)}).filter("step = 1")
    w, y, p, p1, f = (F.col(c) for c in ("weight", "target", "prediction", "p1", "f1"))
    m = df.agg(*[F.sum(w * x).alias(n) for n, x in {"a": y * p, "al": y * p1, "b": p * p, "r": p * p1, "d": y * y, "yf": y * f, "ff": f * f, "fp": f * p}.items()]).first()
    rho = linear.smoothing(m["al"] / m["a"], m["r"] / m["b"])
    peaks = [linear.smoothing_peak(m["a"], m["al"], m["b"], m["r"], m["d"], x) for x in (0.0, rho)]
    vertex = linear.vertex(*[(2 * t * m["a"] - t * t * m["b"]) / m["d"] for t in (0, 1, 3)], 3.0)
    ratio = (m["yf"] ** 2 / m["ff"]) ** 0.5 / (m["a"] ** 2 / m["b"]) ** 0.5
    blend = linear.blend_gain(ratio, m["fp"] / (m["ff"] * m["b"]) ** 0.5)
    return _q(spark.createDataFrame([(rho, *peaks, vertex, blend)], "rho double, before double, after double, vertex double, blend double"), "rho", "before", "after", "vertex", "blend")


@query(f"""{WITH}, c AS (SELECT corr(f0, f1) AS c01, corr(f0, f2) AS c02, corr(f1, f2) AS c12 FROM panel), d AS (SELECT 1 - abs(c01) AS d01, 1 - abs(c02) AS d02, 1 - abs(c12) AS d12 FROM c),
e AS (SELECT CASE WHEN d01 <= d02 AND d01 <= d12 THEN ['f0', 'f1'] WHEN d02 <= d12 THEN ['f0', 'f2'] ELSE ['f1', 'f2'] END AS pair FROM d) SELECT feature, list_contains(pair, feature) AS together FROM e, (SELECT unnest(['f0', 'f1', 'f2']) AS feature)""")
def linear_feature_pair(spark, sf_dir):
    """Three features in two clusters: which two are together."""
    import numpy as np

    g = linear.gram(panels.ship_panel(spark, sf_dir), ["f0", "f1", "f2"], ["target"])
    labels = linear.average_linkage(1 - np.abs(linear.correlation_matrix(g)), clusters=2)
    return spark.createDataFrame([(f, sum(x == k for x in labels) == 2) for f, k in zip(("f0", "f1", "f2"), labels)], "feature string, together boolean")


# --- models and audits


_NESTED = """Tree=0
num_leaves=2
split_feature=0
threshold=20.5
decision_type=2
left_child=-1
right_child=-2
leaf_value=1.0 3.0

Tree=1
num_leaves=2
split_feature=1
threshold=10.5
decision_type=2
left_child=-1
right_child=-2
leaf_value=-0.5 0.25
"""


@query(f"""{WITH}, p AS (SELECT weight, target, CASE WHEN f1 <= 20.5 THEN 1.0 ELSE 3.0 END AS one, CASE WHEN f2 <= 10.5 THEN -0.5 ELSE 0.25 END AS two FROM panel),
u AS (SELECT 1 AS rounds, weight, target, one::DOUBLE AS prediction FROM p UNION ALL SELECT 2, weight, target, (one + two)::DOUBLE FROM p), s AS (SELECT rounds, {MOMENTS} FROM u GROUP BY rounds) SELECT rounds, {r('(2 * v - g) / d')} AS score FROM s""")
def model_nested_rounds(spark, sf_dir):
    """Scores of one forest after its first tree and after both."""
    df = panels.ship_panel(spark, sf_dir).select(*KEYS, "weight", "target", "f1", "f2")
    trees = models.parse_forest(_NESTED)
    out = None
    for k in (1, 2):
        one = metrics.score(models.apply_model(df, models.Forest(trees, k), ["f1", "f2"]), []).select(F.lit(k).alias("rounds"), q(F.col("score")).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"{WITH} SELECT count(*) AS rows, count(*) FILTER (time_id > 1200) AS validated FROM panel")
def audit_out_of_fold(spark, sf_dir):
    df = panels.ship_panel(spark, sf_dir).withColumn("prediction", temporal.mean_before("target", 5)).withColumn("fold", F.when(F.col("time_id") > 1200, F.floor(F.col("time_id") / 700)).otherwise(-1))
    audit.check_oof(df)
    return df.agg(F.count("*").alias("rows"), F.count_if(F.col("fold") >= 0).alias("validated"))


@query(f"""{WITH}, c AS (SELECT count(*) FILTER (f1 > 40) AS a1, count(*) FILTER (f1 > 20) AS a2, count(*) FILTER (f2 > 30) AS b1, count(*) FILTER (f0 > 1e9) AS d1 FROM panel),
g AS (SELECT CASE WHEN a2 > a1 AND a1 > 0 THEN a1 || ',' || a2 WHEN a2 > 0 THEN a2::VARCHAR ELSE '' END AS two, CASE WHEN b1 > 0 THEN b1::VARCHAR ELSE '' END AS one, CASE WHEN d1 > 0 THEN d1::VARCHAR ELSE '' END AS none FROM c),
f AS (SELECT 'a' AS family, two AS rungs FROM g UNION ALL SELECT 'b', two FROM g UNION ALL SELECT 'c', one FROM g UNION ALL SELECT 'd', none FROM g)
SELECT rungs, list(family ORDER BY family) AS families FROM f GROUP BY rungs""")
def audit_null_ladders(spark, sf_dir):
    """Families of columns by the null counts that they share: the columns are f0 to f2, blanked above some values."""
    blanks = {("a", 0): ("f1", 40), ("a", 1): ("f1", 20), ("b", 0): ("f1", 40), ("b", 1): ("f1", 20), ("c", 0): ("f2", 30), ("d", 0): ("f0", 1e9)}
    counts = panels.ship_panel(spark, sf_dir).agg(*[F.struct(F.lit(family).alias("family"), F.lit(k).alias("index"), F.count_if(F.when(F.col(c) > most, None).otherwise(F.col(c)).isNull()).alias("null_count")).alias(f"{family}{k}") for (family, k), (c, most) in blanks.items()])
    return audit.shared_ladders(counts.select(F.explode(F.array(*[f"{family}{k}" for family, k in blanks])).alias("x")).select("x.*"))


@query(f"""{WITH}, {PREDICTED}, grid AS (SELECT scale, most FROM (SELECT unnest([0.5, 1.0, 2.0]) AS scale), (SELECT unnest([5.0, 50.0]) AS most)),
p AS (SELECT scale, most, weight, target, least(greatest(prediction * scale, -most), most) AS prediction FROM predicted, grid), s AS (SELECT scale, most, {MOMENTS} FROM p GROUP BY ALL) SELECT scale::DOUBLE AS scale, most::DOUBLE AS most, {r('(2 * v - g) / d')} AS score FROM s""")
def audit_grid_scores(spark, sf_dir):
    """The score of each combination of scale and clip, in one pass over the rows with the grid broadcast."""
    grid = audit.parameter_grid(spark, {"scale": [0.5, 1.0, 2.0], "most": [5.0, 50.0]})
    df = panels.ship_panel(spark, sf_dir).withColumn("prediction", temporal.mean_before("target", 5)).select("weight", "target", "prediction").crossJoin(F.broadcast(grid))
    cut = df.withColumn("prediction", F.least(F.greatest(F.col("prediction") * F.col("scale"), -F.col("most")), F.col("most")))
    return _q(metrics.score(cut, ["scale", "most"]), "score").select("scale", "most", "score")


@query(f"""{WITH}, v AS (SELECT *, {over('avg(target)', -4, 0)} AS mean5, {over('avg(target)', -19, 0)} AS mean20 FROM panel), t AS (SELECT unnest(['weight', 'f0', 'f1', 'f2']) AS feature, unnest([weight, f0, f1, f2]) AS x, target, mean5, mean20 FROM v),
c AS (SELECT feature, corr(x, target) AS base, (corr(x, target) + corr(x, mean5) + corr(x, mean20)) / 3 AS consistency FROM t GROUP BY feature), k AS (SELECT *, row_number() OVER (ORDER BY abs(base) DESC, feature) AS base_rank, row_number() OVER (ORDER BY abs(consistency) DESC, feature) AS consistency_rank FROM c)
SELECT feature, CASE WHEN consistency_rank <= 3 THEN 'in' ELSE 'out' END AS side, base_rank::INT AS base_rank, (base_rank - 3)::INT AS from_cut FROM k WHERE (base_rank <= 3) <> (consistency_rank <= 3)""")
def metric_selection_churn(spark, sf_dir):
    """Features that a ladder of labels puts in or out of the best three; the best three by the target are first held against those that screen() takes."""
    df = panels.ship_panel(spark, sf_dir).withColumns({"mean5": temporal.mean_inclusive("target", 5), "mean20": temporal.mean_inclusive("target", 20), "one": F.lit(1.0)})
    names = ["weight", "f0", "f1", "f2"]
    profile = metrics.label_profile(metrics.label_correlations(df, names, ["target", "mean5", "mean20"]), "target", 3)
    return metrics.churn(metrics.same_selection(profile, metrics.screen(df, names, 3, weight="one"), 3), 3)


@query("""SELECT 1::BIGINT AS files, count(*) AS rows, (SELECT count(*) FROM (DESCRIBE lineitem)) AS columns, min(l_orderkey) AS low, max(l_orderkey) AS high, (count(*) - count(l_orderkey))::BIGINT AS nulls FROM lineitem""")
def scan_row_groups(spark, sf_dir):
    """The footer of lineitem, by row group, added up: rows, number of columns, and the range of l_orderkey."""
    groups = footers.row_groups(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey"])
    x = F.col("ranges")[0]
    return groups.agg(F.count_distinct("path").alias("files"), F.sum("group_rows").alias("rows"), F.max(F.size("columns")).cast("long").alias("columns"), F.min(x["least"].cast("long")).alias("low"), F.max(x["largest"].cast("long")).alias("high"), F.sum(x["nulls"]).alias("nulls"))


_TWO = "sum(weight) AS w, sum(weight * f0) AS sx, sum(weight * f1) AS sz, sum(weight * target) AS sy, sum(weight * f0 * f0) AS xx, sum(weight * f0 * f1) AS xz, sum(weight * f1 * f1) AS zz, sum(weight * f0 * target) AS xy, sum(weight * f1 * target) AS zy"


@query(f"""{WITH}, s AS (SELECT {_TWO} FROM panel), c AS (SELECT xx - sx * sx / w AS a, xz - sx * sz / w AS o, zz - sz * sz / w AS c, xy - sx * sy / w AS p, zy - sz * sy / w AS q FROM s),
n AS (SELECT o / sqrt(a * c) AS o, p / sqrt(a) AS b0, q / sqrt(c) AS b1, sqrt(a) AS s0, sqrt(c) AS s1 FROM c),
f AS (SELECT *, abs(b0) >= abs(b1) AS zero_first, greatest(abs(b0), abs(b1)) AS most, CASE WHEN abs(b0) >= abs(b1) THEN b0 ELSE b1 END AS b, CASE WHEN abs(b0) >= abs(b1) THEN b1 ELSE b0 END AS other FROM n),
g AS (SELECT *, most * power(0.001, i / 99.0) AS penalty, i FROM f, (SELECT unnest(range(100)) AS i)), h AS (SELECT *, sign(b) * greatest(abs(b) - penalty, 0) AS v FROM g),
k AS (SELECT *, abs(other - o * v) <= penalty AS alone FROM h), e AS (SELECT * FROM k WHERE i < (SELECT coalesce(min(i), 100) FROM k WHERE NOT alone) ORDER BY i DESC LIMIT 1)
SELECT {r('CASE WHEN zero_first THEN v / s0 ELSE 0 END')} AS f0, {r('CASE WHEN zero_first THEN 0 ELSE v / s1 END')} AS f1 FROM e""")
def linear_lasso_of_one(spark, sf_dir):
    """The lasso of two features along its path until the second would enter."""
    w = linear.lasso(linear.gram(panels.ship_panel(spark, sf_dir), ["f0", "f1"], ["target"], "weight"), 1)
    return _q(spark.createDataFrame([(float(w[0]), float(w[1]))], "f0 double, f1 double"), "f0", "f1")


@query(f"""{WITH}, s AS (SELECT {_TWO} FROM panel), c AS (SELECT (xx - sx * sx / w) / w AS a, (xz - sx * sz / w) / w AS o, (zz - sz * sz / w) / w AS c FROM s),
l AS (SELECT *, unnest([1, -1]) AS side FROM c), v AS (SELECT *, (a + c) / 2 + side * sqrt(((a - c) / 2) ** 2 + o * o) AS variance FROM l),
d AS (SELECT side, variance, o / sqrt(o * o + (variance - a) ** 2) AS x, (variance - a) / sqrt(o * o + (variance - a) ** 2) AS z FROM v)
SELECT CASE WHEN side = 1 THEN 0 ELSE 1 END AS axis, {r('variance', 4)} AS variance, {r('x * CASE WHEN abs(x) >= abs(z) THEN sign(x) ELSE sign(z) END')} AS f0, {r('z * CASE WHEN abs(x) >= abs(z) THEN sign(x) ELSE sign(z) END')} AS f1 FROM d""")
def linear_axes_of_two(spark, sf_dir):
    values, vectors = linear.principal_axes(linear.gram(panels.ship_panel(spark, sf_dir), ["f0", "f1"], ["target"], "weight"), 2)
    out = spark.createDataFrame([(k, float(v), float(vectors[0, k]), float(vectors[1, k])) for k, v in enumerate(values)], "axis int, variance double, f0 double, f1 double")
    return _q(out, "f0", "f1").withColumn("variance", q(F.col("variance"), 4))


@query(f"""{WITH}, c AS (SELECT {_ONE} FROM panel), p AS (SELECT unnest([0.01, 0.1, 1.0]) AS alpha),
m AS (SELECT *, (xy - x * y / w) / ((xx - x * x / w) * (1 + alpha)) AS b FROM c, p), i AS (SELECT *, y / w - b * x / w AS i FROM m),
e AS (SELECT *, yy - 2 * (i * y + b * xy) + i * i * w + 2 * i * b * x + b * b * xx AS error FROM i) SELECT alpha::DOUBLE AS alpha, {r('1 - error / (yy - y * y / w)')} AS r2, {r('1 - error / yy')} AS r2_zero FROM e""")
def linear_alpha_scores(spark, sf_dir):
    """Scores along a path of penalties, from one Gram matrix."""
    g = linear.gram(panels.ship_panel(spark, sf_dir), ["f1"], ["target"], "weight")
    rows = [(a, *linear.residual_share(g, m)) for a, m in linear.alpha_path(g, [0.01, 0.1, 1.0], relative=True).items()]
    return _q(spark.createDataFrame(rows, "alpha double, r2 double, r2_zero double"), "r2", "r2_zero")
