"""Queries of designs, lag caches, saved states, calibrations, profiles and bootstraps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import q
from ..operators import cross, design, infer, joins, linear, metrics, temporal
from ..sources import panels
from .registry import query
from .sql import ASSET, MOMENTS, PREDICTED, SCORE, WITH, over, r

KEYS = ("time_id", "asset_id")


def _q(df, *columns):
    return df.withColumns({c: q(F.col(c)) for c in columns})


def _predicted(spark, sf_dir):
    return panels.ship_panel(spark, sf_dir).withColumn("prediction", temporal.mean_before("target", 5))


# --- designs


@query(f"""{WITH} SELECT time_id, asset_id, f1 AS x_f1, coalesce(lag(f1) OVER w, 0) AS x_lag1_f1, f0 - coalesce(lag(f0) OVER w, 0) AS x_diff1_f0, {r(over('avg(f2)', -4, 0))} AS x_rmean5_f2,
  0.0::DOUBLE AS x_unknown, asset_id::DOUBLE AS x_asset_id FROM panel WINDOW w AS ({ASSET})""")
def design_by_name(spark, sf_dir):
    names = ["f1", "lag1_f1", "diff1_f0", "rmean5_f2", "unknown", "asset_id"]
    return _q(design.named_design(panels.ship_panel(spark, sf_dir), names), "x_rmean5_f2")


_DEV = "dev AS (SELECT *, f0 - avg(f0) OVER (PARTITION BY time_id) AS d0, f1 - avg(f1) OVER (PARTITION BY time_id) AS d1 FROM panel)"


@query(f"""{WITH}, {_DEV} SELECT time_id, asset_id, [{r('d0')}, {r('d1')}, {r('coalesce(lag(d0) OVER w, 0)')}, {r('d0 - coalesce(lag(d0) OVER w, 0)')}, {r('coalesce(avg(d0) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0)')},
  {r('d0 - coalesce(avg(d0) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0)')}, {r('coalesce(lag(d0, 2) OVER w, 0)')}, {r('coalesce(lag(d0, 5) OVER w, 0)')}, {r('coalesce(avg(d0) OVER (w ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING), 0)')}, asset_id::DOUBLE] AS x
FROM dev WINDOW w AS ({ASSET})""")
def design_cross(spark, sf_dir):
    df, order = design.cross_design(panels.ship_panel(spark, sf_dir), ["f0", "f1"], ["f0"], "t1_lags", 50)
    return design.vector(df, order).select(*KEYS, F.transform("x", lambda v: q(v) + 0.0).alias("x"))


@query(f"""{WITH}, m AS (SELECT *, avg(f0) OVER (PARTITION BY time_id) AS m0, avg(f1) OVER (PARTITION BY time_id) AS m1 FROM panel)
SELECT time_id, asset_id, {r('m0 / 2')} AS mean_f0, {r('m1 / 2')} AS mean_f1, {r('f0 - m0')} AS dev_f0, {r('f1 - m1')} AS dev_f1, f0 AS raw_f0, f1 AS raw_f1 FROM m""")
def design_two_bases(spark, sf_dir):
    df = panels.ship_panel(spark, sf_dir)
    features = ["f0", "f1"]
    return _q(df.select(*KEYS, *design.two_bases(features, "mean", 4.0), *design.two_bases(features, "raw")[:2]), "mean_f0", "mean_f1", "dev_f0", "dev_f1")


@query(f"""{WITH}, t AS (SELECT time_id, (avg(f0) + avg(f1)) / 2 AS m, (stddev_pop(f0) + stddev_pop(f1)) / 2 AS s FROM panel GROUP BY time_id),
l AS (SELECT *, coalesce(lag(m) OVER (ORDER BY time_id), 0) AS ml, coalesce(lag(s) OVER (ORDER BY time_id), 0) AS sl FROM t)
SELECT time_id, asset_id, coalesce(lag(f0) OVER ({ASSET}), 0) AS lag1_f0, {r('m')} AS regime_mean, {r('s')} AS regime_std, {r('ml')} AS regime_mean_lag, {r('sl')} AS regime_std_lag, {r('m - ml')} AS regime_mean_change, {r('s - sl')} AS regime_std_change
FROM panel JOIN l USING (time_id)""")
def design_regime(spark, sf_dir):
    state = [f"regime_{k}{x}" for k in ("mean", "std") for x in ("", "_lag", "_change")]
    out = temporal.temporal_features(panels.ship_panel(spark, sf_dir), ["f0", "f1"], "t4_regime")
    return _q(out.select(*KEYS, "lag1_f0", *state), *state)


@query(f"{WITH}, {PREDICTED} SELECT time_id, asset_id, {r('avg(prediction) OVER (PARTITION BY time_id)')} AS market_state FROM predicted")
def design_market_state(spark, sf_dir):
    return _q(design.with_market_state(_predicted(spark, sf_dir), "prediction").select(*KEYS, "market_state"), "market_state")


_ROBUST = "greatest(least((greatest(least(f0, 400), 20) - 150) / 70, 10), -10)"


@query(f"""{WITH}, v AS (SELECT time_id, asset_id, {_ROBUST} AS x FROM panel)
SELECT time_id, asset_id, {r('coalesce(lag(x) OVER w, 0)')} AS lag1, {r('coalesce(lag(x, 10) OVER w, 0)')} AS lag10, {r('x - coalesce(lag(x, 3) OVER w, 0)')} AS delta3, {r('x - 2 * coalesce(lag(x) OVER w, 0) + coalesce(lag(x, 2) OVER w, 0)')} AS acceleration1,
  {r('coalesce(avg(x) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0)')} AS mean5, {r('x - coalesce(avg(x) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0)')} AS deviation20, {r('coalesce(stddev_pop(x) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0)', 5)} AS std5
FROM v WINDOW w AS ({ASSET})""")
def design_atoms_from_lags(spark, sf_dir):
    df = panels.ship_panel(spark, sf_dir).withColumn("past", temporal.lag_cache("f0", 20))
    fitted = [F.lit(float(v)) for v in (20, 400, 150, 70)]
    atoms = design.atoms_from_lags(design.robust(F.col("f0"), *fitted), F.col("past"), *fitted)
    wanted = ("lag1", "lag10", "delta3", "acceleration1", "mean5", "deviation20", "std5")
    return df.select(*KEYS, *[q(atoms[c], 5 if c == "std5" else 6).alias(c) for c in wanted])


@query(f"""{WITH}, a AS (SELECT time_id, asset_id, coalesce(lag(f0) OVER ({ASSET}), 0) AS lag1, {r('coalesce(' + over('avg(f0)', -20, -1) + ', 0)')} AS mean20 FROM panel) SELECT * FROM a WHERE time_id >= 1200""")
def design_resumed_state(spark, sf_dir):
    df = panels.ship_panel(spark, sf_dir)
    state = design.saved_state(df.filter("time_id < 1200"), ["f0"], 20)
    on = design.resumed(df.filter("time_id >= 1200"), state)
    out = on.select(*KEYS, "warm_up", temporal.lag("f0").alias("lag1"), temporal.mean_before("f0", 20).alias("mean20"))
    return _q(out.filter("not warm_up").drop("warm_up"), "mean20")


@query(f"""{WITH}, l AS (SELECT time_id, list(f1 ORDER BY asset_id) AS v FROM panel GROUP BY time_id), w AS (SELECT max(len(v)) AS w FROM l)
SELECT time_id, len(list_resize(v, w, 'nan'::DOUBLE))::INT AS width, list_sum(v) AS total, (w - len(v))::INT AS padded FROM l, w""")
def cross_dense_lists(spark, sf_dir):
    lists = cross.dense_lists(panels.ship_panel(spark, sf_dir), "f1")
    real = F.filter("values", lambda x: ~F.isnan(x))
    return lists.select("time_id", F.size("values").alias("width"), F.aggregate(real, F.lit(0.0), lambda a, x: a + x).alias("total"), (F.size("values") - F.size(real)).alias("padded"))


# --- calibrations


@query(f"""{WITH}, {PREDICTED}, s AS (SELECT sum(weight * f1 * f1) AS a, sum(weight * f1 * f2) AS b, sum(weight * f2 * f2) AS c, sum(weight * (target - prediction) * f1) AS p, sum(weight * (target - prediction) * f2) AS q FROM predicted),
k AS (SELECT a + 0.01 * greatest((a + c) / 2, 1) AS a, b, c + 0.01 * greatest((a + c) / 2, 1) AS c, p, q FROM s)
SELECT {r('(p * c - q * b) / (a * c - b * b)')} AS f1, {r('(q * a - p * b) / (a * c - b * b)')} AS f2 FROM k""")
def linear_calibration(spark, sf_dir):
    df = _predicted(spark, sf_dir).withColumn("residual", F.col("target") - F.col("prediction"))
    c = linear.calibration_weights(df, "residual", ["f1", "f2"], penalty=0.01)
    return _q(spark.createDataFrame([tuple(map(float, c))], "f1 double, f2 double"), "f1", "f2")


@query(f"""{WITH}, {PREDICTED}, s AS (SELECT *, avg(prediction) OVER t AS market, prediction - avg(prediction) OVER t AS estimate, stddev_pop(prediction) OVER t AS state FROM predicted WINDOW t AS (PARTITION BY time_id)),
b AS (SELECT *, ((state >= 2.0317)::INT + (state >= 4.0731)::INT + (state >= 1000)::INT)::INT AS bin FROM s),
w AS (SELECT bin, count(*) AS n, sum(weight * (target - market) * estimate) AS v, sum(weight * estimate * estimate) AS g FROM b GROUP BY bin), a AS (SELECT sum(v) AS v, sum(g) AS g FROM w),
k AS (SELECT x.bin, CASE WHEN coalesce(n, 0) <= 100 THEN a.v / a.g ELSE w.v / w.g END AS share FROM (SELECT unnest(range(4))::INT AS bin) x LEFT JOIN w USING (bin), a)
SELECT time_id, asset_id, bin, {r('share')} AS share, {r('market + share * estimate')} AS prediction FROM b JOIN k USING (bin)""")
def linear_blend_by_bin(spark, sf_dir):
    mean = cross.mean_of_time("prediction")
    spread = F.stddev_pop("prediction").over(cross.by_time())
    df = _predicted(spark, sf_dir).withColumns({"market": mean, "estimate": F.col("prediction") - mean, "state": spread}).withColumn("residual", F.col("target") - F.col("market"))
    edges = [2.0317, 4.0731, 1000.0]
    weights = linear.binned_weights(df, "state", edges, "residual", "estimate")
    return _q(linear.blended_by_bin(df, weights, "state", edges, "market", "estimate").select(*KEYS, "bin", "share", "prediction"), "share", "prediction")


@query(f"{WITH} SELECT asset_id, {r('sum(weight * f1 * target) / (sum(weight * f1 * f1) + 100)')} AS f1 FROM panel GROUP BY asset_id")
def linear_block_ridge(spark, sf_dir):
    fitted = linear.block_ridge(panels.ship_panel(spark, sf_dir), ["f1"], 100.0)
    return _q(spark.createDataFrame([(int(k), float(m.weights[0, 0])) for k, m in fitted.items()], "asset_id long, f1 double"), "f1")


@query(f"""{WITH}, {PREDICTED}, s AS (SELECT asset_id, (sum(weight * prediction * target) + 1000) / (sum(weight * prediction * prediction) + 1000) AS slope FROM predicted WHERE time_id < 1200 GROUP BY asset_id)
SELECT time_id, asset_id, {r('prediction * coalesce(slope, 1)')} AS prediction FROM predicted LEFT JOIN s USING (asset_id) WHERE time_id >= 1200""")
def linear_stored_scales(spark, sf_dir):
    df = _predicted(spark, sf_dir)
    stored = linear.scale_artefact(linear.slopes(df.filter("time_id < 1200"), ["asset_id"], "prediction", shrink=1000.0)).first()["scales"]
    return _q(linear.apply_scales(df.filter("time_id >= 1200"), stored).select(*KEYS, "prediction"), "prediction")


# --- profiles and pairs

_HOLES = "h AS (SELECT weight, target, CASE WHEN time_id % 7 = 0 THEN NULL ELSE f0 END AS f0, CASE WHEN asset_id = 3 THEN NULL ELSE f1 END AS f1 FROM panel)"


def _pair_sql(a: str, b: str) -> str:
    n, x, y = "sum(weight)", f"sum(weight * {a})", f"sum(weight * {b})"
    return f"SELECT '{a}' AS a, '{b}' AS b, {n} AS weight, {r(f'({n} * sum(weight * {a} * {b}) - {x} * {y}) / sqrt(({n} * sum(weight * {a} * {a}) - {x} * {x}) * ({n} * sum(weight * {b} * {b}) - {y} * {y}))')} AS correlation FROM h WHERE {a} IS NOT NULL AND {b} IS NOT NULL"


@query(f"{WITH}, {_HOLES} {' UNION ALL '.join(_pair_sql(a, b) for a, b in (('target', 'f0'), ('target', 'f1'), ('f0', 'f1')))}")
def metric_weighted_pairs(spark, sf_dir):
    nan = F.lit(float("nan"))
    df = panels.ship_panel(spark, sf_dir).withColumns({"f0": F.when(F.expr("time_id % 7 = 0"), nan).otherwise(F.col("f0")), "f1": F.when(F.col("asset_id") == 3, nan).otherwise(F.col("f1"))})
    return _q(metrics.weighted_pairs(df, ["target", "f0", "f1"]), "correlation")


_LADDER = f"l AS (SELECT *, {over('avg(target)', -4, 0)} AS mean5, {over('avg(target)', -19, 0)} AS mean20 FROM panel)"


@query(f"""{WITH}, {_LADDER}, p AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, '{y}' AS label, corr({f}, {y}) AS c FROM l" for f in ('weight', 'f0', 'f1', 'f2') for y in ('target', 'mean5', 'mean20'))}),
s AS (SELECT feature, avg(c) AS consistency, max(c) FILTER (label = 'target') AS base FROM p GROUP BY feature),
k AS (SELECT *, row_number() OVER (ORDER BY abs(base) DESC, feature)::INT AS base_rank, row_number() OVER (ORDER BY abs(consistency) DESC, feature)::INT AS consistency_rank FROM s)
SELECT feature, {r('consistency')} AS consistency, {r('base')} AS base, base_rank, consistency_rank, base_rank <= 2 AS base_top, consistency_rank <= 2 AS consistency_top FROM k""")
def metric_label_profile(spark, sf_dir):
    df = panels.ship_panel(spark, sf_dir).withColumns({"mean5": temporal.mean_inclusive("target", 5), "mean20": temporal.mean_inclusive("target", 20)})
    correlations = metrics.label_correlations(df, ["weight", "f0", "f1", "f2"], ["target", "mean5", "mean20"])
    return _q(metrics.label_profile(correlations, "target", 2), "consistency", "base")


@query(f"""{WITH}, t AS (SELECT time_id, sha256(string_agg(target::BIGINT::VARCHAR, ',' ORDER BY asset_id)) AS d FROM panel GROUP BY time_id)
SELECT count(*) AS groups, sha256(string_agg(d, ',' ORDER BY time_id)) AS sha256 FROM t""")
def metric_ordered_fingerprint(spark, sf_dir):
    return metrics.ordered_fingerprint(panels.ship_panel(spark, sf_dir).withColumn("target", F.col("target").cast("long")), "target")


@query(f"""{WITH}, {PREDICTED}, b AS (SELECT *, CASE WHEN time_id BETWEEN 500 AND 1199 THEN 'early' WHEN time_id BETWEEN 1200 AND 1700 THEN 'late' END AS block FROM predicted), s AS (SELECT block, count(*) AS n, {MOMENTS} FROM b WHERE block IS NOT NULL GROUP BY block)
SELECT block, n, d, {SCORE} FROM s""")
def metric_block_scores(spark, sf_dir):
    return _q(metrics.block_scores(_predicted(spark, sf_dir), [("early", 500, 1199), ("late", 1200, 1700)]).drop("best_scale"), "a", "b", "peak", "score")


@query(f"{WITH}, {PREDICTED} SELECT time_id, asset_id, {r('prediction')} AS prediction FROM predicted")
def metric_without_clip_hits(spark, sf_dir):
    return _q(metrics.without_clip_hits(_predicted(spark, sf_dir).select(*KEYS, "prediction"), "prediction", 1e6), "prediction")


@query("SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem WHERE l_quantity > 45")
def join_subset_check(spark, sf_dir):
    narrow = panels.table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return joins.with_subset_check(narrow, panels.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


# --- bootstraps


def _draw(key: str, n: str) -> str:
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT % ({n}))"


_BLOCKS = f"""{PREDICTED}, c AS (SELECT time_id, row_number() OVER (ORDER BY time_id) AS place, {MOMENTS} FROM predicted GROUP BY time_id), n AS (SELECT count(*) AS n FROM c),
draws AS (SELECT replicate, {_draw("'7:' || replicate || ':' || k", 'n - 50 + 1')} AS start FROM (SELECT unnest(range(200)) AS replicate), n, (SELECT unnest(range(1, 1 + ceil(n / 50.0)::BIGINT)) AS k FROM n))"""


@query(f"{WITH}, {_BLOCKS} SELECT replicate, {r('sum(d)', 3)} AS d, {r('sum(v)', 3)} AS v, {r('sum(g)', 3)} AS g FROM draws JOIN c ON c.place BETWEEN start + 1 AND start + 50 GROUP BY replicate")
def infer_block_bootstrap(spark, sf_dir):
    cube = _predicted(spark, sf_dir).groupBy("time_id").agg(*metrics.moments())
    return infer.block_bootstrap(cube, ["d", "v", "g"], 50, 200, 7).select("replicate", *[q(F.col(c), 3).alias(c) for c in ("d", "v", "g")])


@query(f"""{WITH}, {PREDICTED}, c AS (SELECT time_id // 100 - (time_id < 0 AND time_id % 100 <> 0)::INT AS chunk, sum(weight * target * target) AS d, sum(weight * target * f1) AS vb, sum(weight * f1 * f1) AS gb, sum(weight * target * prediction) AS va, sum(weight * prediction * prediction) AS ga FROM predicted GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY chunk) - 1 AS place FROM c), n AS (SELECT count(*) AS n FROM o),
draws AS (SELECT replicate, {_draw("'7:' || replicate || ':' || k", 'n')} AS place FROM (SELECT unnest(range(200)) AS replicate), n, (SELECT unnest(range(n)) AS k FROM n)),
s AS (SELECT replicate, sum(d) AS d, sum(vb) AS vb, sum(gb) AS gb, sum(va) AS va, sum(ga) AS ga FROM draws JOIN o USING (place) GROUP BY replicate), g AS (SELECT (va * va / (ga * d)) / (vb * vb / (gb * d)) - 1 AS gain FROM s)
SELECT {r('quantile_cont(gain, 0.025)')} AS low, {r('quantile_cont(gain, 0.975)')} AS high, {r('avg((gain > 0)::INT)')} AS positive FROM g""")
def infer_chunk_bootstrap(spark, sf_dir):
    w, y = F.col("weight"), F.col("target")
    chunks = _predicted(spark, sf_dir).groupBy(F.floor(F.col("time_id") / 100).cast("long").alias("chunk")).agg(F.sum(w * y * y).alias("d"), F.sum(w * y * F.col("f1")).alias("v_base"), F.sum(w * F.col("f1") ** 2).alias("g_base"), F.sum(w * y * F.col("prediction")).alias("v_arm"), F.sum(w * F.col("prediction") ** 2).alias("g_arm"))
    return _q(infer.bootstrap_chunks(chunks, 200, 7), "low", "high", "positive")


_PHASES = ", ".join(f"sum(v) FILTER (((time_id % 10) + 10) % 10 = {k}) / sum(d) AS p{k}" for k in range(10))
_ALL = ", ".join(f"coalesce(p{k}, 0)" for k in range(10))


@query(f"""{WITH}, {_BLOCKS}, seen AS (SELECT list_var_samp([{_ALL}]) AS observed FROM (SELECT {_PHASES} FROM c)),
each AS (SELECT replicate, {_PHASES} FROM draws JOIN c ON c.place BETWEEN start + 1 AND start + 50 GROUP BY replicate),
own AS (SELECT ({' + '.join(f'var_samp(coalesce(p{k}, 0))' for k in range(10))}) / 10 AS sampling, quantile_cont(list_var_samp([{_ALL}]), 0.025) AS lo, quantile_cont(list_var_samp([{_ALL}]), 0.975) AS hi FROM each)
SELECT {r('observed', 9)} AS observed, {r('sampling', 9)} AS sampling, {r('observed - sampling', 9)} AS excess, {r('lo - sampling', 9)} AS low, {r('hi - sampling', 9)} AS high, observed > sampling AND lo > sampling AS detected FROM seen, own""")
def infer_phase_heterogeneity(spark, sf_dir):
    cube = _predicted(spark, sf_dir).groupBy("time_id").agg(*metrics.moments())
    names = ("observed", "sampling", "excess", "low", "high")
    return infer.phase_heterogeneity(cube, 50, 200, 7).select(*[q(F.col(c), 9).alias(c) for c in names], "detected")


@query(f"""{WITH}, f AS (SELECT asset_id % 3 AS k, asset_id, avg(f1) AS base, avg(f2) AS arm FROM panel GROUP BY asset_id)
SELECT 'run ' || k AS label, count(*) AS folds, {r('avg(arm - base)')} AS mean_gain, count(*) FILTER (arm > base) AS positive, avg(arm - base) > 0 AND count(*) FILTER (arm > base) >= 3 AS accepted FROM f GROUP BY k""")
def infer_acceptance(spark, sf_dir):
    folds = panels.ship_panel(spark, sf_dir).groupBy("asset_id").agg(F.avg("f1").alias("base"), F.avg("f2").alias("arm"))
    stored = folds.groupBy(F.concat(F.lit("run "), F.pmod("asset_id", F.lit(3)).cast("string")).alias("label")).agg(F.to_json(F.struct(F.collect_list(F.struct("base", "arm")).alias("folds"))).alias("payload"))
    return _q(infer.acceptance(stored, 3), "mean_gain")
