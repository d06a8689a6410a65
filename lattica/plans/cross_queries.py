"""Queries of sampling, cross-sectional and temporal operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric
from ..functions.numeric import q
from ..operators import cross, metrics, split, temporal
from ..sources import panels, tables
from .registry import query
from .sql import ASSET, WITH, WITH_EVENTS, over, r

KEYS = ("time_id", "asset_id")


def _ship(spark, sf_dir):
    return panels.ship_panel(spark, sf_dir)


def _out(df, *columns):
    """Keys, whole columns as they are, others rounded."""
    kinds = dict(df.dtypes)
    return df.select(*KEYS, *[(q(F.col(c)) if kinds[c] == "double" else F.col(c)).alias(c) for c in columns])


@query(f"""{WITH}, dev AS (
  SELECT *, target - avg(target) OVER (PARTITION BY time_id) AS deviation FROM panel),
past AS (
  SELECT *, coalesce({over('avg(deviation)', -5, -1)}, 0.0::DOUBLE) AS prediction FROM dev),
sums AS (SELECT asset_id, count(*) AS n, sum(weight * deviation * deviation) AS d, sum(weight * deviation * prediction) AS v, sum(weight * prediction * prediction) AS g FROM past GROUP BY asset_id)
SELECT asset_id, n, {r('v / d')} AS a, {r('g / d')} AS b, {r('(2 * v - g) / d')} AS score FROM sums""")
def flagship_asset_score(spark, sf_dir):
    df = cross.demean(_ship(spark, sf_dir), ["target"]).withColumnRenamed("target_dev", "deviation")
    df = df.withColumn("prediction", temporal.mean_before("deviation", 5))
    return metrics.score(df, ["asset_id"], target="deviation").select("asset_id", "n", *[q(F.col(c)).alias(c) for c in ("a", "b", "score")])


@query(f"{WITH} SELECT time_id, asset_id, target FROM panel WHERE time_id % 7 = 0")
def sample_periodic(spark, sf_dir):
    return split.sample_periodic(_ship(spark, sf_dir), 7).select(*KEYS, "target")


@query(f"{WITH} SELECT time_id, asset_id, target FROM panel WHERE (time_id // 10 + time_id % 10) % 4 = 0")
def sample_phase_balanced(spark, sf_dir):
    return split.sample_phase_balanced(_ship(spark, sf_dir), 4).select(*KEYS, "target")


@query(f"{WITH} SELECT time_id, asset_id, target FROM panel WHERE time_id % 10 IN (2, 7)")
def sample_residues(spark, sf_dir):
    return split.sample_residues(_ship(spark, sf_dir), 10, [2, 7]).select(*KEYS, "target")


@query(f"{WITH} SELECT time_id, asset_id, f0 FROM panel WHERE time_id BETWEEN 300 AND 420")
def scan_time_range(spark, sf_dir):
    return panels.ship_panel(spark, sf_dir, 300, 420).select(*KEYS, "f0")


@query(f"{WITH} SELECT min(time_id) AS low, max(time_id) AS high FROM panel")
def scan_time_bounds(spark, sf_dir):
    return tables.time_range(_ship(spark, sf_dir))


@query(f"""{WITH} SELECT 'f0' AS "column", count(*) AS rows, 0::BIGINT AS missing, min(f0) AS least, max(f0) AS largest FROM panel
UNION ALL SELECT 'weight', count(*), 0, min(weight), max(weight) FROM panel""")
def scan_column_profile(spark, sf_dir):
    return tables.column_profile(_ship(spark, sf_dir), ["f0", "weight"])


@query(f"""{WITH} SELECT time_id, asset_id, {r('least(greatest((least(greatest(target, -20), 20) - 1) / 4, -10), 10)')} AS robust,
  {r('least(greatest(target * 0.5, -3), 3)')} AS clipped, (time_id * 256 + asset_id)::BIGINT AS key, {r('sin(2 * pi() * (time_id % 10) / 10)')} AS wave FROM panel""")
def scalar_transforms(spark, sf_dir):
    df = _ship(spark, sf_dir)
    x = F.col("target")
    return df.select(*KEYS, q(numeric.robust(x, F.lit(-20.0), F.lit(20.0), F.lit(1.0), F.lit(4.0))).alias("robust"), q(numeric.clip_symmetric(x, 3, 0.5)).alias("clipped"), numeric.pack_key(F.col("time_id"), F.col("asset_id")).alias("key"), (q(numeric.phase_waves(F.col("time_id"))[0]) + F.lit(0.0)).alias("wave"))


@query("SELECT event_id, coalesce(try_cast(replace(replace(props, '{\"k\": ', ''), '}', '') AS DOUBLE), 0) AS number FROM events")
def lenient_numbers(spark, sf_dir):
    text = F.regexp_replace(F.regexp_replace("props", r'\{"k": ', ""), r"\}", "")
    return panels.table(spark, sf_dir, "events").select("event_id", numeric.number(text).alias("number"))


@query(f"""{WITH} SELECT time_id, asset_id, {r('0.5 + 0.25 * f0 - 0.125 * f1')} AS prediction FROM panel""")
def linear_prediction(spark, sf_dir):
    return _ship(spark, sf_dir).select(*KEYS, q(numeric.linear_predict([F.col("f0"), F.col("f1")], [0.25, -0.125], 0.5)).alias("prediction"))


@query(f"""{WITH}, s AS (SELECT *, avg(target) OVER w AS m, stddev_pop(target) OVER w AS sd FROM panel WINDOW w AS (PARTITION BY time_id))
SELECT time_id, asset_id, {r('m')} AS mean, {r('target - m')} AS dev, {r('least(greatest((target - m) / greatest(sd, 0.01), -10), 10)')} AS std FROM s""")
def cross_standardise(spark, sf_dir):
    df = _ship(spark, sf_dir)
    df = cross.standardise(cross.demean(df, ["target"]), ["target"]).withColumn("mean", cross.mean_of_time("target"))
    return _out(df.withColumnsRenamed({"target_dev": "dev", "target_std": "std"}), "mean", "dev", "std")


@query(f"{WITH} SELECT time_id, {r('avg(target)')} AS target, {r('avg(f0)')} AS f0 FROM panel GROUP BY time_id")
def cross_group_means(spark, sf_dir):
    return cross.group_means(_ship(spark, sf_dir), ["target", "f0"]).select("time_id", q(F.col("target")).alias("target"), q(F.col("f0")).alias("f0"))


@query(f"{WITH} SELECT time_id, {r('sum(weight * target) / sum(weight)')} AS mean FROM panel GROUP BY time_id")
def cross_weighted_mean(spark, sf_dir):
    return _ship(spark, sf_dir).groupBy("time_id").agg(q(cross.weighted_mean(F.col("target"), F.col("weight"))).alias("mean"))


@query(f"""{WITH}, s AS (SELECT *, sum(weight * target) OVER w / sum(weight) OVER w AS market FROM panel WINDOW w AS (PARTITION BY time_id))
SELECT time_id, asset_id, {r('market')} AS market, {r('target - market')} AS "cross" FROM s""")
def cross_market_split(spark, sf_dir):
    return _out(cross.split_market(_ship(spark, sf_dir), "target", "weight"), "market", "cross")


@query(f"""{WITH}, s AS (SELECT *, target * (1 + asset_id / 16.0::DOUBLE) AS x FROM panel)
SELECT time_id, asset_id, {r('x - avg(x) OVER (PARTITION BY time_id)')} AS projected FROM s""")
def cross_scale_project(spark, sf_dir):
    return _out(cross.scale_and_project(_ship(spark, sf_dir), "target", {a: 1 + a / 16 for a in range(15)}), "projected")


@query(f"{WITH} SELECT time_id, {r('stddev_pop(target)')} AS std, {r('sqrt(avg(target * target))')} AS rms FROM panel GROUP BY time_id")
def cross_dispersion(spark, sf_dir):
    return cross.dispersion(_ship(spark, sf_dir), "target").select("time_id", q(F.col("std")).alias("std"), q(F.col("rms")).alias("rms"))


@query(f"""{WITH}, s AS (SELECT *, row_number() OVER (PARTITION BY time_id ORDER BY target, asset_id) - 1 AS k, count(*) OVER (PARTITION BY time_id) AS n FROM panel)
SELECT time_id, asset_id, {r('(2 * k - (n - 1))::DOUBLE / greatest(n - 1, 1)')} AS rank FROM s""")
def cross_symmetric_rank(spark, sf_dir):
    return _out(cross.symmetric_rank(_ship(spark, sf_dir), "target"), "rank")


@query(f"""{WITH}, s AS (SELECT *, row_number() OVER (PARTITION BY time_id ORDER BY target, asset_id) - 1 AS k, count(*) OVER (PARTITION BY time_id) AS n, quantile_cont(target, 0.5) OVER (PARTITION BY time_id) AS med FROM panel),
z AS (SELECT *, quantile_cont(abs(target - med), 0.5) OVER (PARTITION BY time_id) AS mad, k::DOUBLE / greatest(n - 1, 1) - 0.5 AS p FROM s)
SELECT time_id, asset_id, {r('p')} AS percentile, {r('least(greatest((target - med) / CASE WHEN mad <= 1e-6 THEN 1 ELSE mad END, -12), 12)')} AS robust_z, {r('greatest(abs(p) - 0.3, 0)')} AS tail FROM z""")
def cross_tail_scores(spark, sf_dir):
    return _out(cross.tail_scores(_ship(spark, sf_dir), "target"), "percentile", "robust_z", "tail")


@query(f"""{WITH}, s AS (SELECT time_id, avg(target) AS mean, stddev_pop(target) AS std, quantile_cont(target, 0.25) AS q25, quantile_cont(target, 0.5) AS q50, quantile_cont(target, 0.75) AS q75,
  quantile_cont(target, 0.9) - quantile_cont(target, 0.1) AS spread, avg((target > 0)::INT) AS positive FROM panel GROUP BY time_id)
SELECT time_id, {', '.join(f"{r(c)} AS {c}" for c in ('mean', 'std', 'q25', 'q50', 'q75', 'spread', 'positive'))},
  {r('mean - coalesce(lag(mean) OVER (ORDER BY time_id), 0)')} AS delta, coalesce(time_id - lag(time_id) OVER (ORDER BY time_id), 0) AS gap FROM s""")
def cross_market_summary(spark, sf_dir):
    df = cross.market_summary(_ship(spark, sf_dir), "target", dynamics=True)
    return df.select("time_id", *[q(F.col(c)).alias(c) for c in ("mean", "std", "q25", "q50", "q75", "spread", "positive", "delta")], "gap")


@query(f"""{WITH} SELECT time_id, {', '.join(f'coalesce(max(target) FILTER (asset_id = {a}), 0) AS a{a}' for a in range(15))}, {', '.join(f'(count(*) FILTER (asset_id = {a}))::INT AS has{a}' for a in range(15))} FROM panel GROUP BY time_id""")
def cross_asset_panel(spark, sf_dir):
    return cross.asset_panel(_ship(spark, sf_dir), "target", range(15))


@query(f"""{WITH}, s AS (SELECT time_id, count(*) AS n, stddev_pop(target) AS sa, stddev_pop(f0) AS sb, covar_pop(target, f0) AS c FROM panel GROUP BY time_id),
i AS (SELECT c / (sa * sb) AS ic FROM s WHERE n >= 3 AND sa > 0 AND sb > 0)
SELECT count(*) AS times, {r('avg(ic)')} AS mean_ic, {r('avg(ic) / stddev_pop(ic)')} AS icir, {r('avg((ic > 0)::INT)')} AS positive_rate FROM i""")
def cross_information_coefficient(spark, sf_dir):
    df = cross.information_coefficient(_ship(spark, sf_dir), "target", "f0")
    return df.select("times", *[q(F.col(c)).alias(c) for c in ("mean_ic", "icir", "positive_rate")])


@query(f"""{WITH}, s AS (SELECT time_id, (avg(f0) + avg(f1)) / 2 AS g_mean, (stddev_pop(f0) + stddev_pop(f1)) / 2 AS g_std FROM panel GROUP BY time_id)
SELECT time_id, {r('g_mean')} AS g_mean, {r('g_std')} AS g_std, {r('g_mean - coalesce(lag(g_mean) OVER (ORDER BY time_id), 0)')} AS g_mean_change FROM s""")
def cross_regime_state(spark, sf_dir):
    return cross.regime_state(_ship(spark, sf_dir), {"g": ["f0", "f1"]}).select("time_id", *[q(F.col(c)).alias(c) for c in ("g_mean", "g_std", "g_mean_change")])


@query(f"""{WITH}, m AS (SELECT *, avg(target) OVER (PARTITION BY time_id) AS mt FROM panel)
SELECT time_id, asset_id, {r('sqrt(avg((target - mt) * (target - mt)) OVER (PARTITION BY time_id))')} AS cross_rms, {r('abs(mt - f1)')} AS disagreement, count(*) OVER (PARTITION BY time_id) AS coverage, (time_id % 10)::BIGINT AS phase FROM m""")
def cross_state_vector(spark, sf_dir):
    df = cross.split_market(_ship(spark, sf_dir), "target")
    return _out(cross.state_vector(df, "cross", "market", "f1", "f2"), "cross_rms", "disagreement", "coverage", "phase")


@query(f"{WITH} SELECT time_id, list(target ORDER BY asset_id) AS values FROM panel GROUP BY time_id")
def cross_ragged_lists(spark, sf_dir):
    return cross.ragged_lists(_ship(spark, sf_dir), "target")


@query(f"""{WITH} SELECT time_id, asset_id, {', '.join(f"coalesce(lag(target, {k}) OVER ({ASSET}), 0) AS lag{k}" for k in (1, 2, 3, 5, 10))},
  target - coalesce(lag(target) OVER ({ASSET}), 0) AS difference,
  target - 2 * coalesce(lag(target) OVER ({ASSET}), 0) + coalesce(lag(target, 2) OVER ({ASSET}), 0) AS acceleration,
  coalesce(time_id - lag(time_id) OVER ({ASSET}), 0) AS gap FROM panel""")
def temporal_lags(spark, sf_dir):
    return _ship(spark, sf_dir).select(*KEYS, *[temporal.lag("target", k).alias(f"lag{k}") for k in (1, 2, 3, 5, 10)], temporal.difference("target").alias("difference"), temporal.acceleration("target").alias("acceleration"), temporal.gap().alias("gap"))


@query(f"""{WITH}, s AS (SELECT *, coalesce({over('avg(f0)', -5, -1)}, 0.0::DOUBLE) AS m5, coalesce({over('stddev_pop(f0)', -5, -1)}, 0.0::DOUBLE) AS s5, {over('avg(f0)', -4, 0)} AS m5i, coalesce({over('avg(f0)', -512, -1)}, 0.0::DOUBLE) AS m512 FROM panel)
SELECT time_id, asset_id, {r('m5')} AS mean5, {r('f0 - m5')} AS deviation5, {r('m5i')} AS inclusive5, {r('s5')} AS std5, {r('(f0 - m5) / greatest(s5, 0.001)')} AS zscore5, {r('m512')} AS mean512 FROM s""")
def temporal_rolling(spark, sf_dir):
    df = temporal.with_long_mean(_ship(spark, sf_dir), "f0", 512, "mean512")
    df = df.withColumns({"mean5": temporal.mean_before("f0", 5), "deviation5": temporal.deviation_before("f0", 5), "inclusive5": temporal.mean_inclusive("f0", 5), "std5": temporal.std_before("f0", 5)}).withColumn("zscore5", temporal.zscore(F.col("deviation5"), F.col("std5")))
    return _out(df, "mean5", "deviation5", "inclusive5", "std5", "zscore5", "mean512")


def _slope_sql(rows: int) -> str:
    c, x, y, xx, xy = (over(a, -rows, -1) for a in ("count(f0)", "sum(n)", "sum(f0)", "sum(n * n)", "sum(n * f0)"))
    return f"CASE WHEN {c} < 2 THEN 0 ELSE ({c} * {xy} - {x} * {y}) / ({c} * {xx} - {x} * {x}) END"


@query(f"""{WITH}, s AS (SELECT *, (row_number() OVER ({ASSET}))::DOUBLE AS n FROM panel)
SELECT time_id, asset_id, {r(_slope_sql(5))} AS slope5, {r(_slope_sql(20))} AS slope20 FROM s""")
def temporal_slopes(spark, sf_dir):
    df = temporal.with_slope(temporal.with_slope(_ship(spark, sf_dir), "f0", 5, "slope5"), "f0", 20, "slope20")
    return _out(df, "slope5", "slope20")


def _ema_sql(span: int) -> str:
    keep = 1 - 2 / (span + 1)
    lags = [f"lag(f0, {k}) OVER ({ASSET})" for k in range(1, 21)]
    top = " + ".join(f"coalesce({x}, 0) * {keep**k!r}::DOUBLE" for k, x in enumerate(lags))
    total = " + ".join(f"CASE WHEN {x} IS NULL THEN 0 ELSE {keep**k!r}::DOUBLE END" for k, x in enumerate(lags))
    return f"coalesce(({top}) / nullif({total}, 0), 0)"


@query(f"{WITH} SELECT time_id, asset_id, {r(_ema_sql(3))} AS ema3, {r(_ema_sql(10))} AS ema10 FROM panel")
def temporal_ema(spark, sf_dir):
    return _out(_ship(spark, sf_dir).withColumns({"ema3": temporal.ema_before("f0", 3), "ema10": temporal.ema_before("f0", 10)}), "ema3", "ema10")


@query(f"""{WITH} SELECT time_id, asset_id, coalesce(list_reverse({over('list(f0)', -5, -1)}), []) AS past FROM panel""")
def temporal_lag_cache(spark, sf_dir):
    return _ship(spark, sf_dir).select(*KEYS, temporal.lag_cache("f0", 5).alias("past"))


@query(f"""{WITH}, s AS (SELECT *, row_number() OVER ({ASSET}) AS n, {over('avg(f0)', -30, -1, 'RANGE')} AS inside, {over('avg(f0)', 'start', -1)} AS ever, {over('max(f0)', -7, -7, 'RANGE')} AS step7 FROM panel),
t AS (SELECT *, coalesce(inside, CASE WHEN n = 1 THEN f0 ELSE 0 END) AS slow FROM s)
SELECT time_id, asset_id, {r('slow')} AS slow, {r('coalesce(ever, f0)')} AS expanding, step7, {r('least(greatest(0.9 * (0.5 * slow + 1.25 * (f0 - slow)), -40), 40)')} AS recombined FROM t""")
def temporal_trailing(spark, sf_dir):
    df = _ship(spark, sf_dir).withColumns({"slow": temporal.mean_by_steps("f0", 30), "expanding": temporal.expanding_mean("f0"), "step7": temporal.step_lag("f0", 7)})
    df = df.withColumn("recombined", temporal.recombine(F.col("f0"), F.col("slow"), 0.5, 1.25, 0.9, 40.0))
    return df.select(*KEYS, q(F.col("slow")).alias("slow"), q(F.col("expanding")).alias("expanding"), "step7", q(F.col("recombined")).alias("recombined"))


@query(f"""{WITH}, dev AS (SELECT time_id, asset_id, f0 - avg(f0) OVER (PARTITION BY time_id) AS x FROM panel),
s AS (SELECT *, coalesce({over('avg(x)', -5, -1)}, 0.0::DOUBLE) AS m FROM dev)
SELECT time_id, asset_id, {r(f'coalesce(lag(x) OVER ({ASSET}), 0)')} AS lag1_dev, {r('m')} AS mean5_dev, {r('x - m')} AS deviation5_dev FROM s""")
def temporal_of_deviation(spark, sf_dir):
    df = cross.demean(_ship(spark, sf_dir), ["f0"]).withColumnRenamed("f0_dev", "dev")
    return _out(temporal.temporal_features(df, ["dev"]), "lag1_dev", "mean5_dev", "deviation5_dev")


@query(f"""{WITH}, m AS (SELECT time_id, avg(target) AS x FROM panel GROUP BY time_id)
SELECT time_id, {r('coalesce(max(x) OVER (ORDER BY time_id RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING), 0)')} AS lag1, {r('coalesce(max(x) OVER (ORDER BY time_id RANGE BETWEEN 3 PRECEDING AND 3 PRECEDING), 0)')} AS lag3,
  {r('CASE WHEN count(x) OVER (ORDER BY time_id RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING) = 5 THEN avg(x) OVER (ORDER BY time_id RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING) ELSE 0 END')} AS mean5 FROM m""")
def temporal_market_lags(spark, sf_dir):
    market = cross.group_means(_ship(spark, sf_dir), ["target"])
    return temporal.market_lags(market, "target", [1, 3], [5]).select("time_id", *[q(F.col(c)).alias(c) for c in ("lag1", "lag3", "mean5")])


@query(f"""{WITH_EVENTS}, spine AS (SELECT * FROM (SELECT DISTINCT time_id FROM panel) CROSS JOIN (SELECT unnest(range(15))::BIGINT AS asset_id)),
seen AS (SELECT s.time_id, s.asset_id, last_value(p.f0 IGNORE NULLS) OVER (PARTITION BY s.asset_id ORDER BY s.time_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS v FROM spine s LEFT JOIN panel p USING (time_id, asset_id))
SELECT time_id, {', '.join(f'max(v) FILTER (asset_id = {a}) AS a{a}' for a in range(15))} FROM seen GROUP BY time_id""")
def temporal_latest_snapshot(spark, sf_dir):
    return temporal.latest_snapshot(panels.event_panel(spark, sf_dir), "f0", range(15))


@query(f"""{WITH}, placed AS (SELECT *, dense_rank() OVER (ORDER BY time_id) AS k FROM panel)
SELECT a.time_id, a.asset_id, coalesce(b.f0, 0) AS partner_lag FROM placed a LEFT JOIN placed b ON b.k = a.k - 1 AND b.asset_id = (a.asset_id + 1) % 15""")
def temporal_partner_lag(spark, sf_dir):
    return temporal.partner_lag(_ship(spark, sf_dir), "f0", {a: (a + 1) % 15 for a in range(15)}).select(*KEYS, "partner_lag")


@query(f"""{WITH}, lags AS (SELECT unnest([1, 2, 5, 10])::INT AS lag)
SELECT lag, count(*) AS pairs, {r('corr(a.f0, b.f0)')} AS correlation FROM panel a CROSS JOIN lags JOIN panel b ON b.asset_id = a.asset_id AND b.time_id = a.time_id - lag GROUP BY lag""")
def temporal_autocorrelation(spark, sf_dir):
    return temporal.autocorrelation(_ship(spark, sf_dir), "f0", [1, 2, 5, 10]).withColumn("correlation", q(F.col("correlation")))


@query(f"""{WITH}, lags AS (SELECT unnest([1, 2, 5, 10])::INT AS lag),
c AS (SELECT lag, corr(a.f0, b.f0) AS correlation FROM panel a CROSS JOIN lags JOIN panel b ON b.asset_id = a.asset_id AND b.time_id = a.time_id - lag GROUP BY lag),
w AS (SELECT unnest([1, 3, 8])::INT AS width)
SELECT width, {r('sqrt(avg(power(correlation - greatest(width - lag, 0)::DOUBLE / width, 2)))')} AS rmse FROM c CROSS JOIN w GROUP BY width""")
def temporal_window_fit(spark, sf_dir):
    profile = temporal.autocorrelation(_ship(spark, sf_dir), "f0", [1, 2, 5, 10])
    return temporal.moving_average_window(profile, [1, 3, 8]).withColumn("rmse", q(F.col("rmse")))


