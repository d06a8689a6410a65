"""Queries of paired arms, gates, ladders of missing values, and panels and events read as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import q
from ..operators import arms, design, infer, joins, metrics, models, temporal
from ..operators.split import Fold
from ..sources import audit, footers, panels, tables
from ..streaming import panel as streams
from ..streaming import sequential
from .registry import query
from .sql import ASSET, PREDICTED, WITH, r

KEYS = ("time_id", "asset_id")
FOLDS = (Fold(0, -1000, 199, 230, 599), Fold(1, -600, 599, 630, 999))
ARMS = (arms.Arm("base", ("f0",)), arms.Arm("again", ("f0",)), arms.Arm("both", ("f0", "f1")))


def _q(df, *columns):
    return df.withColumns({c: q(F.col(c)) for c in columns})


def _predicted(spark, sf_dir):
    return panels.ship_panel(spark, sf_dir).withColumn("prediction", temporal.mean_before("target", 5))


_RANGES = "fold(fold, a, b, lo, hi) AS (VALUES " + ", ".join(f"({f.fold}, {f.train_low}, {f.train_high}, {f.valid_low}, {f.valid_high})" for f in FOLDS) + ")"
_SUMS = ", ".join(f"sum(weight{''.join(' * ' + c for c in p)}) AS {n}" for n, p in {"w": (), "x": ("f0",), "z": ("f1",), "y": ("target",), "xx": ("f0", "f0"), "xz": ("f0", "f1"), "zz": ("f1", "f1"), "xy": ("f0", "target"), "zy": ("f1", "target")}.items())
#: Ridges of the folds in closed form, one with f0 and one with f0 and f1.
_FITS = f"""{_RANGES}, s AS (SELECT fold, {_SUMS} FROM panel JOIN fold ON time_id BETWEEN a AND b GROUP BY fold),
c AS (SELECT *, xx - x * x / w + 100 AS a, xz - x * z / w AS b, zz - z * z / w + 100 AS c, xy - x * y / w AS p, zy - z * y / w AS q FROM s),
k AS (SELECT fold, p / a AS one, (y - p / a * x) / w AS one_0, (p * c - q * b) / (a * c - b * b) AS b0, (q * a - p * b) / (a * c - b * b) AS b1, (y - (p * c - q * b) / (a * c - b * b) * x - (q * a - p * b) / (a * c - b * b) * z) / w AS both_0 FROM c)"""
_RUNS = f"""{_FITS}, v AS (SELECT panel.*, fold, one_0 + one * f0 AS base, both_0 + b0 * f0 + b1 * f1 AS pair FROM panel JOIN fold ON time_id BETWEEN lo AND hi JOIN k USING (fold)),
runs AS ({' UNION ALL '.join(f"SELECT fold, '{n}' AS arm, count(*) AS n, sum(weight * target * target) AS d, sum(weight * target * {c}) AS v, sum(weight * {c} * {c}) AS g FROM v GROUP BY fold" for n, c in (("base", "base"), ("again", "base"), ("both", "pair")))})"""


@query(f"{WITH}, {_RUNS} SELECT fold, arm, n, {r('v / d')} AS a, {r('g / d')} AS b, {r('v * v / (g * d)')} AS peak FROM runs")
def model_paired_arms(spark, sf_dir):
    runs = arms.run_arms(panels.ship_panel(spark, sf_dir), FOLDS, ARMS)
    return runs.select("fold", "arm", "n", q(F.col("v") / F.col("d")).alias("a"), q(F.col("g") / F.col("d")).alias("b"), q(arms.peak("v", "g")).alias("peak"))


@query(f"{WITH}, {_FITS} SELECT time_id, asset_id, coalesce(fold, -1) AS fold, {r('both_0 + b0 * f0 + b1 * f1')} AS prediction FROM panel LEFT JOIN fold ON time_id BETWEEN lo AND hi LEFT JOIN k USING (fold)")
def model_out_of_fold_rows(spark, sf_dir):
    return _q(arms.out_of_fold(panels.ship_panel(spark, sf_dir), FOLDS, ARMS[2]).select(*KEYS, "fold", "prediction"), "prediction")


_BLOCKS = f"""{PREDICTED}, blocks AS (SELECT (time_id // 400)::BIGINT AS block, sum(weight * target * target) AS d, sum(weight * target * f1) AS vb, sum(weight * f1 * f1) AS gb, sum(weight * target * prediction) AS va, sum(weight * prediction * prediction) AS ga FROM predicted WHERE time_id >= 0 GROUP BY 1)"""


def _pairs(spark, sf_dir):
    w, y = F.col("weight"), F.col("target")

    def sums(name, x):
        return [F.sum(w * y * F.col(x)).alias(f"v_{name}"), F.sum(w * F.col(x) ** 2).alias(f"g_{name}"), F.count("*").alias(f"n_{name}")]

    df = _predicted(spark, sf_dir).filter("time_id >= 0")
    return df.groupBy(F.expr("time_id div 400").alias("block")).agg(F.sum(w * y * y).alias("d"), *sums("base", "f1"), *sums("arm", "prediction"))


@query(f"""{WITH}, {_BLOCKS}, rel AS (SELECT *, (va * va / (ga * d)) / (vb * vb / (gb * d)) - 1 AS relative FROM blocks),
o AS (SELECT count(*) AS n_blocks, avg(relative) AS block_mean, count(*) FILTER (relative > 0) AS positive, (sum(relative) - max(relative)) / (count(*) - 1) AS without_best, sum(va) * sum(va) / sum(ga) / (sum(vb) * sum(vb) / sum(gb)) - 1 AS pooled, sum(va) / sum(vb) - 1 AS delta_a, sum(ga) / sum(gb) - 1 AS delta_b FROM rel),
t AS (SELECT *, block_mean > 0 AS mean_positive, positive >= 3 AS enough_positive, without_best > 0 AS positive_without_best, block_mean >= 0.005 AS gain_enough, 2 * delta_a > delta_b AS alignment_over_energy, true AS interval_positive, NULL::BOOLEAN AS above_floor FROM o)
SELECT n_blocks, {r('block_mean')} AS block_mean, positive, {r('without_best')} AS without_best, {r('pooled')} AS pooled, {r('delta_a')} AS delta_a, {r('delta_b')} AS delta_b, mean_positive, enough_positive, positive_without_best, gain_enough, alignment_over_energy, interval_positive, above_floor,
  CASE WHEN mean_positive AND enough_positive AND positive_without_best AND gain_enough AND alignment_over_energy THEN 'PENDING_CALIBRATION' ELSE 'FAIL' END AS verdict FROM t""")
def infer_seven_gates(spark, sf_dir):
    return _q(arms.seven_gates(_pairs(spark, sf_dir), 3, 0.005, low=0.01), "block_mean", "without_best", "pooled", "delta_a", "delta_b")


@query(f"""{WITH}, {PREDICTED}, c AS (SELECT (time_id // 400)::BIGINT AS fold, (time_id // 50)::BIGINT AS chunk, sum(weight * target * (prediction - f1)) AS gain, sum(weight * target * target) AS d FROM predicted WHERE time_id >= 0 GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY chunk) - 1 AS spot, count(*) OVER (PARTITION BY fold) AS n FROM c),
draws AS (SELECT fold, replicate, ('0x' || substr(md5('7:' || replicate || ':' || fold || ':' || spot), 1, 8))::BIGINT % n AS spot FROM p, (SELECT unnest(range(200)) AS replicate)),
s AS (SELECT replicate, sum(gain) / sum(d) AS gain FROM draws JOIN p USING (fold, spot) GROUP BY replicate)
SELECT {r('quantile_cont(gain, 0.025)')} AS low, {r('quantile_cont(gain, 0.975)')} AS high, {r('avg((gain > 0)::INT)')} AS positive FROM s""")
def infer_stratified_bootstrap(spark, sf_dir):
    w, y = F.col("weight"), F.col("target")
    chunks = _predicted(spark, sf_dir).filter("time_id >= 0").groupBy(F.expr("time_id div 400").alias("fold"), F.expr("time_id div 50").alias("chunk")).agg(F.sum(w * y * (F.col("prediction") - F.col("f1"))).alias("gain"), F.sum(w * y * y).alias("d"))
    return _q(arms.stratified_bootstrap(chunks, 200, 7), "low", "high", "positive")


_INTERVAL = f"""c AS (SELECT (time_id // 400)::BIGINT AS fold, (time_id // 50)::BIGINT AS chunk, sum(weight * target * (prediction - f1)) AS gain, sum(weight * target * target) AS d FROM predicted GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY chunk) - 1 AS spot, count(*) OVER (PARTITION BY fold) AS n FROM c),
draws AS (SELECT fold, replicate, ('0x' || substr(md5('7:' || replicate || ':' || fold || ':' || spot), 1, 8))::BIGINT % n AS spot FROM p, (SELECT unnest(range(200)) AS replicate)),
s AS (SELECT replicate, sum(gain) / sum(d) AS gain FROM draws JOIN p USING (fold, spot) GROUP BY replicate), i AS (SELECT quantile_cont(gain, 0.025) AS low, quantile_cont(gain, 0.975) AS high FROM s)"""


@query(f"""{WITH}, {_BLOCKS.replace(' WHERE time_id >= 0', '')}, {_INTERVAL}, rel AS (SELECT *, (va * va / (ga * d)) / (vb * vb / (gb * d)) - 1 AS relative FROM blocks),
o AS (SELECT avg(relative) AS block_mean, count(*) FILTER (relative > 0) AS positive, (sum(relative) - max(relative)) / (count(*) - 1) AS without_best, sum(va) / sum(vb) - 1 AS delta_a, sum(ga) / sum(gb) - 1 AS delta_b FROM rel),
t AS (SELECT block_mean > 0 AND positive >= 3 AND without_best > 0 AND block_mean >= 0.005 AND 2 * delta_a > delta_b AS others, low > 0 AS interval_positive, block_mean >= abs(high - low) / 2 AS above_floor, low, high FROM o, i)
SELECT {r('low')} AS low, {r('high')} AS high, interval_positive, above_floor, CASE WHEN others AND interval_positive AND above_floor THEN 'PASS' ELSE 'FAIL' END AS verdict FROM t""")
def infer_gates_by_bootstrap(spark, sf_dir):
    """The seven gates, with the interval and the floor of a bootstrap within folds, over all times."""
    w, y = F.col("weight"), F.col("target")
    chunks = _predicted(spark, sf_dir).groupBy(F.floor(F.col("time_id") / 400).alias("fold"), F.floor(F.col("time_id") / 50).alias("chunk")).agg(F.sum(w * y * (F.col("prediction") - F.col("f1"))).alias("gain"), F.sum(w * y * y).alias("d"))
    interval = arms.stratified_bootstrap(chunks, 200, 7).first()
    low, high = interval["low"], interval["high"]
    pairs = _predicted(spark, sf_dir).groupBy(F.floor(F.col("time_id") / 400).alias("block")).agg(F.sum(w * y * y).alias("d"), *[x for name, p in (("base", "f1"), ("arm", "prediction")) for x in (F.sum(w * y * F.col(p)).alias(f"v_{name}"), F.sum(w * F.col(p) ** 2).alias(f"g_{name}"), F.count("*").alias(f"n_{name}"))])
    gates = arms.seven_gates(pairs, 3, 0.005, low=low, floor=infer.detection_floor(low, high))
    return gates.select(q(F.lit(low)).alias("low"), q(F.lit(high)).alias("high"), "interval_positive", "above_floor", "verdict")


@query(f"{WITH} SELECT asset_id, {r('avg(f1)', 0)} AS score, (asset_id % 3)::DOUBLE AS regularisation, count(*) AS iterations FROM panel GROUP BY asset_id ORDER BY score DESC, regularisation DESC, iterations LIMIT 1")
def metric_pick_best(spark, sf_dir):
    per = panels.ship_panel(spark, sf_dir).groupBy("asset_id").agg(q(F.avg("f1"), 0).alias("score"), F.count("*").alias("iterations"))
    return metrics.pick_best(per.withColumn("regularisation", F.pmod("asset_id", F.lit(3)).cast("double"))).select("asset_id", "score", "regularisation", "iterations")


@query(f"{WITH} SELECT time_id, asset_id, target FROM panel WHERE time_id < 100 OR time_id >= 900")
def join_union_partitions(spark, sf_dir):
    df = panels.ship_panel(spark, sf_dir).select(*KEYS, "target")
    return joins.union_partitions([df.filter("time_id < 100"), df.filter("time_id >= 900")])


#: Columns of four families with their numbers of missing values; two of them end in the same ladder, two in none.
_MISSING = [("a", 0, 9), ("a", 1, 1), ("a", 2, 0), ("a", 3, 4), ("a", 4, 16), ("b", 5, 0), ("b", 6, 4), ("b", 7, 16), ("c", 8, 5), ("c", 9, 5), ("d", 10, 0)]


@query(f"""WITH m(family, place, n) AS (VALUES {', '.join(map(str, _MISSING))}), b AS (SELECT *, coalesce(n <= lag(n) OVER w, false) AS falls FROM m WINDOW w AS (PARTITION BY family ORDER BY place)),
s AS (SELECT *, coalesce(bool_or(falls) OVER (PARTITION BY family ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) AS before FROM b),
f AS (SELECT family, coalesce(string_agg(n::VARCHAR, ',' ORDER BY place) FILTER (NOT before AND n > 0), '') AS rungs FROM s GROUP BY family)
SELECT rungs, list(family ORDER BY family) AS families FROM f GROUP BY rungs""")
def audit_shared_ladders(spark, sf_dir):
    return audit.shared_ladders(spark.createDataFrame(_MISSING, "family string, index int, null_count long"))


# --- streams


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, sum(floor(value)::BIGINT)::BIGINT AS total FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL '1 hour', max(ts)) + INTERVAL '70 minutes' <= (SELECT max(ts) FROM events)")
def stream_closed_windows(spark, sf_dir):
    schema = panels.table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return streams.replay(streams.event_windows(events), tables.scratch(spark, "windows"))


@query(f"""{WITH}, dev AS (SELECT time_id, asset_id, f0 - avg(f0) OVER (PARTITION BY time_id) AS dev FROM panel WHERE time_id >= 0)
SELECT * FROM (SELECT time_id, asset_id, {r('dev')} AS dev, {r('coalesce(lag(dev) OVER w, 0)')} AS lag1, {r('coalesce(avg(dev) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0)')} AS mean,
  {r('coalesce(avg(dev) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0)')} AS long_mean,
  {r('coalesce(avg(dev) OVER (w RANGE BETWEEN 10 PRECEDING AND 1 PRECEDING), CASE WHEN row_number() OVER w = 1 THEN dev ELSE 0 END)')} AS slow FROM dev WINDOW w AS ({ASSET})) WHERE time_id < (SELECT max(time_id) FROM panel)""")
def stream_online_features(spark, sf_dir):
    folder = tables.scratch(spark, "online")
    df = panels.ship_panel(spark, sf_dir).filter("time_id >= 0").select(*KEYS, "f0")
    df.write.parquet(f"{folder}/panel")
    out = streams.replay(streams.online_features(spark.readStream.schema(df.schema).parquet(f"{folder}/panel"), "f0"), folder)
    return out.select(*KEYS, *[q(F.col(c)).alias(c) for c in ("dev", "lag1", "mean", "long_mean", "slow")])


@query("""SELECT 'l_orderkey' AS column, count(*) AS rows, count(*) - count(l_orderkey) AS missing, min(l_orderkey)::DOUBLE AS least, max(l_orderkey)::DOUBLE AS largest FROM lineitem
UNION ALL SELECT 'l_quantity', count(*), count(*) - count(l_quantity), min(l_quantity)::DOUBLE, max(l_quantity)::DOUBLE FROM lineitem""")
def scan_footer_profile(spark, sf_dir):
    return footers.footer_profile(spark, [f"{sf_dir}/lineitem.parquet"], ["l_orderkey", "l_quantity"])


_RESUMED = """Tree=0
num_leaves=3
split_feature=0 2
threshold=100.5 10.5
decision_type=2 2
left_child=1 -1
right_child=-3 -2
leaf_value=0.5 -0.25 2.0

Tree=1
num_leaves=2
split_feature=3
threshold=1.5
decision_type=2
left_child=-1
right_child=-2
leaf_value=1.0 -1.0
"""


@query(f"""{WITH}, f AS (SELECT time_id, asset_id, coalesce(lag(f0) OVER w, 0) AS lag1, coalesce(avg(f0) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0) AS mean, f0 - coalesce(avg(f0) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0) AS deviation, coalesce(time_id - lag(time_id) OVER w, 0) AS gap FROM panel WINDOW w AS ({ASSET}))
SELECT time_id - 1500 AS time_id, asset_id, {r('lag1')} AS lag1, {r('mean')} AS mean, {r('deviation')} AS deviation, gap::DOUBLE AS gap,
  CASE WHEN lag1 <= 100.5 THEN CASE WHEN deviation <= 10.5 THEN 0.5 ELSE -0.25 END ELSE 2.0 END + CASE WHEN gap <= 1.5 THEN 1.0 ELSE -1.0 END AS prediction FROM f WHERE time_id > 1200""")
def stream_resumed_predictions(spark, sf_dir):
    """The batch ends at time 1200 and saves its state; two runs of a stream predict the rest, several micro-batches each. Times are moved so that many are below 0."""
    df = panels.ship_panel(spark, sf_dir).select(*KEYS, "f0").withColumn("time_id", F.col("time_id") - 1500)
    folder = tables.scratch(spark, "resumed")
    design.saved_state(df.filter("time_id <= -300"), ["f0"], 20).write.parquet(f"{folder}/state")
    forest = models.Forest(models.parse_forest(_RESUMED))
    processor = sequential.Predictor(["f0"], 20, sequential.recent_features, sequential.RECENT, forest)
    out = None
    for low, high in ((-300, -100), (-100, 200), (200, 700), (700, 100_000)):
        df.filter((F.col("time_id") > low) & (F.col("time_id") <= high)).coalesce(1).write.mode("append").parquet(f"{folder}/panel")
        if low in (-100, 700):  # the second call goes on from the first one's checkpoint
            out = sequential.predict_files(spark, f"{folder}/panel", df.schema, f"{folder}/state", processor, folder)
    return out.select(*KEYS, *[q(F.col(c)).alias(c) for c in ("lag1", "mean", "deviation")], "gap", "prediction")
