"""Queries of splits, joins, metrics, statistics and inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import q
from ..operators import cross, infer, joins, metrics, split, temporal
from ..sources import audit, panels
from .registry import query
from .sql import MOMENTS, PREDICTED, SCORE, WITH, r

KEYS = ("time_id", "asset_id")


def _predicted(spark, sf_dir):
    return panels.ship_panel(spark, sf_dir).withColumn("prediction", temporal.mean_before("target", 5))


def _rounded(df, *columns):
    return df.withColumns({c: q(F.col(c)) for c in columns})


# --- folds and blocks


@query(f"""{WITH}, t AS (SELECT time_id, row_number() OVER (ORDER BY time_id) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT time_id FROM panel)),
f AS (SELECT fold, 600 + 30 + fold * ((n - 630) // 4) AS first, CASE WHEN fold = 3 THEN n - 1 ELSE 600 + 30 + (fold + 1) * ((n - 630) // 4) - 1 END AS last FROM (SELECT unnest(range(4))::INT AS fold), (SELECT max(n) AS n FROM t))
SELECT fold, CASE WHEN k >= first THEN 'valid' ELSE 'train' END AS role, count(*) AS rows, min(time_id) AS low, max(time_id) AS high
FROM panel JOIN t USING (time_id) JOIN f ON (k BETWEEN first AND last) OR (k BETWEEN first - 630 AND first - 31) GROUP BY 1, 2""")
def fold_assignment(spark, sf_dir):
    df = panels.ship_panel(spark, sf_dir)
    folds = split.rolling_folds_of(df, 4, 600, 30)
    return split.assign_folds(df, folds).groupBy("fold", "role").agg(F.count("*").alias("rows"), F.min("time_id").alias("low"), F.max("time_id").alias("high"))


@query(f"""{WITH}, t AS (SELECT time_id, row_number() OVER (ORDER BY time_id DESC) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT time_id FROM panel)),
b AS (SELECT time_id, -1 AS block FROM t WHERE k <= ceil(n * 0.15) UNION ALL SELECT time_id, (ntile(5) OVER (ORDER BY time_id) - 1)::INT FROM t WHERE k > ceil(n * 0.15)),
p AS (SELECT *, row_number() OVER (ORDER BY time_id) AS p FROM b), e AS (SELECT min(p) AS low, max(p) AS high FROM p WHERE block = 2)
SELECT time_id, block, CASE WHEN block = -1 THEN 'holdout' WHEN block = 2 THEN 'valid' WHEN p BETWEEN low - 20 AND high + 20 THEN 'purged' ELSE 'train' END AS role FROM p, e""")
def fold_purged(spark, sf_dir):
    return split.purge(split.purged_blocks(panels.ship_panel(spark, sf_dir), 5), 2, 20)


@query(f"""{WITH}, b AS (SELECT min(time_id) AS low, max(time_id) AS high FROM panel),
e AS (SELECT quantile_cont(time_id::DOUBLE, [0.25, 0.5, 0.75]) AS e FROM panel)
SELECT least((time_id - low) // ((high - low + 1) // 7), 6)::INT AS block, ((time_id >= e[1])::INT + (time_id >= e[2])::INT + (time_id >= e[3])::INT)::INT AS segment, count(*) AS rows FROM panel, b, e GROUP BY 1, 2""")
def fold_blocks(spark, sf_dir):
    df = panels.ship_panel(spark, sf_dir)
    low, high = df.agg(F.min("time_id"), F.max("time_id")).first()
    return split.quantile_segments(df.withColumn("block", split.equal_blocks(low, high, 7)), 4).groupBy("block", "segment").agg(F.count("*").alias("rows"))


# --- joins


@query("SELECT l.l_orderkey, l.l_linenumber, o.o_custkey FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey")
def join_covered(spark, sf_dir):
    lines = panels.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    orders = panels.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return joins.join_covered(lines, orders, "l_orderkey")


@query("SELECT c_custkey, c_nationkey, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def join_one_to_one(spark, sf_dir):
    nations = panels.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return joins.join_one_to_one(panels.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), nations, "c_nationkey")


@query(f"{WITH} SELECT count(*) AS rows, {r('sum(f0)')} AS total FROM panel WHERE asset_id < 12")
def join_drift(spark, sf_dir):
    df = panels.ship_panel(spark, sf_dir)
    both = joins.join_with_drift(df, df.filter("asset_id < 12").select(*KEYS, "target", "weight"), ["target", "weight"])
    return both.agg(F.count("*").alias("rows"), q(F.sum("f0")).alias("total"))


@query(f"{WITH} SELECT time_id, asset_id, target, 'left' AS side FROM panel WHERE time_id % 50 = 0 UNION ALL SELECT time_id, asset_id, target + 1, 'right' FROM panel WHERE time_id % 50 = 0")
def join_same_rows(spark, sf_dir):
    df = panels.ship_panel(spark, sf_dir).select(*KEYS, "target")
    other = df.withColumn("target", F.when(F.col("time_id") % 50 == 0, F.col("target") + 1).otherwise(F.col("target")))
    return joins.same_rows(df, other, [*KEYS, "target"])


@query("""SELECT count(*) FILTER (o_orderkey % 7 = 0) AS only_left, 0::BIGINT AS only_right, 0::BIGINT AS differs_o_custkey, count(*) FILTER (o_orderkey % 7 <> 0 AND o_orderkey % 5 = 0) AS differs_o_totalprice FROM orders""")
def join_compare_columns(spark, sf_dir):
    orders = panels.table(spark, sf_dir, "orders")
    other = orders.filter("o_orderkey % 7 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return joins.compare_columns(orders, other, "o_orderkey", ["o_custkey", "o_totalprice"])


@query("""SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'removed' WHEN c_custkey % 10 = 1 THEN 'added' WHEN c_custkey % 10 = 2 THEN 'modified' ELSE 'same' END AS status FROM customer""")
def join_snapshot_diff(spark, sf_dir):
    c = panels.table(spark, sf_dir, "customer")
    new = c.filter("c_custkey % 10 <> 0").withColumn("c_nationkey", F.when(F.col("c_custkey") % 10 == 2, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")))
    return joins.snapshot_diff(c.filter("c_custkey % 10 <> 1"), new, "c_custkey", ["c_nationkey", "c_name"])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def join_missing(spark, sf_dir):
    returned = panels.table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.missing(panels.table(spark, sf_dir, "orders").select("o_orderkey"), returned, ["o_orderkey"])


# --- metrics


@query(f"{WITH}, {PREDICTED}, s AS (SELECT count(*) AS n, {MOMENTS} FROM predicted) SELECT n, {r('d')} AS d, {SCORE}, {r('v / g')} AS best_scale FROM s")
def metric_score(spark, sf_dir):
    return _rounded(metrics.score(_predicted(spark, sf_dir)), "d", "a", "b", "peak", "score", "best_scale")


@query(f"""{WITH}, {PREDICTED}, x AS (SELECT 'asset_id' AS label, asset_id::VARCHAR AS value, * FROM predicted UNION ALL SELECT 'phase', (time_id % 10)::VARCHAR, * FROM predicted),
s AS (SELECT label, value, count(*) AS n, {MOMENTS} FROM x GROUP BY 1, 2) SELECT label, value, n, {SCORE} FROM s""")
def metric_score_rollup(spark, sf_dir):
    df = _predicted(spark, sf_dir).withColumn("phase", F.pmod("time_id", F.lit(10)))
    return _rounded(metrics.score_rollup(df, ["asset_id", "phase"]), "a", "b", "peak", "score").select("label", "value", "n", "a", "b", "peak", "score")


@query(f"""{WITH}, {PREDICTED} SELECT asset_id, count(*) AS n, {r('sqrt(avg(target * target))')} AS rms_target, {r('sqrt(avg(prediction * prediction))')} AS rms_prediction, {r('avg(prediction - target)')} AS bias,
  {r('(2 * sum(weight * target * prediction) - sum(weight * prediction * prediction)) / sum(weight * target * target)')} AS score FROM predicted GROUP BY asset_id""")
def metric_breakdown(spark, sf_dir):
    return _rounded(metrics.breakdown(_predicted(spark, sf_dir), ["asset_id"]), "rms_target", "rms_prediction", "bias", "score")


@query(f"{WITH}, {PREDICTED} SELECT asset_id, {r('least(greatest(sum(weight * target * prediction) / greatest(sum(weight * prediction * prediction), 1e-30), 0), 2)')} AS scale FROM predicted GROUP BY asset_id")
def metric_best_scale(spark, sf_dir):
    return _rounded(metrics.best_scale(_predicted(spark, sf_dir), ["asset_id"]), "scale")


@query(f"""{WITH}, {PREDICTED}, m AS (SELECT *, sum(weight * target) OVER w / sum(weight) OVER w AS tm, sum(weight * prediction) OVER w / sum(weight) OVER w AS pm FROM predicted WINDOW w AS (PARTITION BY time_id)),
s AS (SELECT sum(weight * tm * tm) AS dm, sum(weight * tm * pm) AS vm, sum(weight * pm * pm) AS gm, sum(weight * power(target - tm, 2)) AS dc, sum(weight * (target - tm) * (prediction - pm)) AS vc, sum(weight * power(prediction - pm, 2)) AS gc FROM m)
SELECT {r('dm / (dm + dc)')} AS share_market, {r('dc / (dm + dc)')} AS share_cross, {r('(2 * vm - gm) / (dm + dc)')} AS score_market, {r('(2 * vc - gc) / (dm + dc)')} AS score_cross FROM s""")
def metric_market_cross(spark, sf_dir):
    return _rounded(metrics.market_cross_score(_predicted(spark, sf_dir)), "share_market", "share_cross", "score_market", "score_cross")


@query(f"""{WITH}, {PREDICTED}, s AS (SELECT asset_id, {MOMENTS} FROM predicted GROUP BY asset_id),
c AS (SELECT asset_id, (sum(2 * v - g) OVER () - (2 * v - g)) / (sum(d) OVER () - d) AS without, (2 * v - g) / sum(d) OVER () AS contribution FROM s)
SELECT asset_id, {r('without')} AS without, {r('contribution')} AS contribution, row_number() OVER (ORDER BY contribution DESC, asset_id)::INT AS rank, {r('sum(contribution) OVER (ORDER BY contribution DESC, asset_id)')} AS running FROM c""")
def metric_leave_one_out(spark, sf_dir):
    return _rounded(metrics.leave_one_out(_predicted(spark, sf_dir)), "without", "contribution", "running")


@query(f"""{WITH}, {PREDICTED} SELECT time_id, {r('sum(weight * target * target)')} AS d, {r('sum(weight * target * prediction)')} AS v_0, {r('sum(weight * target * f1)')} AS v_1, {r('sum(weight * prediction * prediction)')} AS g_0_0, {r('sum(weight * prediction * f1)')} AS g_0_1, {r('sum(weight * f1 * f1)')} AS g_1_1 FROM predicted GROUP BY time_id""")
def metric_cube(spark, sf_dir):
    return _rounded(metrics.cube(_predicted(spark, sf_dir), ["prediction", "f1"]), "d", "v_0", "v_1", "g_0_0", "g_0_1", "g_1_1")


@query(f"""{WITH}, {PREDICTED}, s AS (SELECT (time_id // 500)::BIGINT AS fold, {MOMENTS} FROM predicted GROUP BY 1)
SELECT fold, {r('coalesce(sum(v) OVER (ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)')} AS before_v, {r('sum(v) OVER () - v')} AS others_v FROM s""")
def metric_earlier_folds(spark, sf_dir):
    folds = _predicted(spark, sf_dir).groupBy(F.floor(F.col("time_id") / 500).cast("long").alias("fold")).agg(*metrics.moments())
    return metrics.earlier_folds(folds, ["v"]).select("fold", q(F.col("before_v")).alias("before_v"), q(F.col("others_v")).alias("others_v"))


@query(f"""{WITH}, c AS (SELECT unnest([{{'feature': 'f0', 'position': 0, 'correlation': c0}}, {{'feature': 'f1', 'position': 1, 'correlation': c1}}, {{'feature': 'f2', 'position': 2, 'correlation': c2}}], recursive := true) FROM
  (SELECT {', '.join(f'(sum(weight) * sum(weight * {f} * target) - sum(weight * {f}) * sum(weight * target)) / sqrt((sum(weight) * sum(weight * {f} * {f}) - power(sum(weight * {f}), 2)) * (sum(weight) * sum(weight * target * target) - power(sum(weight * target), 2))) AS c{k}' for k, f in enumerate(('f0', 'f1', 'f2')))} FROM panel))
SELECT feature, position, {r('correlation')} AS correlation FROM c QUALIFY row_number() OVER (ORDER BY abs(correlation) DESC, position DESC) <= 2""")
def metric_screen(spark, sf_dir):
    return _rounded(metrics.screen(panels.ship_panel(spark, sf_dir), ["f0", "f1", "f2"], 2), "correlation")


@query(f"""{WITH}, x AS (UNPIVOT (SELECT f0, f1 FROM panel) ON f0, f1 INTO NAME feature VALUE v)
SELECT feature, {r('quantile_cont(v, 0.001)')} AS low, {r('quantile_cont(v, 0.999)')} AS high, {r('quantile_cont(v, 0.5)')} AS centre, {r('greatest(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 1e-4)')} AS scale FROM x GROUP BY feature""")
def metric_fit_robust(spark, sf_dir):
    return _rounded(metrics.fit_robust(panels.ship_panel(spark, sf_dir), ["f0", "f1"]), "low", "high", "centre", "scale")


@query(f"""{WITH} SELECT 'f0' AS feature, 1.0::DOUBLE AS finite, min(f0) AS least, max(f0) AS largest, true AS usable FROM panel UNION ALL SELECT 'one', 1.0, 1.0, 1.0, false""")
def metric_column_health(spark, sf_dir):
    return metrics.column_health(panels.ship_panel(spark, sf_dir).withColumn("one", F.lit(1.0)), ["f0", "one"])


@query(f"""{WITH}, m AS (SELECT sum(weight * f0) / sum(weight) AS m, sum(weight * f0 * f0) / sum(weight) AS s FROM panel)
SELECT time_id, asset_id, {r('(f0 - m) / sqrt(s - m * m)')} AS f0 FROM panel, m""")
def metric_standardise_weighted(spark, sf_dir):
    return _rounded(metrics.standardise_weighted(panels.ship_panel(spark, sf_dir), ["f0"]), "f0").select(*KEYS, "f0")


@query(f"""{WITH}, k AS (SELECT asset_id, rank() OVER (PARTITION BY asset_id ORDER BY f0) + (count(*) OVER (PARTITION BY asset_id, f0) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY asset_id ORDER BY target) + (count(*) OVER (PARTITION BY asset_id, target) - 1) / 2.0::DOUBLE AS b FROM panel)
SELECT asset_id, count(*) AS n, {r('corr(a, b)')} AS spearman FROM k GROUP BY asset_id""")
def metric_spearman(spark, sf_dir):
    return _rounded(metrics.spearman(panels.ship_panel(spark, sf_dir), "f0", "target", "asset_id"), "spearman")


@query(f"{WITH} SELECT x.asset_id AS a, y.asset_id AS b, count(*) AS n, {r('corr(x.target, y.target)')} AS correlation FROM panel x JOIN panel y ON x.time_id = y.time_id AND x.asset_id < y.asset_id GROUP BY 1, 2")
def metric_pairwise_correlation(spark, sf_dir):
    return _rounded(metrics.pairwise_correlation(panels.ship_panel(spark, sf_dir), "target"), "correlation")


@query(f"{WITH}, {PREDICTED} SELECT count(*) AS n, {r('avg(prediction)')} AS mean, {r('avg(prediction * prediction)')} AS mean_square, {r('stddev_pop(prediction)')} AS std, {r('max(abs(prediction))')} AS largest, 0::BIGINT AS not_finite, count(*) FILTER (abs(prediction) >= 20 - 1e-12) AS hits FROM predicted")
def metric_fingerprint(spark, sf_dir):
    df = _predicted(spark, sf_dir)
    return _rounded(metrics.fingerprint(df, "time_id", "prediction").drop("hash").crossJoin(metrics.clip_hits(df, "prediction", 20)), "mean", "mean_square", "std", "largest")


@query(f"{WITH}, {PREDICTED} SELECT {r('avg(prediction * prediction)')} AS prediction__prediction, {r('avg(prediction * f1)')} AS prediction__f1, {r('avg(f1 * f1)')} AS f1__f1 FROM predicted")
def metric_prediction_gram(spark, sf_dir):
    return _rounded(metrics.prediction_gram(_predicted(spark, sf_dir), ["prediction", "f1"]), "prediction__prediction", "prediction__f1", "f1__f1")


@query(f"{WITH}, {PREDICTED}, s AS (SELECT time_id, avg(target - prediction) AS m, sum(power(target - prediction, 2)) AS s, count(*) AS n FROM predicted GROUP BY time_id) SELECT time_id, {r('m * m + (s - n * m * m)', 4)} AS energy FROM s ORDER BY m * m + (s - n * m * m) DESC, time_id LIMIT 50")
def metric_worst_times(spark, sf_dir):
    return metrics.worst_times(_predicted(spark, sf_dir)).withColumn("energy", q(F.col("energy"), 4))


@query(f"{WITH}, {PREDICTED} SELECT count(*) AS n, {r('stddev_pop(prediction)')} AS std_left, {r('stddev_pop(f1)')} AS std_right, {r('corr(prediction, f1)')} AS correlation, {r('max(abs(prediction - f1))')} AS largest_difference FROM predicted")
def metric_compare_predictions(spark, sf_dir):
    df = _predicted(spark, sf_dir).withColumn("row_id", F.col("time_id") * 15 + F.col("asset_id"))
    return _rounded(metrics.compare_predictions(df, df.select("row_id", F.col("f1").alias("prediction"))), "std_left", "std_right", "correlation", "largest_difference")


# --- inference

_FOLDS = f"""{WITH}, {PREDICTED}, folds AS (SELECT (time_id // 300)::BIGINT AS fold, sum(weight * target * target) AS d, sum(weight * target * f1) / sum(weight * target * target) AS base, sum(weight * target * prediction) / sum(weight * target * target) AS arm FROM predicted GROUP BY 1)"""


def _folds(spark, sf_dir):
    w, y = F.col("weight"), F.col("target")
    d = F.sum(w * y * y)
    return _predicted(spark, sf_dir).groupBy(F.floor(F.col("time_id") / 300).cast("long").alias("fold")).agg(d.alias("d"), (F.sum(w * y * F.col("f1")) / d).alias("base"), (F.sum(w * y * F.col("prediction")) / d).alias("arm"))


@query(f"{_FOLDS} SELECT count(*) AS folds, {r('avg(arm - base)')} AS mean_difference, {r('avg(arm - base) / avg(base)')} AS relative, count(*) FILTER (arm > base) AS positive, {r('(sum(arm - base) - max(arm - base)) / (count(*) - 1)')} AS without_best FROM folds")
def infer_paired_summary(spark, sf_dir):
    return _rounded(infer.paired_summary(_folds(spark, sf_dir)), "mean_difference", "relative", "without_best")


@query(f"{_FOLDS} SELECT count(*) AS n, {r('avg(base)')} AS mean, {r('stddev_samp(base)')} AS std, {r('stddev_samp(base) / sqrt(count(*))')} AS se, {r('min(base)')} AS least, {r('max(base)')} AS largest FROM folds")
def infer_summary(spark, sf_dir):
    return _rounded(infer.summary(_folds(spark, sf_dir), "base"), "mean", "std", "se", "least", "largest")


@query(f"{_FOLDS} SELECT {r('sum((arm - base) * d) / sum(d)')} AS pooled, {r('corr(base, arm - base)')} AS correlation FROM folds")
def infer_pooled(spark, sf_dir):
    folds = _folds(spark, sf_dir)
    pooled = infer.pooled_by_energy(folds.withColumn("difference", F.col("arm") - F.col("base")))
    return _rounded(pooled.crossJoin(infer.gain_to_strength(folds)), "pooled", "correlation")


@query(f"{WITH}, {PREDICTED}, c AS (SELECT time_id, {MOMENTS} FROM predicted GROUP BY time_id) SELECT time_id, row_number() OVER (ORDER BY time_id)::INT AS place, {r('sum(d) OVER (ORDER BY time_id)', 3)} AS d, {r('sum(v) OVER (ORDER BY time_id)', 3)} AS v FROM c")
def infer_prefix_sums(spark, sf_dir):
    sums = infer.prefix_sums(_predicted(spark, sf_dir).groupBy("time_id").agg(*metrics.moments()), ["d", "v"])
    return sums.withColumns({c: q(F.col(c), 3) for c in ("d", "v")})


@query(f"{WITH}, {PREDICTED}, s AS (SELECT time_id % 10 AS phase, {MOMENTS} FROM predicted GROUP BY 1) SELECT {r('stddev_pop(v / g)')} AS spread FROM s")
def infer_phase_spread(spark, sf_dir):
    phases = _predicted(spark, sf_dir).groupBy(F.pmod("time_id", F.lit(10)).alias("phase")).agg(*metrics.moments())
    return _rounded(infer.phase_spread(phases), "spread")


# --- audit


@query("SELECT count(*) AS rows, count(*) FILTER (o_orderkey IS NULL) AS missing, 0::BIGINT AS unknown, 0::BIGINT AS repeated, 0::BIGINT AS not_finite, count(*) FILTER (abs(o_totalprice) >= 400000 - 1e-12) AS clipped FROM orders")
def audit_submission(spark, sf_dir):
    orders = panels.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("target"))
    return audit.check_submission(orders, orders, 400000.0)


@query("SELECT a, b FROM (VALUES (1), (2), (3)) x(a), (VALUES ('p'), ('q')) y(b)")
def audit_parameter_grid(spark, sf_dir):
    return audit.parameter_grid(spark, {"a": [1, 2, 3], "b": ["p", "q"]})


@query(f"""{WITH}, v AS (SELECT *, target - avg(target) OVER (PARTITION BY time_id) AS target_dev FROM panel),
p AS (SELECT unnest(['f0', 'f1', 'target', 'target_dev']) AS name, unnest([0, 1, 2, 3]) AS place, unnest([min(f0), min(f1), min(target), min(target_dev)]) AS least, unnest([max(f0), max(f1), max(target), max(target_dev)]) AS largest FROM v),
s AS (SELECT *, CASE WHEN least >= 0 THEN 'positive' WHEN largest <= 0 THEN 'negative' ELSE 'both' END AS sign FROM p),
n AS (SELECT *, coalesce((sign <> lag(sign) OVER (ORDER BY place))::INT, 1) AS new FROM s)
SELECT name, place::INT AS "index", sign, (sum(new) OVER (ORDER BY place))::BIGINT AS family, false AS ladder FROM n""")
def audit_column_families(spark, sf_dir):
    profile = cross.demean(panels.ship_panel(spark, sf_dir), ["target", "f0"]).agg(*[F.struct(F.lit(k).alias("index"), F.lit(c).alias("name"), F.count_if(F.col(c).isNull()).alias("null_count"), F.min(c).alias("least"), F.max(c).alias("largest")).alias(c) for k, c in enumerate(("f0", "f1", "target", "target_dev"))])
    tall = profile.select(F.explode(F.array("f0", "f1", "target", "target_dev")).alias("x")).select("x.*")
    return audit.column_families(tall)
