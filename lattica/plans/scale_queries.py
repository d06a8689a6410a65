"""Queries of operators that number, add up and fingerprint whole tables without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import q
from ..operators import exact, merkle, ranks, split, temporal
from ..sources import panels
from .registry import query
from .sql import WITH, r

KEYS = ("time_id", "asset_id")


@query(f"""{WITH}, o AS (SELECT time_id, asset_id, f0, row_number() OVER (ORDER BY time_id, asset_id) - 1 AS k, count(*) OVER () AS n FROM panel),
places AS (SELECT DISTINCT round_even(i * (n - 1) / 99.0::DOUBLE, 0)::BIGINT AS k FROM (SELECT unnest(range(100)) AS i), (SELECT max(n) AS n FROM o))
SELECT time_id, asset_id, f0 FROM o JOIN places USING (k)""")
def sample_evenly_spaced(spark, sf_dir):
    return split.evenly_spaced(panels.ship_panel(spark, sf_dir), 100).select(*KEYS, "f0")


@query(f"{WITH}, t AS (SELECT time_id, count(*) AS rows FROM panel GROUP BY time_id) SELECT time_id, rows, row_number() OVER (ORDER BY time_id) - 1 AS place FROM t")
def fold_distinct_times(spark, sf_dir):
    return split.distinct_times(panels.ship_panel(spark, sf_dir))


@query(f"{WITH}, e AS (SELECT DISTINCT floor(epoch(ts) / 86400)::BIGINT % 2500 AS time_id FROM events) SELECT time_id, asset_id, f0 FROM panel WHERE time_id IN (SELECT time_id FROM e)")
def join_keep_times(spark, sf_dir):
    """Rows of the panel at the days, modulo 2,500, that have events."""
    days = panels.table(spark, sf_dir, "events").select(F.pmod(F.floor(F.unix_timestamp("ts") / 86400), F.lit(2500)).alias("time_id"))
    return split.keep_times(panels.ship_panel(spark, sf_dir), days).select(*KEYS, "f0")


@query(f"""{WITH}, q AS (SELECT time_id % 5 AS phase, unnest(['f0', 'f1', 'weight']) AS feature, unnest([quantile_cont(f0, [0.005, 0.25, 0.5, 0.9]), quantile_cont(f1, [0.005, 0.25, 0.5, 0.9]), quantile_cont(weight, [0.005, 0.25, 0.5, 0.9])]) AS q FROM panel GROUP BY 1)
SELECT phase, feature, {r('q[1]')} AS low, {r('q[2]')} AS quarter, {r('q[3]')} AS middle, {r('q[4]')} AS high FROM q""")
def metric_radix_quantiles(spark, sf_dir):
    df = panels.ship_panel(spark, sf_dir).withColumn("phase", F.pmod("time_id", F.lit(5)))
    found = ranks.quantiles(df, ["f0", "f1", "weight"], [0.005, 0.25, 0.5, 0.9], by="phase")
    rows = spark.createDataFrame([(*key, *v) for key, v in found.items()], "phase long, feature string, low double, quarter double, middle double, high double")
    return rows.select("phase", "feature", *[q(F.col(c)).alias(c) for c in ("low", "quarter", "middle", "high")])


@query(f"""{WITH}, t AS (SELECT time_id AS node, count(*) AS rows, sha256(string_agg(target::BIGINT::VARCHAR, ',' ORDER BY asset_id)) AS d FROM panel GROUP BY time_id),
u AS (SELECT floor(node / 64.0)::BIGINT AS node, sum(rows)::BIGINT AS rows, sha256(string_agg(d, ',' ORDER BY t.node)) AS d FROM t GROUP BY 1),
top AS (SELECT 0::BIGINT AS node, sum(rows)::BIGINT AS rows, sha256(string_agg(d, ',' ORDER BY u.node)) AS d FROM u)
SELECT 0 AS level, node, rows, d FROM t UNION ALL SELECT 1, node, rows, d FROM u UNION ALL SELECT 2, node, rows, d FROM top""")
def metric_merkle_fingerprint(spark, sf_dir):
    """All levels of the tree over the panel's targets."""
    levels = merkle.tree(panels.ship_panel(spark, sf_dir), F.col("target").cast("long"))
    out = None
    for k, level in enumerate(levels):
        own = level.select(F.lit(k).alias("level"), "node", "rows", "d")
        out = own if out is None else out.unionByName(own)
    return out


@query(f"{WITH} SELECT DISTINCT time_id FROM panel WHERE target >= 12 AND asset_id = 3")
def metric_merkle_changes(spark, sf_dir):
    """Times at which a copy of the panel, in which some targets are cut, differs from it: found from the two trees."""
    df = panels.ship_panel(spark, sf_dir).withColumn("target", F.col("target").cast("long"))
    cut = df.withColumn("target", F.when((F.col("asset_id") == 3) & (F.col("target") >= 12), F.col("target") - 1).otherwise(F.col("target")))
    return merkle.changed(merkle.tree(df, "target"), merkle.tree(cut.repartition(5), "target")).select(F.col("node").alias("time_id"))


@query(f"""{WITH}, s AS (SELECT sum(weight) AS w, sum(weight * x) AS x, sum(weight * f1) AS z, sum(weight * target) AS y, sum(weight * x * x) AS xx, sum(weight * x * f1) AS xz, sum(weight * f1 * f1) AS zz, sum(weight * x * target) AS xy, sum(weight * f1 * target) AS zy FROM (SELECT *, f0 / 7 AS x FROM panel)),
c AS (SELECT *, xx - x * x / w + 100 AS a, xz - x * z / w AS b, zz - z * z / w + 100 AS c, xy - x * y / w AS p, zy - z * y / w AS q FROM s),
k AS (SELECT *, (p * c - q * b) / (a * c - b * b) AS b0, (q * a - p * b) / (a * c - b * b) AS b1 FROM c)
SELECT unnest([1, 3, 8])::INT AS partitions, {r('(y - b0 * x - b1 * z) / w')} AS intercept, {r('b0')} AS x, {r('b1')} AS f1, 0.0::DOUBLE AS difference FROM k""")
def linear_reruns(spark, sf_dir):
    """One ridge fitted under 1, 3 and 8 partitions; difference is the largest to the first, not rounded."""
    df = panels.ship_panel(spark, sf_dir).withColumn("x", F.col("f0") / 7)
    runs = exact.rerun(df, ["x", "f1"], "target", "weight", 100.0, [1, 3, 8])
    rows = [(n, float(m.intercept[0]), float(m.weights[0, 0]), float(m.weights[1, 0]), exact.largest_difference(m, runs[0][1])) for n, m in runs]
    out = spark.createDataFrame(rows, "partitions int, intercept double, x double, f1 double, difference double")
    return out.select("partitions", *[q(F.col(c)).alias(c) for c in ("intercept", "x", "f1")], "difference")


@query(f"""{WITH} SELECT time_id, asset_id, {r('coalesce(avg(f0) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0)')} AS mean5, {r('coalesce(max(f0) OVER (w RANGE BETWEEN 10 PRECEDING AND 10 PRECEDING), 0)')} AS then10,
  {r('coalesce(avg(f0) OVER (w RANGE BETWEEN 20 PRECEDING AND 1 PRECEDING), 0)')} AS month FROM panel WINDOW w AS (PARTITION BY asset_id ORDER BY time_id)""")
def temporal_sliced(spark, sf_dir):
    """Bounded windows worked out in slices of time, 15 assets in many more tasks than 15."""
    return temporal.sliced(
        panels.ship_panel(spark, sf_dir).select(*KEYS, "f0"), 250, 20, rows_back=5,
        columns=lambda by: {
            "mean5": q(F.coalesce(F.avg("f0").over(by.rowsBetween(-5, -1)), F.lit(0.0))),
            "then10": q(F.coalesce(F.max("f0").over(by.rangeBetween(-10, -10)), F.lit(0.0))),
            "month": q(F.coalesce(F.avg("f0").over(by.rangeBetween(-20, -1)), F.lit(0.0))),
        },
    ).select(*KEYS, "mean5", "then10", "month")
