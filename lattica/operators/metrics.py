"""Scores and sufficient statistics; everything is a sum, so partial aggregation does the work."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clip, finite, positive_weight, ratio
from . import ranks


def _strict(x: Column, what: str) -> Column:
    return F.when(finite(x).isNull(), F.raise_error(F.lit(f"{what} is not finite")).cast("double")).otherwise(x)


def moments(target: str = "target", prediction: str = "prediction", weight: str = "weight") -> list[Column]:
    """d = sum w y^2, v = sum w y p, g = sum w p^2, with negative weights as 0. Values that aren't finite are an error."""
    y, p, w = _strict(F.col(target), target), _strict(F.col(prediction), prediction), F.greatest(_strict(F.col(weight), weight), F.lit(0.0))
    return [F.sum(w * y * y).alias("d"), F.sum(w * y * p).alias("v"), F.sum(w * p * p).alias("g")]


def score_columns(d: str = "d", v: str = "v", g: str = "g") -> list[Column]:
    """From moments: r2 = 1 - sum w (y - p)^2 / d (0 if d <= 0), a = v / d, b = g / d, peak = a^2 / b, best_scale = a / b, score = 2 a - b."""
    dd, vv, gg = F.col(d), F.col(v), F.col(g)
    good = dd > 0
    a, b = F.when(good, ratio(vv, dd)).otherwise(0.0), F.when(good, ratio(gg, dd)).otherwise(0.0)
    return [a.alias("a"), b.alias("b"), F.coalesce(ratio(a * a, b), F.lit(0.0)).alias("peak"), ratio(a, b).alias("best_scale"), (2 * a - b).alias("score")]


def score(df: DataFrame, by: Sequence[str] = (), target: str = "target", prediction: str = "prediction", weight: str = "weight") -> DataFrame:
    """Weighted zero-mean R2 (score, which equals 2a - b) and its parts, of all rows or per label."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *moments(target, prediction, weight)).select(*by, "n", "d", *score_columns())


def score_rollup(df: DataFrame, labels: Sequence[str], **columns: str) -> DataFrame:
    """score() for several label sets at once: rows (label, value) for each value of each label, from one pass. Sums are taken per combination of labels first, and only these rows are multiplied."""
    sets = F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).cast("string").alias("value")) for c in labels]))
    per = df.groupBy(*labels).agg(F.count("*").alias("_n"), *[m.alias(f"_{c}") for c, m in zip("dvg", moments(**columns))])
    whole = per.select(sets.alias("_s"), "_n", "_d", "_v", "_g").groupBy(F.col("_s.label").alias("label"), F.col("_s.value").alias("value"))
    return whole.agg(F.sum("_n").alias("n"), *[F.sum(f"_{c}").alias(c) for c in "dvg"]).select("label", "value", "n", "d", *score_columns())


def breakdown(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """RMS of target and prediction, bias, and score per label."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("target") ** 2)).alias("rms_target"), F.sqrt(F.avg(F.col("prediction") ** 2)).alias("rms_prediction"), F.avg(F.col("prediction") - F.col("target")).alias("bias"), *moments()).withColumn("score", F.when(F.col("d") > 0, ratio(2 * F.col("v") - F.col("g"), F.col("d"))).otherwise(0.0)).drop("d", "v", "g")


def best_scale(df: DataFrame, by: Sequence[str] = (), low: float = 0.0, high: float = 2.0) -> DataFrame:
    return df.groupBy(*by).agg(*moments()).select(*by, clip(F.col("v") / F.greatest("g", F.lit(1e-30)), low, high).alias("scale"))


def market_cross_score(df: DataFrame) -> DataFrame:
    """The score in its market part (weighted mean of each time) and the rest; shares of the energy sum to 1, parts of the score to the whole."""
    by_time = Window.partitionBy("time_id")
    w = positive_weight(F.col("weight"))
    total = F.sum(w).over(by_time)
    parts = df.withColumn("_w", w).withColumns({f"_{c}m": ratio(F.sum(w * F.col(c)).over(by_time), total) for c in ("target", "prediction")}).filter("_w > 0")
    parts = parts.withColumns({f"_{c}c": F.col(c) - F.col(f"_{c}m") for c in ("target", "prediction")})
    sums = [F.sum(F.col("_w") * F.col(f"_target{k}") * F.col(f"_{c}{k}")).alias(f"{n}{k}") for k in "mc" for c, n in (("target", "d"), ("prediction", "v"))] + [F.sum(F.col("_w") * F.col(f"_prediction{k}") ** 2).alias(f"g{k}") for k in "mc"]
    d = F.col("dm") + F.col("dc")
    return parts.agg(*sums).select(*[ratio(F.col(f"d{k}"), d).alias(f"share_{n}") for k, n in (("m", "market"), ("c", "cross"))], *[ratio(2 * F.col(f"v{k}") - F.col(f"g{k}"), d).alias(f"score_{n}") for k, n in (("m", "market"), ("c", "cross"))])


def leave_one_out(df: DataFrame, key: str = "asset_id") -> DataFrame:
    """Per asset: the score without it, its contribution (v2 = 2v - g over all d), rank by contribution and cumulative share."""
    per = df.groupBy(key).agg(*moments())
    every = Window.partitionBy(F.lit(0))
    gain = 2 * F.col("v") - F.col("g")
    out = per.withColumns({"_d": F.sum("d").over(every), "_g": F.sum(gain).over(every)})
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("contribution"), key)
    return out.select(key, ratio(F.col("_g") - gain, F.col("_d") - F.col("d")).alias("without"), ratio(gain, F.col("_d")).alias("contribution")).withColumn("rank", F.row_number().over(order)).withColumn("running", F.sum("contribution").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def cube(df: DataFrame, predictions: Sequence[str], keys: Sequence[str] = ("time_id",), target: str = "target", weight: str = "weight") -> DataFrame:
    """One row per key with d, v_i and g_i_j for all pairs of predictions: what any later blend or block can be scored from."""
    w = positive_weight(F.col(weight))
    sums = [F.sum(w * F.col(target) ** 2).alias("d")]
    for i, a in enumerate(predictions):
        sums.append(F.sum(w * F.col(target) * F.col(a)).alias(f"v_{i}"))
        sums += [F.sum(w * F.col(a) * F.col(predictions[j])).alias(f"g_{i}_{j}") for j in range(i, len(predictions))]
    return df.groupBy(*keys).agg(*sums)


def earlier_folds(folds: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sums of the columns over all folds before each one, as before_*, and over all others, as others_*."""
    order = Window.orderBy("fold")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return folds.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(before), F.lit(0.0)) for c in columns} | {f"others_{c}": F.sum(c).over(every) - F.col(c) for c in columns})


def weighted_correlation(x: Column, y: Column, w: Column) -> Column:
    """Correlation as an aggregate over rows where both are finite; NULL if either has no variance."""
    good = finite(x).isNotNull() & finite(y).isNotNull()
    w = F.when(good, positive_weight(w))
    n = F.sum(w)
    mx, my = F.sum(w * x), F.sum(w * y)
    vx, vy = n * F.sum(w * x * x) - mx * mx, n * F.sum(w * y * y) - my * my
    return F.when((vx > 0) & (vy > 0), (n * F.sum(w * x * y) - mx * my) / F.sqrt(vx * vy))


def screen(df: DataFrame, features: Sequence[str], k: int, target: str = "target", weight: str = "weight") -> DataFrame:
    """The k features of largest |correlation| with the target (a feature without variance has 0): feature, position, correlation, in order of position."""
    k = max(1, min(k, len(features)))
    row = df.agg(*[F.coalesce(weighted_correlation(F.col(f), F.col(target), F.col(weight)), F.lit(0.0)).alias(f) for f in features])
    tall = row.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(i).alias("position"), F.col(f).alias("correlation")) for i, f in enumerate(features)])).alias("x")).select("x.*")
    order = Window.orderBy(F.desc(F.abs("correlation")), F.desc("position"))
    return tall.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r").orderBy("position")


def fit_robust(df: DataFrame, columns: Sequence[str], tails: float = 0.001) -> DataFrame:
    """Per column: low, high (outer quantiles), centre (median) and scale (q75 - q25, at least 1e-4), of finite values, linear between them; NULL, and the least scale, for a column without any."""
    found = ranks.quantiles(df, columns, [tails, 0.25, 0.5, 0.75, 1 - tails])
    figures = {c: found.get((None, c)) for c in columns}
    rows = [(c, None, None, None, 1e-4) if v is None else (c, v[0], v[4], v[2], max(v[3] - v[1], 1e-4)) for c, v in figures.items()]
    return df.sparkSession.createDataFrame(rows, "feature string, low double, high double, centre double, scale double")


def column_health(df: DataFrame, columns: Sequence[str], least_finite: float = 0.01) -> DataFrame:
    """Per column: share of finite values, least and largest, and whether it can be used (enough of them, not constant)."""
    row = df.agg(*[F.struct(F.avg(finite(F.col(c)).isNotNull().cast("double")).alias("finite"), F.min(finite(F.col(c))).alias("least"), F.max(finite(F.col(c))).alias("largest")).alias(c) for c in columns])
    tall = row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("s")) for c in columns])).alias("x"))
    return tall.select("x.feature", "x.s.finite", "x.s.least", "x.s.largest", ((F.col("x.s.finite") >= least_finite) & (F.col("x.s.least") < F.col("x.s.largest"))).alias("usable"))


def standardise_weighted(df: DataFrame, columns: Sequence[str], weight: str = "weight", floor: float = 1e-6) -> DataFrame:
    """(x - weighted mean) / weighted deviation over all rows; missing values have the mean, so 0. The moments are one row, broadcast."""
    w = positive_weight(F.col(weight))
    aggs = []
    for c in columns:
        good = finite(F.col(c)).isNotNull()
        n = F.sum(F.when(good, w))
        m = ratio(F.sum(F.when(good, w * F.col(c))), n)
        aggs += [m.alias(f"_m_{c}"), F.sqrt(F.greatest(ratio(F.sum(F.when(good, w * F.col(c) ** 2)), n) - m * m, F.lit(0.0))).alias(f"_s_{c}")]
    fitted = F.broadcast(df.agg(*aggs))
    return df.crossJoin(fitted).withColumns({c: F.coalesce((finite(F.col(c)) - F.col(f"_m_{c}")) / F.greatest(f"_s_{c}", F.lit(floor)), F.lit(0.0)) for c in columns}).drop(*[f"_{k}_{c}" for c in columns for k in "ms"])


def spearman(df: DataFrame, a: str, b: str, by: str) -> DataFrame:
    """Correlation of average ranks per value of `by`, over rows where both are finite."""
    good = df.filter(finite(F.col(a)).isNotNull() & finite(F.col(b)).isNotNull())

    def average_rank(c: str) -> Column:
        return F.rank().over(Window.partitionBy(by).orderBy(c)) + (F.count("*").over(Window.partitionBy(by, c)) - 1) / 2.0

    return good.withColumns({"_ra": average_rank(a), "_rb": average_rank(b)}).groupBy(by).agg(F.count("*").alias("n"), F.corr("_ra", "_rb").alias("spearman"))


def pairwise_correlation(df: DataFrame, column: str) -> DataFrame:
    """Correlation of each pair of assets over the times that both have: a, b, n, correlation. Pairs per time are bounded by the number of assets."""
    x = df.select("time_id", F.col("asset_id").alias("a"), F.col(column).alias("x"))
    y = df.select("time_id", F.col("asset_id").alias("b"), F.col(column).alias("y"))
    return x.join(y, "time_id").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.corr("x", "y").alias("correlation"))


def fingerprint(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, mean square, deviation, largest |value|, values that aren't finite, and an order-free hash of (key, value)."""
    v = F.col(value)
    return df.agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.avg(v * v).alias("mean_square"), F.stddev_pop(v).alias("std"), F.max(F.abs(v)).alias("largest"), F.count_if(finite(v).isNull()).alias("not_finite"), F.sum(F.xxhash64(key, value).cast("decimal(38,0)")).alias("hash"))


def prediction_gram(a: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean products of all pairs of prediction columns."""
    return a.agg(*[F.avg(F.col(x) * F.col(y)).alias(f"{x}__{y}") for i, x in enumerate(columns) for y in columns[i:]])


def clip_hits(df: DataFrame, prediction: str, most: float) -> DataFrame:
    return df.agg(F.count_if(F.abs(F.col(prediction)) >= most - 1e-12).alias("hits"))


def worst_times(df: DataFrame, n: int = 50) -> DataFrame:
    """The times of largest squared market residual plus cross energy of the residual."""
    r = F.col("target") - F.col("prediction")
    per = df.groupBy("time_id").agg(F.avg(r).alias("_m"), F.sum(r * r).alias("_s"), F.count("*").alias("_n"))
    energy = F.col("_m") ** 2 + (F.col("_s") - F.col("_n") * F.col("_m") ** 2)
    return per.select("time_id", energy.alias("energy")).orderBy(F.desc("energy"), "time_id").limit(n)


def pick_best(candidates: DataFrame) -> DataFrame:
    """The candidate of the best score, then the stronger regularisation, then fewer iterations."""
    return candidates.orderBy(F.desc("score"), F.desc("regularisation"), "iterations").limit(1)


def compare_predictions(a: DataFrame, b: DataFrame, key: str = "row_id", column: str = "prediction") -> DataFrame:
    both = a.select(key, F.col(column).alias("x")).join(b.select(key, F.col(column).alias("y")), key)
    return both.agg(F.count("*").alias("n"), F.stddev_pop("x").alias("std_left"), F.stddev_pop("y").alias("std_right"), F.corr("x", "y").alias("correlation"), F.max(F.abs(F.col("x") - F.col("y"))).alias("largest_difference"))


def weighted_pairs(df: DataFrame, columns: Sequence[str], weight: str = "weight") -> DataFrame:
    """Weighted correlation of each pair of columns over the rows where both are finite: a, b, total weight, correlation (NULL without variance).

    Each task sends one row per pair, with the sums over its rows.
    """
    names = list(columns)
    low, high = np.triu_indices(len(names), 1)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names], axis=1)
            w = np.nan_to_num(batch.column(weight).to_numpy(zero_copy_only=False).astype(float), posinf=0.0)
            good = np.isfinite(x)
            there, x = good.astype(float), np.where(good, x, 0.0)
            wx, w = np.maximum(w, 0)[:, None] * x, np.maximum(w, 0)[:, None] * there
            # products of (weight, x, x^2) of one column with (there, x) of the other
            sums = np.stack([(w.T @ there)[low, high], (wx.T @ there)[low, high], (there.T @ wx)[low, high], ((wx * x).T @ there)[low, high], (there.T @ (wx * x))[low, high], (wx.T @ x)[low, high]])
            total = sums if total is None else total + sums
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), *map(pa.array, total)], ["i", "j", "w", "x", "y", "xx", "yy", "xy"])

    sums = df.select(*[F.col(c).cast("double").alias(c) for c in names], F.col(weight).cast("double").alias(weight)).mapInArrow(partial, "i int, j int, w double, x double, y double, xx double, yy double, xy double")
    s = sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("w", "x", "y", "xx", "yy", "xy")])
    vx, vy = F.col("w") * F.col("xx") - F.col("x") ** 2, F.col("w") * F.col("yy") - F.col("y") ** 2
    named = F.array(*map(F.lit, names))
    return s.select(F.get(named, "i").alias("a"), F.get(named, "j").alias("b"), F.col("w").alias("weight"), F.when((vx > 0) & (vy > 0), (F.col("w") * F.col("xy") - F.col("x") * F.col("y")) / F.sqrt(vx * vy)).alias("correlation"))


def label_profile(profile: DataFrame, base: str, k: int) -> DataFrame:
    """Features by how they agree with a ladder of labels. profile: rows (feature, label, correlation).

    Per feature its consistency (mean signed correlation over labels), its places by |correlation| with the base label
    and by |consistency| (1 is the best, ties by name), and whether it is among the best k of each.
    """
    per = profile.groupBy("feature").agg(F.avg("correlation").alias("consistency"), F.max(F.when(F.col("label") == base, F.col("correlation"))).alias("base"))
    places = per.withColumns({f"{c}_rank": F.row_number().over(Window.orderBy(F.desc(F.abs(c)), "feature")) for c in ("base", "consistency")})
    return places.withColumns({f"{c}_top": F.col(f"{c}_rank") <= k for c in ("base", "consistency")})


def same_selection(profile: DataFrame, chosen: DataFrame, k: int, column: str = "base_rank") -> DataFrame:
    """profile as it is; an error unless its best k features by a rank are exactly those of another selection (a column feature)."""
    mine = profile.filter(F.col(column) <= k).select("feature", F.lit(True).alias("_mine"))
    odd = mine.join(chosen.select("feature", F.lit(True).alias("_theirs")), "feature", "full").filter("_mine is null or _theirs is null")
    names = [r["feature"] for r in odd.select("feature").orderBy("feature").limit(20).collect()]
    if names:
        raise ValueError(f"the selections differ in {names}")
    return profile


def churn(profile: DataFrame, k: int) -> DataFrame:
    """Features that only one of the two selections of label_profile() takes: feature, side ("in" or "out" of the one by consistency), rank by the base label, and how far that is from k."""
    moved = profile.filter((F.col("base_rank") <= k) != (F.col("consistency_rank") <= k))
    return moved.select("feature", F.when(F.col("consistency_rank") <= k, "in").otherwise("out").alias("side"), "base_rank", (F.col("base_rank") - k).alias("from_cut"))


def label_correlations(df: DataFrame, features: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Correlation of each feature with each label, from one Gram matrix: feature, label, correlation (0 without variance). Missing values count as 0."""
    from . import linear

    g = linear.gram(df, list(features), list(labels))
    m = linear.correlation_matrix(linear.Gram(g.products, [*g.x, *g.y], []))
    n = len(g.x)
    return df.sparkSession.createDataFrame([(f, y, float(m[i, n + j])) for i, f in enumerate(g.x) for j, y in enumerate(g.y)], "feature string, label string, correlation double")


def ordered_fingerprint(df: DataFrame, value: str, by: str = "time_id", then: str = "asset_id") -> DataFrame:
    """SHA-256 that depends on the order of the rows: of the digests of all `by`, each of which is that of its values in order of `then`. Values are taken as text."""
    text = F.col(value).cast("string")
    lists = df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(then, text.alias("v")))).alias("x"))
    each = lists.select(by, F.sha2(F.array_join(F.transform("x", lambda x: x["v"]), ",", "null"), 256).alias("d"))
    return each.agg(F.count("*").alias("groups"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, "d"))), lambda x: x["d"]), ","), 256).alias("sha256"))


def block_scores(df: DataFrame, blocks: Sequence[tuple[str, int, int]]) -> DataFrame:
    """The score of each named block of times (both ends included); a block without rows is an error."""
    name = F.coalesce(*[F.when(F.col("time_id").between(low, high), b) for b, low, high in blocks])
    found = score(df.withColumn("block", name).filter("block is not null"), ["block"])
    wanted = F.broadcast(df.sparkSession.createDataFrame([(b,) for b, _, _ in blocks], "block string"))
    empty = F.raise_error(F.concat(F.lit("no rows in block "), F.col("block"))).cast("double")
    return wanted.join(found, "block", "left").withColumn("score", F.when(F.col("a").isNull(), empty).otherwise(F.col("score")))


def without_clip_hits(df: DataFrame, prediction: str, most: float) -> DataFrame:
    """df as it is; a prediction at the clip is an error."""
    hit = F.abs(F.col(prediction)) >= most - 1e-12
    return df.withColumn(prediction, F.when(hit, F.raise_error(F.lit("a prediction is at the clip")).cast("double")).otherwise(F.col(prediction)))
