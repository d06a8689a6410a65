"""Cross-sectional operators: all rows of one time_id. One exchange on time_id serves every operator of a plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clip, finite, positive_weight, ratio
from . import ranks


def by_time():
    return Window.partitionBy("time_id")


def mean_of_time(x: str) -> Column:
    """Unweighted mean of the cross section on each of its rows."""
    return F.avg(finite(F.col(x))).over(by_time())


def demean(df: DataFrame, columns: Sequence[str], suffix: str = "_dev") -> DataFrame:
    return df.withColumns({c + suffix: F.col(c) - mean_of_time(c) for c in columns})


def standardise(df: DataFrame, columns: Sequence[str], suffix: str = "_std", floor: float = 1e-2, most: float = 10.0) -> DataFrame:
    """Deviation over the population standard deviation (at least `floor`), cut to +-most."""
    return df.withColumns({c + suffix: clip((F.col(c) - mean_of_time(c)) / F.greatest(F.stddev_pop(finite(F.col(c))).over(by_time()), F.lit(floor)), -most, most) for c in columns})


def group_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.groupBy("time_id").agg(*[F.avg(finite(F.col(c))).alias(c) for c in columns])


def weighted_mean(x: Column, w: Column) -> Column:
    """Sum of w * x over sum of w as an aggregate; rows without x have no weight; NULL where no weight is left."""
    good = finite(x).isNotNull()
    total = F.sum(F.when(good, positive_weight(w)))
    return F.when(total > 0, ratio(F.sum(F.when(good, positive_weight(w) * x)), total))


def split_market(df: DataFrame, column: str, weight: str | None = None) -> DataFrame:
    """column = market (one value per time) + cross (what is left)."""
    if weight is None:
        market = mean_of_time(column)
    else:
        good = finite(F.col(column)).isNotNull()
        w = F.when(good, positive_weight(F.col(weight)))
        market = ratio(F.sum(w * F.col(column)).over(by_time()), F.sum(w).over(by_time()))
    return df.withColumn("market", market).withColumn("cross", F.col(column) - F.col("market"))


def scale_and_project(df: DataFrame, column: str, scales: dict[int, float], out: str = "projected") -> DataFrame:
    """Times a scale per asset, then mean zero in each cross section again. An asset without a scale is an error."""
    by_asset = F.create_map(*[x for a, s in scales.items() for x in (F.lit(int(a)).cast("long"), F.lit(float(s)))])
    known = F.try_element_at(by_asset, F.col("asset_id").cast("long"))
    scaled = F.col(column) * F.when(known.isNull(), F.raise_error(F.lit("asset_id without a scale")).cast("double")).otherwise(known)
    return df.withColumn(out, scaled).withColumn(out, F.col(out) - mean_of_time(out))


def dispersion(df: DataFrame, column: str) -> DataFrame:
    """Population standard deviation and root mean square per time."""
    return df.groupBy("time_id").agg(F.stddev_pop(column).alias("std"), F.sqrt(F.avg(F.col(column) * F.col(column))).alias("rms"))


def symmetric_rank(df: DataFrame, column: str, out: str = "rank") -> DataFrame:
    """(2 r - (n - 1)) / max(n - 1, 1) for r = 0, ..., n - 1; equal values in order of asset_id, missing ones last, one row alone 0."""
    r = F.row_number().over(by_time().orderBy(finite(F.col(column)).asc_nulls_last(), "asset_id")) - 1
    n = F.count(F.lit(1)).over(by_time())
    return df.withColumn(out, (2 * r - (n - 1)).cast("double") / F.greatest(n - 1, F.lit(1)))


def tail_scores(df: DataFrame, column: str) -> DataFrame:
    """percentile (rank / (n - 1) - 0.5), robust_z ((x - median) / MAD, a MAD of 1e-6 or less counts as 1, cut to +-12) and tail (what |percentile| exceeds 0.3). Missing values have 0."""
    x = finite(F.col(column))
    n = F.count(F.lit(1)).over(by_time())
    r = F.row_number().over(by_time().orderBy(x.asc_nulls_last(), "asset_id")) - 1
    ranked = df.withColumn("percentile", F.when(x.isNull(), 0.0).otherwise(r / F.greatest(n - 1, F.lit(1)) - 0.5)).withColumn("_median", F.percentile(x, F.lit(0.5)).over(by_time()))
    ranked = ranked.withColumn("_mad", F.percentile(F.abs(x - F.col("_median")), F.lit(0.5)).over(by_time()))
    z = clip((x - F.col("_median")) / F.when(F.col("_mad") <= 1e-6, 1.0).otherwise(F.col("_mad")), -12, 12)
    return ranked.withColumn("robust_z", F.coalesce(z, F.lit(0.0))).withColumn("tail", F.greatest(F.abs("percentile") - 0.3, F.lit(0.0))).drop("_median", "_mad")


def market_summary(df: DataFrame, column: str, dynamics: bool = False, most_gap: int | None = None) -> DataFrame:
    """Per time: mean, std, q25, q50, q75, spread (q90 - q10), positive (share above 0); with dynamics also lag, delta, abs_delta of the mean and gap in time, cut at most_gap."""
    x = F.col(column)
    at = F.percentile(x, F.array(*[F.lit(v) for v in (0.1, 0.25, 0.5, 0.75, 0.9)]))
    out = df.groupBy("time_id").agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), at.alias("_at"), F.avg((x > 0).cast("double")).alias("positive"))
    out = out.select("time_id", "mean", "std", F.col("_at")[1].alias("q25"), F.col("_at")[2].alias("q50"), F.col("_at")[3].alias("q75"), (F.col("_at")[4] - F.col("_at")[0]).alias("spread"), "positive")
    if dynamics:
        lag, gap = F.coalesce("previous_mean", F.lit(0.0)), F.coalesce(F.col("time_id") - F.col("previous_time_id"), F.lit(0))
        made = {"lag": lag, "delta": F.col("mean") - lag, "abs_delta": F.abs(F.col("mean") - lag), "gap": gap if most_gap is None else F.least(gap, F.lit(most_gap))}
        out = ranks.with_previous(out, "time_id", ["mean", "time_id"]).withColumns(made).drop("previous_mean", "previous_time_id")
    return out


def asset_panel(df: DataFrame, column: str, assets: Sequence[int], dynamics: bool = False) -> DataFrame:
    """One row per time with a column and a presence flag per asset (absent: 0); with dynamics also each column's value at the time before (lag, 0 at first) and the difference (delta). Two rows of an asset at one time are an error."""
    cells = df.groupBy("time_id", "asset_id").agg(F.first(column).alias(column), F.count("*").alias("n")).withColumn(column, F.when(F.col("n") > 1, F.raise_error(F.lit("an asset occurs twice at one time")).cast("double")).otherwise(F.col(column)))
    wide = cells.groupBy("time_id").pivot("asset_id", list(assets)).agg(F.first(column))
    out = wide.select("time_id", *[F.coalesce(F.col(f"`{a}`"), F.lit(0.0)).alias(f"a{a}") for a in assets], *[F.col(f"`{a}`").isNotNull().cast("int").alias(f"has{a}") for a in assets])
    if dynamics:
        out = ranks.with_previous(out, "time_id", [f"a{a}" for a in assets])
        out = out.withColumns({f"lag{a}": F.coalesce(f"previous_a{a}", F.lit(0.0)) for a in assets}).withColumns({f"delta{a}": F.col(f"a{a}") - F.col(f"lag{a}") for a in assets}).drop(*[f"previous_a{a}" for a in assets])
    return out


def information_coefficient(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of a and b in each cross section of 3 or more rows with spread; then mean, its ratio to the deviation, and the share above 0."""
    per_time = df.groupBy("time_id").agg(F.count("*").alias("n"), F.stddev_pop(a).alias("sa"), F.stddev_pop(b).alias("sb"), F.covar_pop(a, b).alias("c")).filter("n >= 3 and sa > 0 and sb > 0").withColumn("ic", F.col("c") / (F.col("sa") * F.col("sb")))
    return per_time.agg(F.count("*").alias("times"), F.avg("ic").alias("mean_ic"), ratio(F.avg("ic"), F.stddev_pop("ic")).alias("icir"), F.avg((F.col("ic") > 0).cast("double")).alias("positive_rate"))


def regime_state(df: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """Per time and group of features: mean of their means and mean of their deviations, with the state before and the difference."""
    aggs = [e for cols in groups.values() for c in cols for e in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]
    per_time = df.groupBy("time_id").agg(*aggs)
    order = Window.orderBy("time_id")
    out = per_time.select("time_id", *[(sum((F.col(f"{k}_{c}") for c in cols), F.lit(0.0)) / len(cols)).alias(f"{g}_{name}") for g, cols in groups.items() for k, name in (("m", "mean"), ("s", "std"))])
    state = [c for c in out.columns if c != "time_id"]
    return out.withColumns({f"{c}_lag": F.coalesce(F.lag(c).over(order), F.lit(0.0)) for c in state}).withColumns({f"{c}_change": F.col(c) - F.col(f"{c}_lag") for c in state})


def state_vector(df: DataFrame, cross: str, first: str, second: str, prediction: str) -> DataFrame:
    """On each row: RMS of the cross part, |difference of two market estimates|, RMS of the prediction, number of assets, phase."""
    return df.withColumns({"cross_rms": F.sqrt(F.avg(F.col(cross) ** 2).over(by_time())), "disagreement": F.abs(F.col(first) - F.col(second)), "prediction_rms": F.sqrt(F.avg(F.col(prediction) ** 2).over(by_time())), "coverage": F.count(F.lit(1)).over(by_time()), "phase": F.pmod("time_id", F.lit(10))})


def ragged_lists(df: DataFrame, column: str) -> DataFrame:
    """Each cross section's values as an array in order of asset_id. A cross section has at most as many rows as there are assets."""
    return df.groupBy("time_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("asset_id", F.col(column).alias("v")))), lambda x: x["v"]).alias("values"))


def dense_lists(df: DataFrame, column: str) -> DataFrame:
    """As ragged_lists(), all as long as the largest cross section; what is missing is NaN."""
    lists = ragged_lists(df, column)
    width = F.broadcast(lists.agg(F.max(F.size("values")).alias("_w")))
    padded = F.concat("values", F.array_repeat(F.lit(float("nan")), F.col("_w") - F.size("values")))
    return lists.crossJoin(width).select("time_id", padded.alias("values"))
