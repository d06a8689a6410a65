"""Causal windows over each asset's series: frames never include what a deployed model couldn't know."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks
from .cross import regime_state


def by_asset():
    return Window.partitionBy("asset_id").orderBy("time_id")


def _or_zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def lag(x: str, k: int = 1) -> Column:
    """The k-th observation of the asset before this one, 0 if there is none."""
    return _or_zero(F.lag(x, k).over(by_asset()))


def difference(x: str) -> Column:
    return F.col(x) - lag(x)


def mean_before(x: str, rows: int) -> Column:
    """Mean of the last `rows` observations before this one, 0 if there are none."""
    return _or_zero(F.avg(x).over(by_asset().rowsBetween(-rows, -1)))


def deviation_before(x: str, rows: int) -> Column:
    return F.col(x) - mean_before(x, rows)


def mean_inclusive(x: str, rows: int) -> Column:
    """Mean of the last `rows` observations with this one."""
    return F.avg(x).over(by_asset().rowsBetween(-(rows - 1), 0))


def std_before(x: str, rows: int) -> Column:
    return _or_zero(F.stddev_pop(x).over(by_asset().rowsBetween(-rows, -1)))


def slope_before(x: str, place: str, rows: int) -> Column:
    """Least-squares slope of the last `rows` observations before this one against their places, which rise by 1; fewer than two give 0."""
    return _or_zero(F.regr_slope(F.col(x), F.col(place).cast("double")).over(by_asset().rowsBetween(-rows, -1)))


def with_slope(df: DataFrame, x: str, rows: int, out: str) -> DataFrame:
    """df with slope_before() by the places of the asset's rows."""
    return df.withColumn("_n", F.row_number().over(by_asset())).withColumn(out, slope_before(x, "_n", rows)).drop("_n")


def ema_before(x: str, span: int, rows: int = 20) -> Column:
    """Weights (1 - a) ^ age, a = 2 / (span + 1), over the last `rows` observations before this one, normalised; none give 0."""
    keep = 1 - 2 / (span + 1)
    past = F.reverse(F.collect_list(x).over(by_asset().rowsBetween(-rows, -1)))
    weights = F.array(*[F.lit(keep**k) for k in range(rows)])
    top = F.aggregate(F.zip_with(past, F.slice(weights, 1, F.size(past)), lambda v, w: v * w), F.lit(0.0), lambda a, v: a + v)
    total = F.aggregate(F.slice(weights, 1, F.size(past)), F.lit(0.0), lambda a, v: a + v)
    return F.when(F.size(past) == 0, 0.0).otherwise(F.try_divide(top, total))


def zscore(deviation: Column, std: Column, floor: float = 1e-3) -> Column:
    return deviation / F.greatest(std, F.lit(floor))


def delta(x: str, k: int) -> Column:
    return F.col(x) - lag(x, k)


def acceleration(x: str) -> Column:
    return F.col(x) - 2 * lag(x, 1) + lag(x, 2)


def gap() -> Column:
    """Time since the asset's last observation, 0 for its first; time that doesn't rise is an error."""
    step = F.col("time_id") - F.lag("time_id").over(by_asset())
    return F.when(step <= 0, F.raise_error(F.lit("time_id must rise for each asset")).cast("long")).otherwise(F.coalesce(step, F.lit(0)))


def lag_cache(x: str, rows: int) -> Column:
    """The last `rows` values before this one, newest first. Taken over all rows; sample afterwards."""
    return F.reverse(F.collect_list(x).over(by_asset().rowsBetween(-rows, -1)))


def mean_by_steps(x: str, steps: int) -> Column:
    """Mean over [time - steps, time) of the asset. Its first observation has its own value; an empty window later has 0."""
    inside = F.avg(x).over(by_asset().rangeBetween(-steps, -1))
    return F.coalesce(inside, F.when(F.row_number().over(by_asset()) == 1, F.col(x)).otherwise(0.0))


def expanding_mean(x: str, rows: int | None = None) -> Column:
    """Mean of all (or the last `rows`) observations before this one; the first observation has its own value."""
    start = Window.unboundedPreceding if rows is None else -rows
    return F.coalesce(F.avg(x).over(by_asset().rowsBetween(start, -1)), F.col(x))


def recombine(x: Column, slow: Column, slow_share: float, fast_share: float, scale: float, most: float) -> Column:
    return F.least(F.greatest(F.lit(scale) * (F.lit(slow_share) * slow + F.lit(fast_share) * (x - slow)), F.lit(-most)), F.lit(most))


def step_lag(x: str, steps: int) -> Column:
    """The asset's value exactly `steps` of time ago (ahead if negative), NULL if it has none then."""
    return F.max(x).over(by_asset().rangeBetween(-steps, -steps))


def with_long_mean(df: DataFrame, x: str, rows: int, out: str) -> DataFrame:
    """mean_before() for wide windows at a fixed cost per row: the difference of running sums. Floating sums differ from the frame's in the last digits."""
    before = F.coalesce(F.sum(x).over(by_asset().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    n = F.row_number().over(by_asset()) - 1
    summed = df.withColumn("_sum", before).withColumn("_n", n)
    past = F.coalesce(F.lag("_sum", rows).over(by_asset()), F.lit(0.0))
    return summed.withColumn(out, F.when(F.col("_n") == 0, 0.0).otherwise((F.col("_sum") - past) / F.greatest(F.least(F.col("_n"), F.lit(rows)), F.lit(1)))).drop("_sum", "_n")


def in_time_slices(df: DataFrame, rows_of_time: int, look_back: int) -> DataFrame:
    """Slices of time as extra keys, for few assets with long series: each slice also gets the `look_back` steps before it, marked by `warm_up`.

    Windows by (asset_id, slice) that reach back at most that far are then exact on rows that aren't warm_up.
    """
    own = df.withColumn("slice", F.floor(F.col("time_id") / rows_of_time)).withColumn("warm_up", F.lit(False))
    late = F.pmod("time_id", F.lit(rows_of_time)) >= rows_of_time - look_back
    return own.unionByName(own.filter(late).withColumn("slice", F.col("slice") + 1).withColumn("warm_up", F.lit(True)))


def sliced(df: DataFrame, rows_of_time: int, steps_back: int, rows_back: int, columns) -> DataFrame:
    """df with columns that are bounded windows of one asset, worked out by (asset, slice of time): as many tasks as there are slices, not assets.

    columns: from the window of an asset's rows in order of time to the new columns by name. They may look back `rows_back` rows and `steps_back`
    steps of time, no further, and not ahead. A slice begins with those rows of the past: the last `rows_back` rows of each asset
    before it, found by their places in the asset's slices before (an asset that is away for long brings older rows along),
    and all rows within the steps. Results are exact.
    """
    if rows_of_time <= 0 or steps_back < 0 or rows_back < 0:
        raise ValueError("slices need a positive length")
    own = df.withColumn("_slice", F.floor(F.col("time_id") / rows_of_time))
    moved = own.limit(0)
    if rows_back:
        # how many rows an asset has before each of its slices
        filled = own.groupBy("asset_id", "_slice").agg(F.count("*").alias("_n"))
        before = Window.partitionBy("asset_id").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        filled = filled.withColumn("_past", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        # the last rows of each slice, with their places among all rows of the asset, meet the slices whose past ends with those places
        newest = Window.partitionBy("asset_id", "_slice").orderBy(F.desc("time_id"))
        ends = own.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= rows_back)
        ends = ends.join(filled, ["asset_id", "_slice"]).withColumn("_place", F.col("_past") + F.col("_n") - F.col("_r")).drop("_slice", "_r", "_n", "_past")
        needs = filled.filter("_past > 0").select("asset_id", "_slice", F.explode(F.sequence(F.greatest(F.col("_past") - rows_back, F.lit(0)), F.col("_past") - 1)).alias("_place"))
        moved = ends.join(needs, ["asset_id", "_place"]).select(*df.columns, "_slice")
    late = F.pmod("time_id", F.lit(rows_of_time))
    if steps_back:
        most = -(-steps_back // rows_of_time)
        ahead = own.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(most)))).filter(late >= F.col("_k") * rows_of_time - steps_back)
        moved = moved.unionByName(ahead.withColumn("_slice", F.col("_slice") + F.col("_k")).drop("_k"))
    warm = moved.dropDuplicates(["asset_id", "time_id", "_slice"]).withColumn("_warm", F.lit(True))
    by = Window.partitionBy("asset_id", "_slice").orderBy("time_id")
    return own.withColumn("_warm", F.lit(False)).unionByName(warm).withColumns(columns(by)).filter("not _warm").drop("_slice", "_warm")


def market_lags(market: DataFrame, column: str, lags: Sequence[int], rolling: Sequence[int], rows_of_time: int = 10_000) -> DataFrame:
    """For one row per time: values exactly k steps ago (0 if that time is missing) and means of unbroken runs of R steps before (0 otherwise). Worked out in slices of time."""
    reach = max([*lags, *rolling])
    order = Window.partitionBy("slice").orderBy("time_id")
    out = {f"lag{k}": _or_zero(F.max(column).over(order.rangeBetween(-k, -k))) for k in lags}
    for r in rolling:
        frame = order.rangeBetween(-r, -1)
        out[f"mean{r}"] = F.when(F.count(column).over(frame) == r, F.avg(column).over(frame)).otherwise(0.0)
    return in_time_slices(market, max(rows_of_time, reach), reach).withColumns(out).filter("not warm_up").drop("slice", "warm_up")


def latest_snapshot(df: DataFrame, column: str, assets: Sequence[int]) -> DataFrame:
    """At each time, the last value of every asset strictly before it (NULL if never seen): one column per asset."""
    times = df.select("time_id").distinct()
    spine = times.withColumn("asset_id", F.explode(F.array(*[F.lit(a).cast("long") for a in assets])))
    seen = spine.join(df.select("time_id", "asset_id", F.col(column).alias("v")), ["time_id", "asset_id"], "left")
    last = F.last("v", ignorenulls=True).over(by_asset().rowsBetween(Window.unboundedPreceding, -1))
    return seen.withColumn("last", last).groupBy("time_id").pivot("asset_id", list(assets)).agg(F.first("last")).select("time_id", *[F.col(f"`{a}`").alias(f"a{a}") for a in assets])


def partner_lag(df: DataFrame, column: str, partners: dict[int, int], k: int = 1) -> DataFrame:
    """Each asset's partner's value k distinct times ago, 0 if the partner wasn't there."""
    times = ranks.numbered(df.select("time_id").distinct(), ["time_id"], "position")
    placed = df.join(times, "time_id")
    pairs = F.create_map(*[x for a, b in partners.items() for x in (F.lit(a).cast("long"), F.lit(b).cast("long"))])
    other = placed.select(F.col("asset_id").alias("partner"), (F.col("position") + k).alias("position"), F.col(column).alias("partner_lag"))
    return placed.withColumn("partner", F.try_element_at(pairs, "asset_id")).join(other, ["partner", "position"], "left").withColumn("partner_lag", _or_zero(F.col("partner_lag"))).drop("position", "partner")


def step_pairs(df: DataFrame, columns: Sequence[str], steps: Sequence[int], within: str | None = None) -> DataFrame:
    """An asset's rows exactly k steps of time apart, for each k (below 0: ahead): lag, asset_id, time_id, columns, and then_ columns of the other row. within: both rows have to agree in this column (a fold, say; null agrees with nothing)."""
    keys = ["asset_id", *([within] if within else [])]
    own = df.select(*keys, "time_id", *columns).withColumn("lag", F.explode(F.array(*map(F.lit, steps)))).withColumn("_then", F.col("time_id") - F.col("lag"))
    past = df.select(*keys, F.col("time_id").alias("_then"), *[F.col(c).alias(f"then_{c}") for c in columns])
    return own.join(past, [*keys, "_then"]).drop("_then")


def autocorrelation(df: DataFrame, column: str, lags: Sequence[int], by: str | None = None, weight: str | None = None) -> DataFrame:
    """Correlation of an asset's values exactly k steps apart: lag, pairs, correlation; pooled over assets, or one row for each value of `by` (asset_id, or a partition) that both rows share.

    With a weight, the correlation is uncentred: sum w x y / sqrt(sum w x^2 sum w y^2), by the later row's weight.
    """
    pairs = step_pairs(df, [column, *([weight] if weight else [])], lags, None if by in (None, "asset_id") else by)
    x, y = F.col(f"then_{column}"), F.col(column)
    w = F.greatest(F.col(weight), F.lit(0.0)) if weight else None
    correlation = F.corr(x, y) if w is None else F.try_divide(F.sum(w * x * y), F.sqrt(F.sum(w * x * x) * F.sum(w * y * y)))
    return pairs.groupBy("lag", *([by] if by else [])).agg(F.count("*").alias("pairs"), correlation.alias("correlation"))


def moving_average_window(profile: DataFrame, widths: Sequence[int]) -> DataFrame:
    """How well the profile of an equal-weight moving average, max(H - k, 0) / H, fits the autocorrelations, for each H: width, rmse."""
    spread = profile.withColumn("width", F.explode(F.array(*map(F.lit, widths))))
    want = F.greatest(F.col("width") - F.col("lag"), F.lit(0)) / F.col("width")
    return spread.groupBy("width").agg(F.sqrt(F.avg((F.col("correlation") - want) ** 2)).alias("rmse"))


#: Blocks of each family, always after the four of the baseline.
BASELINE = ("lag1", "difference", "mean5", "deviation5")
ARMS: dict[str, tuple[str, ...]] = {
    "baseline": (),
    "t1_lags": ("lag2", "lag5"),
    "t2_state": ("ema3", "ema10", "std5", "std20", "slope5", "slope20"),
    "t3_full": ("lag2", "lag5", "ema3", "ema10", "std5", "std20", "slope5", "slope20", "observation_gap"),
    "t4_regime": ("regime",),
    "t5_zscore": ("zscore5",),
    "f_lags": ("lag3", "lag10"),
    "f_changes": ("delta3", "delta5", "delta10", "acceleration1"),
    "f_volatility": ("std5", "std20"),
    "f_trend": ("slope5", "slope20"),
}


def temporal_features(df: DataFrame, columns: Sequence[str], arm: str = "baseline", groups: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """The blocks of an arm for each column, named block_column; observation_gap once, and the state of the market (of groups of features; all columns if None) once per time. An unknown arm is an error."""
    if arm not in ARMS:
        raise ValueError(f"unknown arm {arm}")
    blocks = (*BASELINE, *ARMS[arm])
    made: dict[str, Column] = {}
    for block in blocks:
        name = block.rstrip("0123456789")
        k = int(block[len(name) :] or 0)
        if block == "observation_gap":
            made[block] = gap()
        elif block != "regime":
            for c in columns:
                made[f"{block}_{c}"] = {"lag": lambda: lag(c, k), "difference": lambda: difference(c), "mean": lambda: mean_before(c, k), "deviation": lambda: deviation_before(c, k), "ema": lambda: ema_before(c, k), "std": lambda: std_before(c, k), "slope": lambda: slope_before(c, "_place", k), "zscore": lambda: zscore(deviation_before(c, k), std_before(c, k)), "delta": lambda: delta(c, k), "acceleration": lambda: acceleration(c)}[name]()
    # all blocks are one projection over one sort; slopes need the places of the asset's rows
    placed = df.withColumn("_place", F.row_number().over(by_asset())) if any(b.startswith("slope") for b in blocks) else df
    out = placed.withColumns(made).drop("_place")
    return out.join(regime_state(df, groups or {"regime": list(columns)}), "time_id") if "regime" in blocks else out
