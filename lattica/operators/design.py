"""Designs of models: columns from their names, blocks in a fixed order, histories from lag caches and from saved states."""

from __future__ import annotations

import re
from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import robust
from . import cross, temporal

_ROLLING = re.compile(r"rmean(\d+)_(.+)")


def named_column(name: str, raw: Collection[str]) -> Column:
    """What a column's name stands for: asset_id, a raw column, lag1_x, diff1_x or rmean5_x (mean of the last 5 with this one) of a raw column x; any other name is 0."""
    rolling = _ROLLING.fullmatch(name)
    if name == "asset_id":
        made = F.col(name).cast("double")
    elif name in raw:
        made = F.col(name)
    elif name.startswith("lag1_") and name[5:] in raw:
        made = temporal.lag(name[5:])
    elif name.startswith("diff1_") and name[6:] in raw:
        made = temporal.difference(name[6:])
    elif rolling and rolling[2] in raw:
        made = temporal.mean_inclusive(rolling[2], int(rolling[1]))
    else:
        made = F.lit(0.0)
    return made.alias(name)


def named_design(df: DataFrame, names: Sequence[str], keys: Sequence[str] = ("time_id", "asset_id")) -> DataFrame:
    """The keys, and a column `x_name` for each name, in that order."""
    return df.select(*keys, *[named_column(n, df.columns).alias(f"x_{n}") for n in names])


def market_design(df: DataFrame, features: Sequence[str]) -> list[Column]:
    """Raw values, then their deviations from the mean of the time."""
    return [F.col(c) for c in features] + [(F.col(c) - cross.mean_of_time(c)).alias(f"dev_{c}") for c in features]


def cross_design(df: DataFrame, features: Sequence[str], history: Sequence[str], arm: str = "baseline", long_rows: int | None = None) -> tuple[DataFrame, list[str]]:
    """Columns of the model of deviations and the order it takes them in: deviations, the blocks of the arm, the long mean if `long_rows` is set, asset_id last.

    The history is that of the deviations of `history`, which must be some of the features. A single array column, where
    a model needs one, is vector(df, order).
    """
    if not set(history) <= set(features):
        raise ValueError("history has to be a part of the features")
    out = df.withColumns({f"dev_{c}": F.col(c) - cross.mean_of_time(c) for c in features})
    past = [f"dev_{c}" for c in history]
    before = set(out.columns)
    out = temporal.temporal_features(out, past, arm)
    order = [f"dev_{c}" for c in features] + [c for c in out.columns if c not in before]
    if long_rows is not None:
        for c in past:
            out = temporal.with_long_mean(out, c, long_rows, f"long_{c}")
            order.append(f"long_{c}")
    return out, [*order, "asset_id"]


def vector(df: DataFrame, order: Sequence[str], out: str = "x") -> DataFrame:
    return df.withColumn(out, F.array(*[F.col(c).cast("double") for c in order]))


def two_bases(features: Sequence[str], basis: str = "raw", market_scale: float = 1.0) -> list[Column]:
    """Two columns per feature: the raw value or the mean of its time, then the deviation. Columns of means are divided by the root of `market_scale`, so a penalty weighs that much more on them."""
    if basis not in ("raw", "mean"):
        raise ValueError(f"unknown basis {basis}")
    unit = F.sqrt(F.lit(float(market_scale)))
    first = [(F.col(c) if basis == "raw" else cross.mean_of_time(c) / unit).alias(f"{basis}_{c}") for c in features]
    return first + [(F.col(c) - cross.mean_of_time(c)).alias(f"dev_{c}") for c in features]


def with_market_state(df: DataFrame, prediction: str, out: str = "market_state") -> DataFrame:
    """Each row with the mean prediction of its time: a feature that lets trees split by asset and by state of the market."""
    return df.withColumn(out, cross.mean_of_time(prediction))


def atoms_from_lags(current: Column, lags: Column, low: Column, high: Column, centre: Column, scale: Column, prefix: str = "") -> dict[str, Column]:
    """The blocks of the baseline, lags, changes, deviations, z-scores, slopes and exponential means (over 20 lags at most) from raw lags (newest first, only those there are), transformed as the current value was.

    Lags are transformed first; a lag that isn't there is 0 then. Of std and slope the window is the length of the list at most.
    """
    past = F.transform(lags, lambda x: robust(x, low, high, centre, scale))

    def at(k: int) -> Column:
        return F.coalesce(F.get(past, F.lit(k - 1)), F.lit(0.0))

    def moment(n: int, f) -> Column:
        own = F.slice(past, 1, n)
        total = F.aggregate(own, F.lit(0.0), lambda a, x: a + f(x))
        return F.coalesce(F.try_divide(total, F.size(own)), F.lit(0.0))

    out = {f"lag{k}": at(k) for k in (1, 2, 3, 5, 10)}
    out |= {"difference": current - at(1)} | {f"delta{k}": current - at(k) for k in (3, 5, 10)}
    out["acceleration1"] = current - 2 * at(1) + at(2)
    for n in (5, 20):
        mean = moment(n, lambda x: x)
        out[f"mean{n}"] = mean
        out[f"deviation{n}"] = current - mean
        std = F.sqrt(F.greatest(moment(n, lambda x: x * x) - mean * mean, F.lit(0.0)))
        out[f"std{n}"] = std
        out[f"zscore{n}"] = (current - mean) / F.greatest(std, F.lit(1e-3))
        # slope of the window's values, oldest first, against 0, 1, ...; newest first, it is that against 0, -1, ...
        own = F.slice(past, 1, n)
        size = F.size(own).cast("double")
        places = F.aggregate(F.transform(own, lambda x, i: x * (-i.cast("double") - (1 - size) / 2)), F.lit(0.0), lambda a, v: a + v)
        out[f"slope{n}"] = F.when(size >= 2, places * 12 / (size * (size * size - 1))).otherwise(0.0)
    for span in (3, 10):
        keep = 1 - 2 / (span + 1)
        own = F.slice(past, 1, 20)
        weights = F.transform(own, lambda x, i: F.pow(F.lit(keep), i))
        top = F.aggregate(F.zip_with(own, weights, lambda v, w: v * w), F.lit(0.0), lambda a, v: a + v)
        out[f"ema{span}"] = F.coalesce(F.try_divide(top, F.aggregate(weights, F.lit(0.0), lambda a, v: a + v)), F.lit(0.0))
    return {f"{prefix}{k}": v for k, v in out.items()}


def saved_state(df: DataFrame, columns: Sequence[str], rows: int) -> DataFrame:
    """Each asset's last `rows` rows as one row: asset_id, state (array of structs of time_id and columns, oldest first). What a later part needs to go on."""
    newest = Window.partitionBy("asset_id").orderBy(F.desc("time_id"))
    last = df.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= rows)
    return last.groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct("time_id", *columns))).alias("state"))


def resumed(df: DataFrame, state: DataFrame) -> DataFrame:
    """The rows of df with those of a saved state before them, marked by `warm_up`. Windows that reach back no further than the state are exact on the others."""
    names = [f.name for f in state.schema["state"].dataType.elementType.fields]
    old = state.select("asset_id", F.inline("state")).select("asset_id", *names, F.lit(True).alias("warm_up"))
    return df.withColumn("warm_up", F.lit(False)).unionByName(old, allowMissingColumns=True)
