"""Column expressions shared by the panel operators. Missing values are NaN in the sources and NULL in plans."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """x, or NULL where it is NaN or infinite (NaN is larger than any number in Spark)."""
    return F.when(F.abs(x) < F.lit(math.inf), x)


def zero_if_missing(x: Column) -> Column:
    return F.coalesce(finite(x), F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a, b)


def clip(x: Column, low: float | Column, high: float | Column) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    return F.least(F.greatest(x, low), high)


def clip_symmetric(x: Column, most: float, scale: float = 1.0) -> Column:
    """x * scale, cut to [-most, most]; the scale comes first."""
    return clip(x * F.lit(float(scale)), -most, most)


def robust(x: Column, low: Column, high: Column, centre: Column, scale: Column, most: float = 10.0) -> Column:
    """Missing values as 0, then clip to the fitted range, centre, scale, and clip to +-most."""
    return clip((clip(zero_if_missing(x), low, high) - centre) / scale, -most, most)


def positive_weight(w: Column) -> Column:
    return F.greatest(zero_if_missing(w), F.lit(0.0))


def number(x: Column) -> Column:
    """A number from any text: what can't be read, and what isn't finite, is 0."""
    return zero_if_missing(x.try_cast("double"))


def pack_key(time: Column, asset: Column) -> Column:
    """time * 256 + asset for assets 0 to 255; others are an error."""
    asset = F.when(asset.between(0, 255), asset).otherwise(F.raise_error(F.lit("assets have to be 0 to 255")).cast("long"))
    return F.shiftleft(time, 8).bitwiseOR(asset.cast("long"))


def phase(time: Column, period: int = 10) -> Column:
    return F.pmod(time, F.lit(period))


def phase_flags(time: Column, period: int = 10) -> list[Column]:
    return [F.when(phase(time, period) == k, 1.0).otherwise(0.0).alias(f"phase_{k}") for k in range(period)]


def phase_waves(time: Column, period: int = 10) -> tuple[Column, Column]:
    angle = phase(time, period) * F.lit(2 * math.pi / period)
    return F.sin(angle).alias("phase_sin"), F.cos(angle).alias("phase_cos")


def linear_predict(columns: Sequence[Column], weights: Sequence[float], intercept: float = 0.0) -> Column:
    """intercept + sum of weight * column, as one expression."""
    out = F.lit(float(intercept))
    for c, w in zip(columns, weights, strict=True):
        out = out + c * F.lit(float(w))
    return out


def feature_names(n: int = 323) -> list[str]:
    """feature_000, feature_001, ..."""
    return [f"feature_{k:03d}" for k in range(n)]


def feature_index(name: str) -> int:
    prefix, _, digits = name.partition("_")
    if prefix != "feature" or not digits.isdigit():
        raise ValueError(f"{name} is not the name of a feature")
    return int(digits)


def columns_with_prefix(columns: Sequence[str], prefix: str) -> list[str]:
    return [c for c in columns if c.startswith(prefix)]


def q(x: Column, places: int = 6) -> Column:
    """Rounded for results that two engines compare."""
    return F.round(x, places)
