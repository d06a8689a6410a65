"""Pieces of SQL that several oracles share."""

from __future__ import annotations

from ..sources.panels import EVENT_SQL, SHIP_SQL

WITH = f"WITH {SHIP_SQL}"
WITH_EVENTS = f"WITH {EVENT_SQL}"
#: Frames of one asset's past.
ASSET = "PARTITION BY asset_id ORDER BY time_id"


def r(x: str, places: int = 6) -> str:
    """Rounded as the queries round, with -0 as 0."""
    return f"(round(({x})::DOUBLE, {places}) + 0.0::DOUBLE)"


def over(agg: str, low: int | str, high: int, kind: str = "ROWS") -> str:
    start = "UNBOUNDED PRECEDING" if low == "start" else f"{-low} PRECEDING"
    end = "CURRENT ROW" if high == 0 else f"{-high} PRECEDING" if high < 0 else f"{high} FOLLOWING"
    return f"{agg} OVER ({ASSET} {kind} BETWEEN {start} AND {end})"


#: A prediction to score: the mean of the asset's last five targets.
PREDICTED = f"""predicted AS (
  SELECT *, coalesce({over('avg(target)', -5, -1)}, 0.0::DOUBLE) AS prediction FROM panel)"""
MOMENTS = "sum(weight * target * target) AS d, sum(weight * target * prediction) AS v, sum(weight * prediction * prediction) AS g"
SCORE = f"""{r('v / d')} AS a, {r('g / d')} AS b, {r('v * v / (g * d)')} AS peak, {r('(2 * v - g) / d')} AS score"""
