"""Panels over the star-schema tables: one row per (time_id, asset_id), unbalanced, with whole-numbered measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def percent(c: str):
    return F.round(F.col(c) * 100).cast("long")


def ship_panel(spark: SparkSession, sf_dir: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Days of shipment x 15 supplier groups: weight, target, f0, f1, f2 as doubles. A closed range of time_id is asked of l_shipdate itself, so that the scan skips row groups by it."""
    lines = table(spark, sf_dir, "lineitem")
    day, kind = F.lit("1995-01-01").cast("date"), lines.schema["l_shipdate"].dataType
    if low is not None:
        lines = lines.filter(F.col("l_shipdate") >= F.date_add(day, low).cast(kind))
    if high is not None:
        lines = lines.filter(F.col("l_shipdate") < F.date_add(day, high + 1).cast(kind))
    return (
        lines.groupBy(F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date")).cast("long").alias("time_id"), F.pmod("l_suppkey", F.lit(15)).cast("long").alias("asset_id"))
        .agg(
            F.sum(F.round("l_quantity").cast("long")).cast("double").alias("weight"),
            F.sum(percent("l_discount") - percent("l_tax")).cast("double").alias("target"),
            F.sum(F.floor(F.col("l_extendedprice") / 1000)).cast("double").alias("f0"),
            F.sum(percent("l_discount")).cast("double").alias("f1"),
            F.sum(percent("l_tax")).cast("double").alias("f2"),
        )
    )


SHIP_SQL = """panel AS (
  SELECT date_diff('day', DATE '1995-01-01', l_shipdate::DATE)::BIGINT AS time_id, (l_suppkey % 15)::BIGINT AS asset_id,
    sum(round(l_quantity)::BIGINT)::DOUBLE AS weight,
    sum(round(l_discount * 100)::BIGINT - round(l_tax * 100)::BIGINT)::DOUBLE AS target,
    sum(floor(l_extendedprice / 1000)::BIGINT)::DOUBLE AS f0,
    sum(round(l_discount * 100)::BIGINT)::DOUBLE AS f1,
    sum(round(l_tax * 100)::BIGINT)::DOUBLE AS f2
  FROM lineitem GROUP BY 1, 2)"""


def event_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours x 15 user groups: number of events, sum of values in whole units."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.floor(F.unix_timestamp("ts") / 3600).cast("long").alias("time_id"), F.pmod("user_id", F.lit(15)).cast("long").alias("asset_id")).agg(F.count("*").cast("double").alias("weight"), F.sum(F.floor("value")).cast("double").alias("f0"))


EVENT_SQL = """panel AS (
  SELECT floor(epoch(ts) / 3600)::BIGINT AS time_id, (user_id % 15)::BIGINT AS asset_id, count(*)::DOUBLE AS weight, sum(floor(value)::BIGINT)::DOUBLE AS f0
  FROM events GROUP BY 1, 2)"""


def vector_panel(spark: SparkSession, sf_dir: str, width: int = 64) -> DataFrame:
    """Vectors as rows of a wide panel: target = label, feature_000, ... as doubles."""
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.floor(F.col("vec_id") / 15).cast("long").alias("time_id"), F.pmod("vec_id", F.lit(15)).cast("long").alias("asset_id"), F.lit(1.0).alias("weight"), F.col("label").cast("double").alias("target"), *[F.col("embedding")[k].cast("double").alias(f"feature_{k:03d}") for k in range(width)])
