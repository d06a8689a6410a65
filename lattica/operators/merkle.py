"""Fingerprints of ordered tables as Merkle trees over time: any number of partitions gives one root, and what differs is found by going down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import scratch

#: Children of a node: times beside one another at the lowest level, then ranges of them.
FANOUT = 64


def _digest(pairs: Column) -> Column:
    """SHA-256 of the digests of an array of (key, d), in order of key."""
    return F.sha2(F.array_join(F.transform(F.array_sort(pairs), lambda x: x["d"]), ","), 256)


def tree(df: DataFrame, value: str | Column, by: str = "time_id", then: str = "asset_id") -> list[DataFrame]:
    """The levels of the tree, from times (level 0) to the root: tables of node, d (hexadecimal SHA-256) and rows.

    A time's digest is that of its values, as text, in order of `then`; a node of the next level covers FANOUT whole numbers of the level
    below it, so its digest takes FANOUT digests at most, whatever the size of the table. When FANOUT nodes or fewer are left, they make the
    root, node 0. A missing value is `null`. Each level is written under spark.checkpoint.dir. An empty table has a root
    of no digests. A null time is an error.
    """
    text = (F.col(value) if isinstance(value, str) else value).cast("string")
    node = F.coalesce(F.col(by).cast("long"), F.raise_error(F.lit("a row without a time")).cast("long"))
    lists = df.groupBy(node.alias("node")).agg(F.array_sort(F.collect_list(F.struct(F.col(then).alias("k"), text.alias("v")))).alias("x"))
    level = lists.select("node", F.sha2(F.array_join(F.transform("x", lambda x: x["v"]), ",", "null"), 256).alias("d"), F.size("x").cast("long").alias("rows"))
    levels = [_written(level)]
    while True:
        below = levels[-1]
        last = below.count() <= FANOUT
        parent = F.lit(0).cast("long") if last else F.floor(F.col("node") / FANOUT)
        up = below.groupBy(parent.alias("node")).agg(F.collect_list(F.struct("node", "d")).alias("x"), F.sum("rows").alias("rows"))
        if last:
            none = below.agg(F.count("*").alias("n")).select(F.lit(0).cast("long").alias("node"))
            up = none.join(up, "node", "left").withColumn("x", F.coalesce("x", F.array().cast(up.schema["x"].dataType))).withColumn("rows", F.coalesce("rows", F.lit(0).cast("long")))
        levels.append(_written(up.select("node", _digest(F.col("x")).alias("d"), "rows")))
        if last:
            return levels


def _written(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession, "merkle")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def changed(one: list[DataFrame], two: list[DataFrame]) -> DataFrame:
    """Times whose rows differ between two trees: node. Only the children of nodes that differ are looked at; trees of unlike height are compared at level 0."""
    if len(one) != len(two):
        return _differing(one[0], two[0])
    wrong = _differing(one[-1], two[-1])
    for k in range(len(one) - 2, -1, -1):
        parent = F.lit(0).cast("long") if k == len(one) - 2 else F.floor(F.col("node") / FANOUT)
        sides = [levels[k].withColumn("up", parent).join(wrong.select(F.col("node").alias("up")), "up", "left_semi").drop("up") for levels in (one, two)]
        wrong = _differing(*sides)
    return wrong


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.select("node", F.col("d").alias("da")).join(b.select("node", F.col("d").alias("db")), "node", "full")
    return both.filter(~F.col("da").eqNullSafe(F.col("db"))).select("node")
