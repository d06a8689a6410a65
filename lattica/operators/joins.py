"""Joins that state what must hold, and comparisons of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import scratch


def _fail(when: Column, message: str) -> Column:
    return F.when(when, F.raise_error(F.lit(message)).cast("int")).otherwise(0)


def join_covered(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Each row of left with its one row of right. A row of left without one, or with more, is an error when it is read."""
    once = right.groupBy(key).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in right.columns if c != key])
    joined = left.join(once, key, "left")
    checked = _fail(F.col("_n").isNull(), f"a {key} has no partner") + _fail(F.coalesce("_n", F.lit(1)) > 1, f"a {key} has several partners")
    return joined.withColumn("_ok", checked).filter("_ok = 0").drop("_n", "_ok")


def join_one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join; a key that is repeated on the right is an error when it is read."""
    once = right.groupBy(key).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in right.columns if c != key])
    return left.join(once, key, "left").withColumn("_ok", _fail(F.col("_n") > 1, f"a {key} has several partners")).filter("_ok = 0").drop("_n", "_ok")


def join_with_drift(left: DataFrame, right: DataFrame, values: Sequence[str], tolerance: float = 1e-6, keys: Sequence[str] = ("time_id", "asset_id"), fold: str | None = None, most_dropped: float = 1e-3) -> DataFrame:
    """Inner join on the keys. Values that both have must agree within the tolerance; rows of different folds are dropped, up to a share of most_dropped. The join runs once, into a table under spark.checkpoint.dir that the checks and the result read."""
    renamed = right.select(*keys, *[F.col(c).alias(f"_r_{c}") for c in right.columns if c not in keys])
    path = scratch(left.sparkSession, "drift")
    left.join(renamed, list(keys)).write.parquet(path)
    joined = left.sparkSession.read.parquet(path)
    apart = sum((F.when(F.abs(F.col(v) - F.col(f"_r_{v}")) <= tolerance, 0).otherwise(1) for v in values), F.lit(0))
    checks = joined.agg(F.count("*").alias("n"), F.coalesce(F.sum(apart), F.lit(0)).alias("apart"), (F.sum((F.col(fold) != F.col(f"_r_{fold}")).cast("int")) if fold else F.lit(0)).alias("moved")).first()
    if checks["apart"]:
        raise ValueError("values of the two tables have drifted apart")
    if (checks["moved"] or 0) > most_dropped * checks["n"]:
        raise ValueError("too many rows are in different folds")
    kept = joined.filter(F.col(fold) == F.col(f"_r_{fold}")) if fold else joined
    return kept.drop(*[f"_r_{v}" for v in values], *([f"_r_{fold}"] if fold else []))


def same_rows(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of only one table: the columns, and side (left or right). Empty if both hold the same rows, as often."""
    a, b = a.select(*columns), b.select(*columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def compare_columns(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Per column, in how many rows of a common key the values differ (missing equals missing), and the keys of one table alone."""
    other = b.select(F.col(key), *[F.col(c).alias(f"_b_{c}") for c in columns], F.lit(True).alias("_in_b"))
    both = a.withColumn("_in_a", F.lit(True)).join(other, key, "full_outer")
    common = F.col("_in_a") & F.col("_in_b")
    return both.agg(F.count_if(F.col("_in_b").isNull()).alias("only_left"), F.count_if(F.col("_in_a").isNull()).alias("only_right"), *[F.count_if(common & ~F.col(c).eqNullSafe(F.col(f"_b_{c}"))).alias(f"differs_{c}") for c in columns])


def snapshot_diff(baseline: DataFrame, current: DataFrame, key: str, identity: Sequence[str]) -> DataFrame:
    """Keys with what became of them: added, removed, modified or same, by the columns of their identity."""
    old = baseline.select(F.col(key), F.struct(*identity).alias("_old"))
    new = current.select(F.col(key), F.struct(*identity).alias("_new"))
    status = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("_new")), "same").otherwise("modified")
    return old.join(new, key, "full_outer").select(key, status.alias("status"))


def missing(wanted: DataFrame, there: DataFrame, keys: Sequence[str]) -> DataFrame:
    return wanted.join(there, list(keys), "left_anti")


def union_partitions(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_subset_check(narrow: DataFrame, wide: DataFrame, key: str) -> DataFrame:
    """The rows of narrow; one whose key isn't in wide is an error."""
    there = wide.select(key).distinct().withColumn("_there", F.lit(True))
    unknown = F.raise_error(F.concat(F.lit("not in the wide selection: "), F.col(key).cast("string"))).cast("boolean")
    return narrow.join(there, key, "left").filter(F.coalesce("_there", unknown)).drop("_there")
