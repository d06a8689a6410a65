"""Checks of tables before they are used."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import finite

OOF_COLUMNS = ("time_id", "asset_id", "target", "weight", "fold", "prediction")


def check_oof(df: DataFrame) -> None:
    """Raise unless the table of out-of-fold predictions can be used: columns, keys, finite values, each time in one fold, some validated row (fold >= 0)."""
    absent = [c for c in OOF_COLUMNS if c not in df.columns]
    if absent:
        raise ValueError(f"columns are missing: {absent}")
    bad = df.agg(F.count_if((F.col("asset_id") < 0) | (F.col("weight") < 0)).alias("negative"), F.count_if(finite(F.col("target")).isNull() | finite(F.col("weight")).isNull() | ((F.col("fold") >= 0) & finite(F.col("prediction")).isNull())).alias("not finite"), F.count_if(F.col("fold") >= 0).alias("validated")).first()
    if bad["negative"] or bad["not finite"] or not bad["validated"]:
        raise ValueError(f"values can't be used: {bad.asDict()}")
    if df.groupBy("time_id", "asset_id").count().filter("count > 1").limit(1).count():
        raise ValueError("an asset occurs twice at one time")
    if df.groupBy("time_id").agg(F.count_distinct("fold").alias("n")).filter("n > 1").limit(1).count():
        raise ValueError("a time is in several folds")


def backfill_verdict(df: DataFrame, columns: Sequence[str]) -> str:
    """with if every column has values, without if none has, inconsistent otherwise, unchanged for no columns."""
    if not columns:
        return "unchanged"
    row = df.agg(*[F.count(F.col(c)).alias(c) for c in columns]).first()
    filled = [row[c] > 0 for c in columns]
    return "with" if all(filled) else "inconsistent" if any(filled) else "without"


def column_families(profile: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Runs of columns (name, index, null_count, least, largest) by sign class, cut where the class changes or the null count falls: name, index, sign, family, ladder (does the count rise)."""
    sign = F.when(F.col("least") >= -tolerance, "positive").when(F.col("largest") <= tolerance, "negative").otherwise("both")
    order = Window.orderBy("index")
    marked = profile.withColumn("sign", sign)
    new = (F.col("sign") != F.lag("sign").over(order)) | (F.col("null_count") < F.lag("null_count").over(order))
    return marked.withColumn("_new", F.coalesce(new.cast("int"), F.lit(1))).withColumn("family", F.sum("_new").over(order)).withColumn("ladder", F.max("null_count").over(Window.partitionBy("family")) > F.min("null_count").over(Window.partitionBy("family"))).select("name", "index", "sign", "family", "ladder")


def check_submission(df: DataFrame, expected: DataFrame, most: float, key: str = "row_id", value: str = "target") -> DataFrame:
    """Rows, keys that are missing or unknown or repeated, values that aren't finite, and values at the clip."""
    got = df.groupBy(key).agg(F.count("*").alias("n"), F.max(value).alias("v"))
    both = got.join(expected.select(key).distinct().withColumn("_e", F.lit(True)), key, "full_outer")
    return both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("_e").isNull()).alias("unknown"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("n").isNotNull() & finite(F.col("v")).isNull()).alias("not_finite"), F.count_if(F.abs("v") >= most - 1e-12).alias("clipped"))


def parameter_grid(spark, axes: dict[str, Sequence]) -> DataFrame:
    """All combinations of a few parameter values."""
    out = spark.range(1).drop("id")
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return out


def shared_ladders(columns: DataFrame) -> DataFrame:
    """Families that end in the same ladder: rungs (text), families. columns: rows (family, index, null_count).

    A family's rungs are the positive counts of its longest strictly rising suffix in order of index; what comes before
    the last fall or tie has other reasons. Families without rungs share the empty text.
    """
    order = Window.partitionBy("family").orderBy("index")
    marked = columns.withColumn("_falls", F.coalesce(F.col("null_count") <= F.lag("null_count").over(order), F.lit(False)))
    later = F.coalesce(F.max("_falls").over(order.rowsBetween(1, Window.unboundedFollowing)), F.lit(False))
    rung = F.when(~F.col("_later") & (F.col("null_count") > 0), F.struct("index", "null_count"))
    own = marked.withColumn("_later", later).groupBy("family").agg(F.array_sort(F.collect_list(rung)).alias("x"))
    rungs = F.array_join(F.transform("x", lambda x: x["null_count"].cast("string")), ",")
    return own.select("family", rungs.alias("rungs")).groupBy("rungs").agg(F.array_sort(F.collect_list("family")).alias("families"))
