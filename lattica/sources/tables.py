"""Sources and sinks of panels: manifests, snapshots, cached samples, truncated copies, predictions as CSV."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType


def _read_text(spark: SparkSession, path: str) -> str | None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the one that spark.checkpoint.dir names; only a session on one machine may do without that setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def manifest_files(spark: SparkSession, root: str, part: str = "train") -> list[str]:
    """Paths in the manifest's order (files -> part); without a manifest, all Parquet files of the part by name."""
    text = _read_text(spark, f"{root}/manifest.json")
    if text is not None:
        return [f"{root}/{f}" for f in json.loads(text)["files"][part]]
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{root}/{part}").select("path")
    return sorted(r["path"] for r in found.collect())


def scan(spark: SparkSession, paths: Sequence[str], columns: Sequence[str] | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
    """Only the named columns and the closed range of time_id are read; the order of files means nothing."""
    df = spark.read.parquet(*paths)
    if low is not None:
        df = df.filter(F.col("time_id") >= low)
    if high is not None:
        df = df.filter(F.col("time_id") <= high)
    return df.select(*columns) if columns else df


def time_range(df: DataFrame, column: str = "time_id") -> DataFrame:
    return df.agg(F.min(column).alias("low"), F.max(column).alias("high"))


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, missing values, least and largest of each column, in one pass."""
    row = df.agg(*[F.struct(F.count("*").alias("rows"), F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias("missing"), F.min(F.col(c).cast("double")).alias("least"), F.max(F.col(c).cast("double")).alias("largest")).alias(c) for c in columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in columns])).alias("x")).select("x.column", "x.s.*")


def inspect_files(spark: SparkSession, path: str, with_hash: bool = False) -> DataFrame:
    """Per Parquet file: name, bytes, rows, and the SHA-256 of its bytes if asked for (files are then read whole)."""
    rows = spark.read.parquet(path).groupBy(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows"))
    if not with_hash:
        return rows
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))
    return rows.join(files, "name")


def truncated_copy(df: DataFrame, cutoff: int, path: str) -> None:
    """Rows up to a time, same columns and types, in zstd; an existing path is an error."""
    df.filter(F.col("time_id") <= cutoff).write.mode("errorifexists").option("compression", "zstd").parquet(path)


def combine(base: DataFrame, backfill: DataFrame, role: str, cutoff: int | None = None) -> DataFrame:
    """original: the base; extended: with all of the backfill; decision: with the backfill up to the cutoff."""
    if role == "original":
        return base
    if role == "extended":
        return base.unionByName(backfill)
    if role == "decision" and cutoff is not None:
        return base.unionByName(backfill.filter(F.col("time_id") <= cutoff))
    raise ValueError("role must be original, extended, or decision with a cutoff")


def load_sample(spark: SparkSession, paths: Sequence[str], features: Sequence[str], modulo: int, sampling: str = "periodic", period: int = 10) -> DataFrame:
    """Keys, target, weight and features of sampled times: periodic (time divisible by modulo) or phase (each phase equally often). Only these columns are read."""
    from ..operators.split import sample_periodic, sample_phase_balanced

    if sampling not in ("periodic", "phase"):
        raise ValueError("sampling must be periodic or phase")
    df = scan(spark, paths).select("time_id", "asset_id", F.col("target").cast("double").alias("target"), F.col("weight").cast("double").alias("weight"), *features)
    return sample_periodic(df, modulo) if sampling == "periodic" else sample_phase_balanced(df, modulo, period)


def cached_sample(df: DataFrame, path: str, identity: dict) -> DataFrame:
    """df, written once under path with what it was made from; a cache of another identity is an error.

    Rows and identity are written in a folder beside it, which takes its name by one rename at the end: what is under path is whole, whenever
    a writer was stopped. Of two writers at once, the first to rename counts.
    """
    spark = df.sparkSession
    wanted = json.dumps(identity, sort_keys=True)
    if _read_text(spark, f"{path}/identity") is None:
        part = f"{path.rstrip('/')}.part-{uuid.uuid4().hex}"
        df.write.parquet(f"{part}/rows")
        spark.createDataFrame([(wanted,)], "value string").coalesce(1).write.text(f"{part}/identity")
        _rename(spark, part, path)
    if (_read_text(spark, f"{path}/identity") or "").strip() != wanted:
        raise ValueError("the cache was made from something else")
    return spark.read.parquet(f"{path}/rows")


def _rename(spark: SparkSession, part: str, path: str) -> None:
    """part becomes path, unless that is there by now; then part goes."""
    old, new = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (part, path.rstrip("/")))
    files = new.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(new) or not files.rename(old, new):
        files.delete(old, True)
        if not files.exists(new):
            raise OSError(f"{path} can't be written")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=StructType([StructField("row_id", LongType()), StructField("target", DoubleType())]))


def write_predictions(df: DataFrame, path: str, decimals: int = 10) -> None:
    df.select("row_id", F.format_string(f"%.{decimals}f", "target").alias("target")).write.mode("errorifexists").csv(path, header=True)


def write_report(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def write_markdown(df: DataFrame, path: str, title: str, overwrite: bool = False) -> None:
    """A small table of results as a Markdown report, one text file; an existing path is an error unless overwrite."""
    rows = df.collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(map(cell, df.columns)) + " |", "|" + " - |" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]
    spark = df.sparkSession
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").text(path)
