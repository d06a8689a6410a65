"""Tables written in the folder that driver and executors share, and joins on keys that may be hot."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key that makes up more than this share of all rows (and over HOT_ROWS) is hot; there are at most 1 / HOT_SHARE such keys.
HOT_SHARE, HOT_ROWS = 1e-3, 1_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a session on one machine gets a temporary folder; others raise."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that materialize() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = hadoop(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def hot_limit(rows: int) -> int:
    """More rows of one key than this make it hot in a table of so many rows."""
    return max(HOT_ROWS, int(rows * HOT_SHARE))


def join_counted(left: DataFrame, right: DataFrame, on: Sequence[str], rows: int, copies: str = "copies") -> DataFrame:
    """Inner join with a table of one row per key, of which `copies` says how many of the `rows` rows of left have it.

    The rows of right with a hot key are broadcast, at most 1 / HOT_SHARE of them, so no task gets all rows of such a key;
    the others meet by an exchange. So do all where no key can be hot. The column of copies is dropped. Keys that are null meet nothing.
    """
    on = list(on)
    often = hot_limit(rows)
    if rows <= often:
        return left.join(right.drop(copies), on)
    hot = F.broadcast(right.filter(F.col(copies) > often).drop(copies))
    rest = right.filter(F.col(copies) <= often).drop(copies)
    return left.join(hot, on).unionByName(left.join(hot.select(*on), on, "left_anti").join(rest, on))
