"""Panels as streams: a cross section is complete when a later time arrives; each asset's history is keyed state.

Batch and stream give the same values. Differences from a sequential caller: the last time waits for the watermark to
pass it, and late rows are dropped where a caller would see an error. Needs the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

OUT = StructType([StructField("time_id", LongType()), StructField("asset_id", LongType()), StructField("dev", DoubleType()), StructField("lag1", DoubleType()), StructField("mean", DoubleType()), StructField("long_mean", DoubleType()), StructField("slow", DoubleType())])


class AssetHistory(StatefulProcessor):
    """Per asset: the last `short` values, a running sum whose last `long` steps are kept, and a trail over `steps` of time."""

    def __init__(self, short: int = 5, long: int = 20, steps: int = 10) -> None:
        self.short, self.long, self.steps = short, long, steps

    def init(self, handle: StatefulProcessorHandle) -> None:
        pair = StructType([StructField("t", LongType()), StructField("v", DoubleType())])
        self.recent = handle.getListState("recent", pair)
        self.trail = handle.getListState("trail", pair)
        self.seen = handle.getValueState("seen", StructType([StructField("n", LongType())]))
        self.sums = handle.getMapState("sums", StructType([StructField("place", LongType())]), StructType([StructField("sum", DoubleType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("time_id")
        recent = [(int(r[0]), float(r[1])) for r in self.recent.get()] if self.recent.exists() else []
        trail = [(int(r[0]), float(r[1])) for r in self.trail.get()] if self.trail.exists() else []
        n = int(self.seen.get()[0]) if self.seen.exists() else 0
        out = []
        for t, v in zip(new["time_id"].tolist(), new["dev"].tolist()):
            if recent and t <= recent[-1][0]:
                raise ValueError("time_id must rise for each asset")
            last = [x for _, x in recent]
            total = float(self.sums.getValue((n,))[0]) if n else 0.0
            first = max(0, n - self.long)
            past = float(self.sums.getValue((first,))[0]) if first else 0.0
            trail = [(a, b) for a, b in trail if a >= t - self.steps]
            slow = sum(b for _, b in trail) / len(trail) if trail else (0.0 if n else v)
            out.append((t, int(key[0]), v, last[-1] if last else 0.0, sum(last) / len(last) if last else 0.0, (total - past) / (n - first) if n else 0.0, slow))
            # emit, then advance
            recent = [*recent, (t, v)][-self.short :]
            trail.append((t, v))
            n += 1
            self.sums.updateValue((n,), (total + v,))
            if n - self.long - 1 > 0:
                self.sums.removeKey((n - self.long - 1,))
        self.recent.put(recent)
        self.trail.put(trail)
        self.seen.update((n,))
        yield pd.DataFrame(out, columns=[f.name for f in OUT])

    def close(self) -> None:
        pass


def cross_sections(stream: DataFrame, column: str) -> DataFrame:
    """Rows of complete cross sections with dev = column - mean of the time. An asset twice at one time is an error. Times are 0 or more."""
    # the watermark begins at 0 and passes a time once a later one is seen
    timed = stream.withColumn("ts", F.timestamp_seconds(F.col("time_id") + 1)).withWatermark("ts", "1 second")
    whole = timed.groupBy("ts", "time_id").agg(F.collect_list(F.struct(F.col("asset_id"), F.col(column).alias("v"))).alias("rows"))
    once = F.size(F.array_distinct(F.transform("rows", lambda r: r["asset_id"]))) == F.size("rows")
    checked = whole.withColumn("rows", F.when(once, F.col("rows")).otherwise(F.raise_error(F.lit("an asset occurs twice at one time")).cast(whole.schema["rows"].dataType)))
    mean = F.aggregate("rows", F.lit(0.0), lambda a, r: a + r["v"]) / F.size("rows")
    return checked.withColumn("mean", mean).select("time_id", "mean", F.explode("rows").alias("r")).select("time_id", F.col("r.asset_id").alias("asset_id"), (F.col("r.v") - F.col("mean")).alias("dev"))


def online_features(stream: DataFrame, column: str, short: int = 5, long: int = 20, steps: int = 10) -> DataFrame:
    """Deviation from the cross section, then the asset's history of it: lag1, mean of the last `short`, mean of the last `long`, mean over `steps` of time."""
    return cross_sections(stream, column).groupBy("asset_id").transformWithStateInPandas(statefulProcessor=AssetHistory(short, long, steps), outputStructType=OUT, outputMode="append", timeMode="none")


def batch_features(df: DataFrame, column: str, short: int = 5, long: int = 20, steps: int = 10) -> DataFrame:
    """What online_features() gives, by windows."""
    from ..operators import cross, temporal

    dev = cross.demean(df.select("time_id", "asset_id", F.col(column).alias("dev")), ["dev"], suffix="").select("time_id", "asset_id", "dev")
    return dev.select("time_id", "asset_id", "dev", temporal.lag("dev").alias("lag1"), temporal.mean_before("dev", short).alias("mean"), temporal.mean_before("dev", long).alias("long_mean"), temporal.mean_by_steps("dev", steps).alias("slow"))


def _in_time(events: DataFrame, late: str) -> tuple[DataFrame, str]:
    """events with a watermark if they are a stream, and the type of ts. Watermarks need instants; a ts without a zone is read, and given back, in the session's."""
    kind = events.schema["ts"].dataType.simpleString()
    return (events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events), kind


def event_windows(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events per type in tumbling (or sliding) windows of event time; works on tables and on streams."""
    marked, kind = _in_time(events, late)
    return marked.groupBy(F.window("ts", width, slide or width), "event_type").agg(F.count("*").alias("n"), F.sum(F.floor("value")).alias("total")).select(F.col("window.start").cast(kind).alias("start"), "event_type", "n", "total")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: events no further apart than the gap."""
    marked, kind = _in_time(events, late)
    return marked.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").cast(kind).alias("start"), "n")


def replay(stream: DataFrame, folder: str, partitions: int = 8) -> DataFrame:
    """All that an append stream gives for the input at hand, as a table in a folder that driver and executors share; progress is kept beside it.

    Keyed state lies in so many partitions, which a restart from the same folder keeps. What a watermark still holds back isn't there.
    """
    spark = stream.sparkSession
    wanted = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.streaming.stateStore.providerClass": STATE_STORE}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/progress").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
