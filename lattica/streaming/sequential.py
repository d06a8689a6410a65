"""Predictions in order of time from keyed state: each asset's last rows make the features, a model in the tasks makes the prediction.

A stream goes on where a batch has ended: the batch's saved state is the initial state of the stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .panel import STATE_STORE

#: Features of a row from its asset's past: rows before it, the oldest first (times, values of the columns), and its own time and values.
Features = Callable[[np.ndarray, np.ndarray, int, np.ndarray], Sequence[float]]


class Predictor(StatefulProcessor):
    """Per asset the last `rows` rows. Emits time_id, asset_id, the features and the prediction; a time that doesn't rise is an error."""

    def __init__(self, columns: Sequence[str], rows: int, features: Features, names: Sequence[str], predict: Callable[[np.ndarray], np.ndarray]) -> None:
        self.columns, self.rows, self.features, self.names, self.predict = list(columns), rows, features, list(names), predict

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.past = handle.getListState("past", StructType([StructField("time_id", LongType()), StructField("values", ArrayType(DoubleType()))]))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        rows = [(int(x["time_id"]), [float(x[c]) for c in self.columns]) for state in initialState["state"] for x in state]
        if rows:
            self.past.put(sorted(rows)[-self.rows :])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("time_id", kind="stable")
        held = [(int(r[0]), list(r[1])) for r in self.past.get()] if self.past.exists() else []
        made = []
        for t, *values in new[["time_id", *self.columns]].itertuples(index=False):
            if held and t <= held[-1][0]:
                raise ValueError("time_id must rise for each asset")
            now = [float(v) for v in values]
            past = held[-self.rows :]
            made.append(self.features(np.array([a for a, _ in past], np.int64), np.array([b for _, b in past], float).reshape(len(past), len(now)), int(t), np.array(now)))
            held = [*past, (int(t), now)]
        self.past.put(held[-self.rows :])
        x = np.array(made, float).reshape(len(made), len(self.names))
        out = pd.DataFrame(x, columns=self.names)
        out.insert(0, "time_id", new["time_id"].to_numpy())
        out.insert(1, "asset_id", int(key[0]))
        out["prediction"] = self.predict(x)
        yield out

    def close(self) -> None:
        pass


def predictions(stream: DataFrame, state: DataFrame | None, processor: Predictor) -> DataFrame:
    """A stream of predictions. state: asset_id and state, as design.saved_state() gives it, or None for a cold start; taken up by the first batch only."""
    schema = StructType([StructField("time_id", LongType()), StructField("asset_id", LongType()), *[StructField(n, DoubleType()) for n in processor.names], StructField("prediction", DoubleType())])
    own = stream.select("time_id", "asset_id", *processor.columns)
    return own.groupBy("asset_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="none", initialState=None if state is None else state.groupBy("asset_id"))


def predict_files(spark: SparkSession, source: str, schema: StructType, state: str | None, processor: Predictor, folder: str, partitions: int = 8, files_per_batch: int = 1) -> DataFrame:
    """Predict all Parquet files of `source` that aren't predicted yet, `files_per_batch` in each micro-batch, in the order in which they came; all rows so far.

    Called again with the same folder (which executors share), it goes on from its checkpoint: what is done isn't done again, and the state in
    the Parquet table `state` counts at the first call only. Settings of streams belong to a session of their own; those of `spark` stay.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", str(partitions))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    stream = own.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    out = predictions(stream, None if state is None else own.read.parquet(state), processor)
    query = out.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/progress").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/rows")


def held_rows(spark: SparkSession, folder: str) -> DataFrame:
    """What the state of predict_files() holds after its last batch: asset_id, time_id, values. A batch can go on from it."""
    state = spark.read.format("statestore").option("path", f"{folder}/progress").option("stateVarName", "past").option("flattenCollectionTypes", "true").load()
    return state.selectExpr("key.asset_id", "list_element.time_id", "list_element.values")


def recent_features(past_times: np.ndarray, past: np.ndarray, time: int, now: np.ndarray) -> list[float]:
    """Of the first column: the value before (0 if there is none), the mean of all rows held, the deviation from it, and the time since the last row."""
    if not len(past):
        return [0.0, 0.0, float(now[0]), 0.0]
    mean = float(past[:, 0].mean())
    return [float(past[-1, 0]), mean, float(now[0]) - mean, float(time - past_times[-1])]


#: Names of what recent_features() makes.
RECENT = ("lag1", "mean", "deviation", "gap")
