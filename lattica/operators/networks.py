"""Small dense networks trained over tables: each step adds up the gradient of all rows in the tasks and moves the weights once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import positive_weight, zero_if_missing
from ..sources.tables import scratch
from .models import Network

#: Rows that a task works on at once, and partial gradients that reach the driver after a first sum in the tasks.
CHUNK, SUMS = 8_192, 8


@dataclass(frozen=True)
class Training:
    """Hidden layers (relu between, none at the end), steps over all rows, and how a step moves: "adam", or "plain" against the gradient.

    decay is the factor of half the squared weights (not of biases) in the loss, which is half the weighted mean squared error, summed over targets.
    """

    hidden: tuple[int, ...] = (48,)
    steps: int = 100
    rate: float = 1e-3
    decay: float = 0.0
    optimizer: str = "adam"
    seed: int = 0

    def __post_init__(self) -> None:
        if self.optimizer not in ("adam", "plain"):
            raise ValueError("the optimizer must be adam or plain")


@dataclass
class Trained:
    """A network for standardised targets, with their means and deviations."""

    layers: list[tuple[np.ndarray, np.ndarray]]
    mean: np.ndarray
    std: np.ndarray
    losses: list[float]

    def predict_all(self, x: np.ndarray) -> np.ndarray:
        """One column per target, in the targets' own units."""
        return forward(self.layers, x)[-1] * self.std + self.mean

    def network(self, target: int = 0) -> Network:
        """The network of one target, as models.Network applies it: mean and deviation go into the last layer."""
        w, b = self.layers[-1]
        return Network([*self.layers[:-1], (w[:, [target]] * self.std[target], b[[target]] * self.std[target] + self.mean[target])])


def initial(sizes: Sequence[int], seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weights and biases drawn evenly from +-sqrt(6 / (inputs + outputs)) of each layer."""
    rng = np.random.default_rng(seed)
    layers = []
    for a, b in zip(sizes[:-1], sizes[1:]):
        bound = np.sqrt(6 / (a + b))
        layers.append((rng.uniform(-bound, bound, (a, b)), rng.uniform(-bound, bound, b)))
    return layers


def forward(layers: Sequence[tuple[np.ndarray, np.ndarray]], x: np.ndarray) -> list[np.ndarray]:
    """The input and each layer's output."""
    out = [x]
    for k, (w, b) in enumerate(layers):
        z = out[-1] @ w + b
        out.append(np.maximum(z, 0) if k + 1 < len(layers) else z)
    return out


def gradient(layers: Sequence[tuple[np.ndarray, np.ndarray]], x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums over rows by backpropagation: half the weighted squared error, then the gradient of all weights and biases, layer by layer."""
    outputs = forward(layers, x)
    error = outputs[-1] - y
    parts = []
    back = error * w[:, None]
    for k in range(len(layers) - 1, -1, -1):
        parts.append(np.concatenate([(outputs[k].T @ back).ravel(), back.sum(axis=0)]))
        if k:
            back = (back @ layers[k][0].T) * (outputs[k] > 0)
    return np.concatenate([[0.5 * (w[:, None] * error**2).sum()], *parts[::-1]])


def _flat(layers) -> np.ndarray:
    return np.concatenate([np.concatenate([w.ravel(), b]) for w, b in layers])


def _layers(flat: np.ndarray, sizes: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in zip(sizes[:-1], sizes[1:]):
        out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def train(df: DataFrame, features: Sequence[str], targets: Sequence[str], weight: str | None = None, training: Training = Training(), start: Sequence[tuple[np.ndarray, np.ndarray]] | None = None) -> Trained:
    """A network for one or several targets at once. Missing values are 0, and so are missing and negative weights; targets are standardised by weight.

    Features, targets and weights are packed in chunks of rows once, under spark.checkpoint.dir. A step sends the weights to the tasks, which
    add up their rows' gradients; SUMS rows of that size reach the driver. Sums are taken in order of the tasks, so reruns give the same bits. Without weight at all it is an error.
    """
    names, wanted = list(features), list(targets)
    w = positive_weight(F.col(weight)) if weight else F.lit(1.0)
    own = df.select(*[zero_if_missing(F.col(c).cast("double")).alias(f"_{k}") for k, c in enumerate([*names, *wanted])], w.cast("double").alias("_w"))
    spark = df.sparkSession
    path = scratch(spark, "network-rows")
    own.mapInArrow(_chunked(len(names) + len(wanted) + 1), "rows binary").write.parquet(path)
    chunks = spark.read.schema("rows binary").parquet(path)
    wide = len(names) + len(wanted) + 1

    def moments(x: np.ndarray) -> np.ndarray:
        y, v = x[:, len(names) : -1], x[:, -1]
        return np.concatenate([[v.sum()], v @ y, v @ y**2])

    total = _summed(chunks, wide, moments)
    if total is None or total[0] <= 0:
        raise ValueError("no row has weight")
    k = len(wanted)
    mean = total[1 : k + 1] / total[0]
    # a target without variance, or nearly, keeps its scale
    std = np.maximum(np.sqrt(np.maximum(total[k + 1 :] / total[0] - mean**2, 0)), 1e-8)
    sizes = [len(names), *training.hidden, k]
    flat = _flat(start if start is not None else initial(sizes, training.seed)).copy()
    decayed = _flat([(np.ones_like(a), np.zeros_like(b)) for a, b in _layers(flat, sizes)])
    first, second, losses = np.zeros_like(flat), np.zeros_like(flat), []
    for step in range(1, training.steps + 1):
        layers = _layers(flat, sizes)

        def part(x: np.ndarray, layers=layers) -> np.ndarray:
            return gradient(layers, x[:, : len(names)], (x[:, len(names) : -1] - mean) / std, x[:, -1])

        sums = _summed(chunks, wide, part) / total[0]
        losses.append(float(sums[0] + 0.5 * training.decay * (decayed * flat**2).sum()))
        g = sums[1:] + training.decay * decayed * flat
        if training.optimizer == "plain":
            flat = flat - training.rate * g
        else:
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            flat = flat - training.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return Trained([(a.copy(), b.copy()) for a, b in _layers(flat, sizes)], mean, std, losses)


def _chunked(wide: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(wide)], axis=1)
            parts = [np.ascontiguousarray(x[a : a + CHUNK]).tobytes() for a in range(0, len(x), CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary())], ["rows"])

    return rows


def _summed(chunks: DataFrame, wide: int, part) -> np.ndarray | None:
    """The sum over all chunks of an array per chunk: per task, then in SUMS tasks in order of the first ones, then on the driver."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for batch in batches:
            for raw in batch.column("rows"):
                own = part(np.frombuffer(raw.as_py()).reshape(-1, wide))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "sums"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, least = None, None
        for batch in batches:
            for k, raw in zip(batch.column("part").to_pylist(), batch.column("sums").to_pylist()):
                own = np.frombuffer(raw)
                total, least = (own, k) if total is None else (total + own, least)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([least], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "sums"])

    first = chunks.mapInArrow(added, "part int, sums binary")
    rows = first.repartition(SUMS, F.col("part") % SUMS).sortWithinPartitions("part").mapInArrow(met, "part int, sums binary").collect()
    out = None
    for r in sorted(rows, key=lambda r: r["part"]):
        own = np.frombuffer(r["sums"])
        out = own.copy() if out is None else out + own
    return out


def save(trained: Trained, spark: SparkSession, path: str) -> None:
    """The network as Parquet: one row per layer (weights by input, biases), and one of number -1 with the targets' means and deviations."""
    rows = [(k, [w.tolist() for w in weights], biases.tolist()) for k, (weights, biases) in enumerate(trained.layers)]
    rows.append((-1, [trained.mean.tolist(), trained.std.tolist()], [float(v) for v in trained.losses]))
    spark.createDataFrame(rows, "layer int, weights array<array<double>>, biases array<double>").coalesce(1).write.mode("errorifexists").parquet(path)


def load(spark: SparkSession, path: str) -> Trained:
    found = {r["layer"]: r for r in spark.read.parquet(path).collect()}
    about = found.pop(-1)
    layers = [(np.array(found[k]["weights"]).reshape(len(found[k]["weights"]), -1), np.array(found[k]["biases"])) for k in sorted(found)]
    return Trained(layers, np.array(about["weights"][0]), np.array(about["weights"][1]), list(about["biases"]))
