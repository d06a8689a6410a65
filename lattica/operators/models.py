"""Models over panels: forests and small networks as Arrow functions, boosted trees by Spark ML, and how their outputs combine."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clip_symmetric
from .linear import Linear, gram, ridge
from .metrics import screen
from .split import Fold


@dataclass
class Tree:
    """Splits by number: x[feature] <= threshold goes left. A child >= 0 is a split, a child < 0 is leaf -child - 1. Categorical splits hold the values that go left."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaves: np.ndarray
    categories: dict[int, frozenset[int]] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """All rows go down one level at a time. A missing value counts as 0."""
        if not len(self.feature):
            return np.full(len(x), self.leaves[0])
        x = np.nan_to_num(x, nan=0.0)
        node = np.zeros(len(x), np.int64)
        open_rows = np.arange(len(x))
        while len(open_rows):
            at = node[open_rows]
            v = x[open_rows, self.feature[at]]
            goes_left = v <= self.threshold[at]
            for split, values in self.categories.items():
                own = at == split
                goes_left[own] = np.isin(v[own].astype(np.int64), list(values))
            node[open_rows] = np.where(goes_left, self.left[at], self.right[at])
            open_rows = open_rows[node[open_rows] >= 0]
        return self.leaves[-node - 1]


def parse_forest(text: str) -> list[Tree]:
    """Trees of a gradient-boosting model in the usual text format: sections of name=value lines, one per tree."""
    trees = []
    for section in text.split("Tree=")[1:]:
        values = dict(line.split("=", 1) for line in section.splitlines() if "=" in line)

        def numbers(name: str, kind=float) -> np.ndarray:
            return np.array([kind(v) for v in values.get(name, "").split()])

        if int(values["num_leaves"]) == 1:
            trees.append(Tree(*(np.zeros(0, np.int64),) * 4, numbers("leaf_value")))
            continue
        decision, threshold = numbers("decision_type", int), numbers("threshold")
        borders, words = numbers("cat_boundaries", int), numbers("cat_threshold", int)
        categories = {}
        for k in np.flatnonzero(decision & 1) if len(decision) else ():
            c = int(threshold[k])
            bits = words[borders[c] : borders[c + 1]]
            categories[int(k)] = frozenset(32 * w + b for w, bit in enumerate(bits.tolist()) for b in range(32) if bit >> b & 1)
        trees.append(Tree(numbers("split_feature", int), threshold, numbers("left_child", int), numbers("right_child", int), numbers("leaf_value"), categories))
    return trees


@dataclass
class Network:
    """Dense layers (weights, bias); relu between them, none at the end."""

    layers: list[tuple[np.ndarray, np.ndarray]]
    hidden: str = "relu"
    output: str = "identity"

    def __post_init__(self) -> None:
        if (self.hidden, self.output) != ("relu", "identity"):
            raise ValueError("only relu inside and identity at the end are supported")

    def predict(self, x: np.ndarray) -> np.ndarray:
        for k, (w, b) in enumerate(self.layers):
            x = x @ w + b
            if k + 1 < len(self.layers):
                x = np.maximum(x, 0)
        return x[:, 0]


def apply_model(df: DataFrame, predict: Callable[[np.ndarray], np.ndarray], features: Sequence[str], out: str = "prediction") -> DataFrame:
    """df with predict() over its features, batch by batch; the model goes to the tasks once, as a broadcast. Missing values are 0."""
    shared = df.sparkSession.sparkContext.broadcast(predict)
    kept = [c for c in df.columns if c != out]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([np.nan_to_num(batch.column(f).to_numpy(zero_copy_only=False).astype(float), posinf=0.0, neginf=0.0) for f in features], axis=1) if features else np.zeros((batch.num_rows, 0))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(shared.value(x).astype(float))], [*kept, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in kept)
    return df.select(*kept).mapInArrow(rows, f"{schema}, `{out}` double")


@dataclass
class Forest:
    """Trees, how many of them count (None: all), and whether any had a split that was allowed, be it of no use; without one a forest is a constant."""

    trees: list[Tree]
    rounds: int | None = None
    could_split: bool = True

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Sum over the first `rounds` trees (all if None): nested models are prefixes."""
        return sum((t.predict(x) for t in self.trees[: self.rounds]), np.zeros(len(x)))


def train_boosted(df: DataFrame, features: Sequence[str], target: str = "target", weight: str | None = None, rounds: int = 20, depth: int = 4, seed: int = 0):
    """Boosted trees by Spark ML (level by level, so its splits differ from leaf-wise libraries). Returns the fitted pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    settings = {"weightCol": weight} if weight else {}
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="keep"), GBTRegressor(featuresCol="_x", labelCol=target, maxIter=rounds, maxDepth=depth, seed=seed, **settings)]).fit(df)


def seed_mean(columns: Sequence[Column]) -> Column:
    return sum(columns[1:], columns[0]) / F.lit(float(len(columns)))


def hybrid(market_linear: Column, market_trees: Column, cross_linear: Column, cross_trees: Column, market_share: float, cross_share: float, scale: float = 1.0, most: float = 10.0) -> Column:
    """(1 - l) m_linear + l m_trees + (1 - b) e_linear + b e_trees, scaled, then cut."""
    market = (1 - market_share) * market_linear + market_share * market_trees
    return clip_symmetric(market + (1 - cross_share) * cross_linear + cross_share * cross_trees, most, scale)


def out_of_fold(df: DataFrame, folds: Sequence[Fold], features: Sequence[str], top: int, alpha: float) -> DataFrame:
    """Predictions of each fold's validation by a screen and a ridge fitted on its training alone, with the fold's number."""
    out = None
    for f in folds:
        train = df.filter(F.col("time_id").between(f.train_low, f.train_high))
        chosen = [r["feature"] for r in screen(train, features, top).collect()]
        model: Linear = ridge(gram(train, chosen, ["target"], "weight"), alpha)
        valid = df.filter(F.col("time_id").between(f.valid_low, f.valid_high)).select("time_id", "asset_id", "target", "weight", model.column(chosen).alias("prediction"), F.lit(f.fold).alias("fold"))
        out = valid if out is None else out.unionByName(valid)
    return out
