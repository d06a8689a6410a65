"""Networks trained over tables against the same steps in one process."""

import math

import numpy as np
import pytest

from lattica.operators import models, networks
from lattica.operators.networks import Training


def rows(n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = np.stack([np.sin(x[:, 0]) + x[:, 1] * x[:, 2], 5 + 3 * x[:, 1]], axis=1)
    return x, y, rng.integers(0, 3, n).astype(float)


def frame(spark, x, y, w, parts=3):
    return spark.createDataFrame([(*map(float, a), *map(float, b), float(c)) for a, b, c in zip(x, y, w)], "a double, b double, c double, y double, z double, w double").repartition(parts)


def plain(x, y, w, t: Training):
    """The same loss with numerical bookkeeping of its own: weights as lists, gradients by the chain rule per layer."""
    mean = (w @ y) / w.sum()
    std = np.sqrt((w @ (y - mean) ** 2) / w.sum())
    target = (y - mean) / std
    layers = [[a.copy(), b.copy()] for a, b in networks.initial([x.shape[1], *t.hidden, y.shape[1]], t.seed)]
    m = [[np.zeros_like(a), np.zeros_like(b)] for a, b in layers]
    v = [[np.zeros_like(a), np.zeros_like(b)] for a, b in layers]
    losses = []
    for step in range(1, t.steps + 1):
        outs = [x]
        for k, (a, b) in enumerate(layers):
            z = outs[-1] @ a + b
            outs.append(z if k == len(layers) - 1 else np.where(z > 0, z, 0))
        e = outs[-1] - target
        losses.append(0.5 * (w @ (e**2)).sum() / w.sum() + 0.5 * t.decay * sum((a**2).sum() for a, _ in layers))
        d = e * w[:, None] / w.sum()
        for k in range(len(layers) - 1, -1, -1):
            g = [outs[k].T @ d + t.decay * layers[k][0], d.sum(0)]
            d = (d @ layers[k][0].T) * (outs[k] > 0)
            for i in (0, 1):
                if t.optimizer == "plain":
                    layers[k][i] = layers[k][i] - t.rate * g[i]
                    continue
                m[k][i] = 0.9 * m[k][i] + 0.1 * g[i]
                v[k][i] = 0.999 * v[k][i] + 0.001 * g[i] ** 2
                layers[k][i] = layers[k][i] - t.rate * m[k][i] / (1 - 0.9**step) / (np.sqrt(v[k][i] / (1 - 0.999**step)) + 1e-8)
    return layers, losses, mean, std


@pytest.mark.parametrize("t", [Training(hidden=(5,), steps=6, rate=0.05, decay=0.01), Training(hidden=(4, 3), steps=5, rate=0.3, optimizer="plain", seed=2), Training(hidden=(), steps=4, rate=0.2)], ids=str)
def test_steps_equal_those_of_one_process(spark, t):
    x, y, w = rows()
    got = networks.train(frame(spark, x, y, w), ["a", "b", "c"], ["y", "z"], "w", t)
    layers, losses, mean, std = plain(x, y, w, t)
    assert np.allclose(got.losses, losses, rtol=1e-10) and np.allclose(got.mean, mean) and np.allclose(got.std, std)
    for (a, b), (c, d) in zip(got.layers, layers):
        assert np.allclose(a, c, atol=1e-10) and np.allclose(b, d, atol=1e-10)
    for k in (0, 1):
        assert np.allclose(got.network(k).predict(x), got.predict_all(x)[:, k])


def test_training_learns_and_is_stored(spark, tmp_path):
    x, y, w = rows(800, 1)
    df = frame(spark, x, y, w + 1)
    got = networks.train(df, ["a", "b", "c"], ["z"], "w", Training(hidden=(8,), steps=60, rate=0.05))
    assert got.losses[-1] < 0.2 * got.losses[0]
    networks.save(got, spark, f"file://{tmp_path}/net")
    again = networks.load(spark, f"file://{tmp_path}/net")
    assert np.array_equal(again.predict_all(x), got.predict_all(x)) and again.losses == got.losses
    with pytest.raises(Exception, match="exists"):
        networks.save(got, spark, f"file://{tmp_path}/net")
    out = models.apply_model(df, again.network().predict, ["a", "b", "c"]).toPandas()
    assert np.corrcoef(out["z"], out["prediction"])[0, 1] > 0.95


def test_missing_values_and_empty_tables(spark):
    schema = "a double, b double, c double, y double, z double, w double"
    df = spark.createDataFrame([(math.nan, None, math.inf, 1.0, None, 1.0), (0.0, 0.0, 0.0, 1.0, 0.0, None), (1.0, 1.0, 1.0, math.nan, 2.0, -3.0)], schema)
    got = networks.train(df, ["a", "b", "c"], ["y", "z"], "w", Training(hidden=(2,), steps=2))
    assert got.mean.tolist() == [1.0, 0.0] and np.isfinite(got.predict_all(np.zeros((1, 3)))).all()
    for empty in (df.limit(0), df.withColumn("w", df.w * 0)):
        with pytest.raises(ValueError, match="weight"):
            networks.train(empty, ["a"], ["y"], "w")
    with pytest.raises(ValueError, match="optimizer"):
        Training(optimizer="other")
