"""Histogram boosting against a booster in one process that looks at rows, leaf by leaf."""

import math

import numpy as np
import pytest

from lattica.operators import boosting, models
from lattica.operators.boosting import Job, Settings


def table(n=600, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, size=(n, 3)).astype(float)
    asset = rng.integers(0, 6, n).astype(float)
    y = np.round(np.where(x[:, 0] > 5, 3, -1) + np.isin(asset, [1, 4]) * 4 + x[:, 1] * 0.5 + rng.normal(size=n) * 2, 2)
    w = rng.integers(0, 4, n).astype(float)
    return x, asset, y, w


def frame(spark, n=600, seed=1, parts=3):
    x, asset, y, w = table(n, seed)
    rows = [(k, int(asset[k]), *map(float, x[k]), float(asset[k]), float(y[k]), float(w[k])) for k in range(n)]
    return spark.createDataFrame(rows, "time_id long, asset_id long, a double, b double, c double, asset double, target double, weight double").repartition(parts)


def plain(x, kinds, y, w, s: Settings, rounds):
    """Best-first growth on the rows themselves; every value of x is an edge."""
    margin = np.full(len(y), (w * y).sum() / w.sum())
    for _ in range(rounds):
        g = margin - y if s.huber is None else np.clip(margin - y, -s.huber, s.huber)
        g, h = g * w, w
        score = lambda r: g[r].sum() ** 2 / (h[r].sum() + s.l2)

        def best(rows):
            out = (0.0, None)
            for f in range(x.shape[1]):
                values = np.unique(x[rows, f])
                if kinds[f]:
                    values = sorted(values, key=lambda v: g[rows][x[rows, f] == v].sum() / (h[rows][x[rows, f] == v].sum() + s.smooth))
                for k in range(1, len(values)):
                    left = np.isin(x[rows, f], values[:k])
                    a, b = rows[left], rows[~left]
                    if min(len(a), len(b)) < s.least_rows or min(h[a].sum(), h[b].sum()) <= 0:
                        continue
                    gain = score(a) + score(b) - score(rows)
                    if gain > out[0] + 1e-9:
                        out = (gain, (a, b))
            return out

        leaves = [np.arange(len(y))]
        while len(leaves) < s.leaves:
            found = [best(r) for r in leaves]
            k = int(np.argmax([gain for gain, _ in found]))
            if found[k][1] is None:
                break
            leaves = [r for i, r in enumerate(leaves) if i != k] + list(found[k][1])
        for r in leaves:
            if len(leaves) > 1 and h[r].sum() > 0:
                margin[r] -= s.rate * g[r].sum() / (h[r].sum() + s.l2)
    return margin


FEATURES = ["a", "b", "c", "asset"]


def predicted(forest, x, asset):
    return forest(np.column_stack([x, asset]))


@pytest.mark.parametrize("s", [Settings(rounds=3, leaves=6, rate=0.3, least_rows=10), Settings(rounds=12, leaves=4, rate=0.5, l2=5.0, least_rows=25), Settings(rounds=2, leaves=40, least_rows=15, huber=1.5), Settings(rounds=2, leaves=2), Settings(rounds=1, leaves=7, least_rows=10_000)], ids=str)
def test_trees_equal_a_plain_booster(spark, s):
    x, asset, y, w = table()
    forest = boosting.boost(frame(spark), FEATURES, [Job(("one",))], s, categorical=["asset"])["one",]
    want = plain(np.column_stack([x, asset]), [False] * 3 + [True], y, w, s, s.rounds)
    assert np.allclose(predicted(forest, x, asset), want, atol=1e-9)
    assert len(forest.trees) == s.rounds and max(len(t.leaves) for t in forest.trees) <= s.leaves
    again = models.Forest(models.parse_forest(boosting.forest_text(forest)))
    assert np.array_equal(predicted(again, x, asset), predicted(forest, x, asset))


def test_jobs_share_passes_and_are_those_grown_alone(spark):
    s = Settings(rounds=3, leaves=5, rate=0.4, least_rows=10, row_share=0.7, column_share=0.7)
    df = frame(spark)
    jobs = [Job(("a", 0), 0, (0, 299)), Job(("a", 1), 1, (0, 299)), Job(("b", 0), 0, (200, 599), None, (0, 3))]
    together = boosting.boost(df, FEATURES, jobs, s, categorical=["asset"])
    x, asset, *_ = table()
    for job in jobs:
        alone = boosting.boost(frame(spark, parts=5), FEATURES, [job], s, categorical=["asset"])[job.name]
        assert np.allclose(predicted(alone, x, asset), predicted(together[job.name], x, asset), atol=1e-9)
    assert not np.allclose(predicted(together["a", 0], x, asset), predicted(together["a", 1], x, asset))
    assert {int(f) for t in together["b", 0].trees for f in t.feature} <= {0, 3}
    mean = boosting.seed_forests({k: f for k, f in together.items() if k[0] == "a"})
    assert np.allclose(predicted(mean, x, asset), (predicted(together["a", 0], x, asset) + predicted(together["a", 1], x, asset)) / 2)


def test_early_stopping_keeps_the_best_number_of_trees(spark):
    x, asset, y, w = table(400, 3)
    s = Settings(rounds=14, leaves=12, rate=0.9, least_rows=5, patience=3)
    forest = boosting.boost(frame(spark, 400, 3), FEATURES, [Job(("one",), 0, (0, 199), (200, 399))], s, categorical=["asset"])["one",]
    whole = boosting.boost(frame(spark, 400, 3), FEATURES, [Job(("one",), 0, (0, 199))], Settings(rounds=14, leaves=12, rate=0.9, least_rows=5), categorical=["asset"])["one",]
    v = slice(200, 400)
    scores = []
    for k in range(1, 15):
        p = models.Forest(whole.trees, k)(np.column_stack([x, asset]))
        scores.append(1 - (w[v] * (y[v] - p[v]) ** 2).sum() / (w[v] * y[v] ** 2).sum())
    best = next(k for k in range(14) if k + 3 >= 14 or max(scores[k + 1 : k + 4]) <= scores[k] and scores[k] == max(scores[: k + 1]))
    assert len(forest.trees) == 1 + best < 14
    assert np.allclose(predicted(forest, x, asset), models.Forest(whole.trees, 1 + best)(np.column_stack([x, asset])))


def test_odd_tables(spark):
    schema = "time_id long, asset_id long, a double, asset double, target double, weight double"
    rows = [(k, 0, [float("nan"), None, float("inf"), 5.0][k % 4], float(k % 2), [None, float("nan"), 2.0, 4.0][k % 4], [None, -1.0, 1.0, 1.0][k % 4]) for k in range(80)]
    df = spark.createDataFrame(rows, schema)
    forest = boosting.boost(df, ["a", "asset"], [Job(("one",))], Settings(rounds=1, leaves=2, rate=1.0, least_rows=1), categorical=["asset"])["one",]
    # rows without weight count for nothing; a missing feature is 0
    assert forest(np.array([[5.0, 1.0], [0.0, 0.0], [math.nan, 0.0]])).tolist() == [4.0, 2.0, 2.0]
    same = boosting.boost(df.withColumn("target", 0 * df.time_id + 7.0), ["a", "asset"], [Job(("one",))], Settings(rounds=2), categorical=["asset"])["one",]
    assert same(np.zeros((2, 2))).tolist() == [7.0, 7.0]
    with pytest.raises(ValueError, match="no rows"):
        boosting.boost(df, ["a"], [Job(("none",), 0, (1000, 2000))])
    with pytest.raises(ValueError, match="no rows"):
        boosting.boost(spark.createDataFrame([], schema), ["a"], [Job(("none",))])
    with pytest.raises(ValueError, match="categories"):
        boosting.boost(df.withColumn("asset", df.asset - 1), ["asset"], [Job(("one",))], categorical=["asset"])


def test_edges_are_values_at_even_ranks(spark):
    df = spark.createDataFrame([(float(k),) for k in range(1000)], "x double")
    assert boosting.fit_edges(df, ["x"], 4)["x"] == [249.0, 499.0, 749.0]
    assert boosting.fit_edges(spark.createDataFrame([(1.0,), (2.0,), (2.0,)], "x double"), ["x"])["x"] == [1.0]
    assert boosting.fit_edges(spark.createDataFrame([], "x double"), ["x"])["x"] == []
