"""Linear models from Gram matrices: Spark adds them up block by block, the driver solves what is left (a few hundred columns)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a design: a Gram matrix is this many squared.
MAX_COLUMNS = 2_000


@dataclass
class Gram:
    """Weighted sums over rows of [1, X, Y]: products of all pairs; names of X and Y."""

    products: np.ndarray
    x: list[str]
    y: list[str]

    @property
    def weight(self) -> float:
        return float(self.products[0, 0])

    def normal(self, intercept: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Normal equations of X; with an intercept both are centred."""
        p, n = self.products, len(self.x)
        a, b = p[1 : n + 1, 1 : n + 1].copy(), p[1 : n + 1, n + 1 :].copy()
        if intercept and self.weight > 0:
            a -= np.outer(p[0, 1 : n + 1], p[0, 1 : n + 1]) / self.weight
            b -= np.outer(p[0, 1 : n + 1], p[0, n + 1 :]) / self.weight
        return a, b

    def __add__(self, other: "Gram") -> "Gram":
        return Gram(self.products + other.products, self.x, self.y)


def _block(pdf, x: Sequence[str], y: Sequence[str], weight: str | None) -> np.ndarray:
    m = np.nan_to_num(pdf[[*x, *y]].to_numpy(np.float64), nan=0.0, posinf=0.0, neginf=0.0)
    m = np.concatenate([np.ones((len(m), 1)), m], axis=1)
    w = np.ones(len(m)) if weight is None else np.maximum(np.nan_to_num(pdf[weight].to_numpy(np.float64)), 0)
    return (m * w[:, None]).T @ m


def grams(df: DataFrame, x: Sequence[str], y: Sequence[str], weight: str | None = None, by: str | None = None) -> dict:
    """Gram matrices of all rows (key None) or per value of `by`, which must have few values. Missing values count as 0.

    Each task adds up its own blocks to one matrix per key; these meet cell by cell in a grouped sum, so the driver gets keys x columns^2 numbers.
    """
    if len(x) + len(y) > MAX_COLUMNS:
        raise ValueError("too many columns for one Gram matrix")
    size = 1 + len(x) + len(y)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            pdf = batch.to_pandas()
            for key, part in [(None, pdf)] if by is None else pdf.groupby(by, dropna=False):
                sums[key] = sums.get(key, 0) + _block(part, x, y, weight)
        for key, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([None if key is None else str(key)] * size, pa.string()), pa.array(np.arange(size)), pa.array(list(m))], ["key", "row", "values"])

    own = df.select(*x, *y, *([weight] if weight else []), *([by] if by else []))
    cells = own.mapInArrow(partial, "key string, row long, values array<double>").select("key", "row", F.posexplode("values").alias("col", "v"))
    out: dict = {}
    for r in cells.groupBy("key", "row", "col").agg(F.sum("v").alias("v")).collect():
        out.setdefault(r["key"], np.zeros((size, size)))[r["row"], r["col"]] = r["v"]
    return {k: Gram(m, list(x), list(y)) for k, m in out.items()}


def gram(df: DataFrame, x: Sequence[str], y: Sequence[str], weight: str | None = None) -> Gram:
    found = grams(df, x, y, weight)
    return found.get(None, Gram(np.zeros((1 + len(x) + len(y),) * 2), list(x), list(y)))


@dataclass
class Linear:
    intercept: np.ndarray
    weights: np.ndarray

    def column(self, x: Sequence[str], target: int = 0):
        from ..functions.numeric import linear_predict

        return linear_predict([F.col(c) for c in x], self.weights[:, target].tolist(), float(self.intercept[target]))


def ridge(g: Gram, alpha: float, intercept: bool = True) -> Linear:
    """alpha is added to sums over rows, so it means less the more rows there are. All targets share the matrix."""
    a, b = g.normal(intercept)
    w = np.linalg.solve(a + alpha * np.eye(len(a)), b)
    n = len(g.x)
    means = g.products[0, 1:] / g.weight if g.weight > 0 else np.zeros(n + len(g.y))
    return Linear(means[n:] - means[:n] @ w if intercept else np.zeros(len(g.y)), w)


def alpha_path(g: Gram, alphas: Sequence[float], relative: bool = False) -> dict[float, Linear]:
    """All penalties from one matrix; relative ones are multiples of its mean diagonal."""
    unit = float(np.trace(g.normal()[0])) / max(len(g.x), 1) if relative else 1.0
    return {a: ridge(g, a * unit) for a in alphas}


def residual_share(g: Gram, model: Linear, target: int = 0) -> tuple[float, float]:
    """1 - error / energy of the target: around its mean, and around 0."""
    n = len(g.x)
    c = np.concatenate([[model.intercept[target]], model.weights[:, target]])
    p, k = g.products, n + 1 + target
    error = p[k, k] - 2 * c @ p[: n + 1, k] + c @ p[: n + 1, : n + 1] @ c
    centred = p[k, k] - p[0, k] ** 2 / g.weight
    return float(1 - error / centred) if centred > 0 else 0.0, float(1 - error / p[k, k]) if p[k, k] > 0 else 0.0


def shrunk_ridge(per_key: dict, alpha: float, kappa: float) -> dict:
    """A model per key from its own equations plus kappa times the pooled ones, scaled to one key's weight; kappa = inf is the pooled model."""
    pooled = sum(list(per_key.values())[1:], list(per_key.values())[0])
    if np.isinf(kappa):
        whole = ridge(pooled, alpha)
        return {k: whole for k in per_key}
    return {k: ridge(Gram(g.products + kappa * g.weight / max(pooled.weight, 1e-30) * pooled.products, g.x, g.y), alpha) for k, g in per_key.items()}


def slopes(df: DataFrame, by: Sequence[str], x: str, target: str = "target", weight: str = "weight", shrink: float = 0.0) -> DataFrame:
    """(sum w x y + s) / (sum w x^2 + s) per key: 1 where nothing is known and s > 0."""
    w = F.greatest(F.col(weight), F.lit(0.0))
    return df.groupBy(*by).agg(F.try_divide(F.sum(w * F.col(x) * F.col(target)) + shrink, F.sum(w * F.col(x) ** 2) + shrink).alias("slope"))


def best_blend(matrix: np.ndarray, alignment: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights G^-1 v of components, and the peak v'c they reach."""
    c = np.linalg.solve(matrix, alignment)
    return c, float(alignment @ c)


def frozen_score(matrix: np.ndarray, alignment: np.ndarray, c: np.ndarray) -> float:
    return float(2 * c @ alignment - c @ matrix @ c)


def lasso(g: Gram, count: int, steps: int = 100) -> np.ndarray:
    """Weights of a lasso with at most `count` columns, by coordinate descent over falling penalties on the standardised Gram matrix."""
    a, b = g.normal()
    scale = np.sqrt(np.maximum(np.diag(a), 1e-30))
    a, b = a / np.outer(scale, scale), b[:, 0] / scale
    w, best = np.zeros(len(b)), np.zeros(len(b))
    for penalty in np.geomspace(np.abs(b).max(initial=1e-12), np.abs(b).max(initial=1e-12) * 1e-3, steps):
        for _ in range(1000):
            old = w.copy()
            for j in range(len(b)):
                rest = b[j] - a[j] @ w + a[j, j] * w[j]
                w[j] = np.sign(rest) * max(abs(rest) - penalty, 0) / max(a[j, j], 1e-30)
            if np.abs(w - old).max() < 1e-10:
                break
        if np.count_nonzero(w) > count:
            break
        best = w.copy()
    return best / scale


def principal_axes(g: Gram, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest variances and their directions (columns), each with its largest entry positive."""
    a, _ = g.normal()
    values, vectors = np.linalg.eigh(a / max(g.weight, 1e-30))
    vectors = vectors[:, ::-1][:, :k]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values[::-1][:k], vectors * signs


def correlation_matrix(g: Gram) -> np.ndarray:
    a, _ = g.normal()
    s = np.sqrt(np.maximum(np.diag(a), 1e-30))
    return a / np.outer(s, s)


def average_linkage(distance: np.ndarray, clusters: int | None = None, cut: float | None = None) -> list[int]:
    """Labels of average-linkage clusters, cut at a number or a distance; for some dozens of items."""
    groups = {i: [i] for i in range(len(distance))}
    while len(groups) > (clusters or 1):
        keys = sorted(groups)
        d, i, j = min((float(distance[np.ix_(groups[a], groups[b])].mean()), a, b) for n, a in enumerate(keys) for b in keys[n + 1 :])
        if cut is not None and d > cut:
            break
        groups[i] = groups[i] + groups.pop(j)
    labels = [0] * len(distance)
    for label, members in enumerate(sorted(groups.values(), key=min)):
        for m in members:
            labels[m] = label
    return labels


def fourier_gram(df: DataFrame, x: Sequence[str], target: str, width: int, bandwidth: float, seed: int) -> Gram:
    """Gram matrix of sqrt(2 / width) cos(x Omega + phase), made in each batch and never stored."""
    rng = np.random.default_rng(seed)
    omega, shift = rng.normal(0, 1 / bandwidth, (len(x), width)), rng.uniform(0, 2 * np.pi, width)
    names = [f"z{k}" for k in range(width)]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pdf = batch.to_pandas()
            z = np.sqrt(2 / width) * np.cos(np.nan_to_num(pdf[list(x)].to_numpy(float)) @ omega + shift)
            yield pa.RecordBatch.from_arrays([*(pa.array(z[:, k]) for k in range(width)), pa.array(pdf[target].to_numpy(float))], [*names, target])

    wide = df.select(*x, target).mapInArrow(features, ", ".join(f"{n} double" for n in [*names, target]))
    return gram(wide, names, [target])


def median_distance(df: DataFrame, x: Sequence[str], key: str, sample: int = 500) -> float:
    """Median distance between pairs of at most `sample` rows, those with the least hash of the key."""
    rows = df.orderBy(F.xxhash64(key), key).limit(sample).select(*x).toPandas().to_numpy(float)
    d = np.sqrt(np.maximum(((rows[:, None, :] - rows[None, :, :]) ** 2).sum(axis=2), 0))
    return float(np.median(d[np.triu_indices(len(rows), 1)])) if len(rows) > 1 else 1.0


def two_basis(weights: np.ndarray) -> np.ndarray:
    """Weights for [mean, deviation] blocks as weights for [raw, deviation]: with raw = mean + deviation, (b_m, b_d - b_m)."""
    half = len(weights) // 2
    return np.concatenate([weights[:half], weights[half:] - weights[:half]])


def vertex(s0: float, s1: float, s2: float, t3: float) -> float | None:
    """Where the parabola through (0, s0), (1, s1), (t3, s2) peaks; None if it doesn't curve down."""
    a, b = np.linalg.solve([[1, 1], [t3 * t3, t3]], [s1 - s0, s2 - s0])
    return float(-b / (2 * a)) if a < 0 else None


def pick_alpha(df: DataFrame, x: Sequence[str], target: str, weight: str | None, alphas: Sequence[float], share: float = 0.8, relative: bool = False) -> tuple[float, dict[float, float], Linear]:
    """A penalty by an inner split: fitted on the first `share` of the distinct times, scored (1 - error / energy) on the rest, then fitted anew on all rows.

    Returns the best penalty (the larger of equals), the scores of all, and the model. Both parts come from one pass of Gram matrices. Relative penalties are multiples of the mean diagonal.
    """
    from . import ranks

    times = ranks.numbered(df.select("time_id").distinct(), ["time_id"], "_place")
    cut = int(times.count() * share)
    first = times.filter(F.col("_place") < cut).agg(F.max("time_id")).first()[0]
    if first is None or cut == times.count():
        raise ValueError("too few times for an inner split")
    parts = grams(df.withColumn("_part", (F.col("time_id") > first).cast("int")), x, [target], weight, by="_part")
    path = alpha_path(parts["0"], alphas, relative)
    scores = {a: residual_share(parts["1"], m)[1] for a, m in path.items()}
    best = max(alphas, key=lambda a: (scores[a], a))
    return best, scores, alpha_path(parts["0"] + parts["1"], [best], relative)[best]


def smoothing_peak(a: float, a_lag: float, b: float, r: float, d: float, rho: float) -> float | None:
    """Peak of p + rho p_lag at its best scale, from sums a = w y p, a_lag = w y p_lag, b = w p^2 (of both), r = w p p_lag, d = w y^2; None without energy."""
    energy = b * (1 + rho * rho) + 2 * rho * r
    return (a + rho * a_lag) ** 2 / (d * energy) if energy > 0 and d > 0 else None


def smoothing(psi: float, r: float) -> float:
    """Best share of the previous value: (psi - r) / (1 - psi r)."""
    return (psi - r) / (1 - psi * r)


def blend_gain(r: float, rho: float) -> float:
    """Relative gain of the best blend of two predictions with strength ratio r and correlation rho."""
    return float(np.sqrt((1 + r * r - 2 * rho * r) / (1 - rho * rho)) - 1)


def shrunk_phase_scales(totals: DataFrame, kappa: float) -> DataFrame:
    """Per phase, (v + kappa V) / (g + kappa G), with sums V, G over all phases; kappa = inf is the pooled scale."""
    pooled = F.broadcast(totals.agg(F.sum("v").alias("_v"), F.sum("g").alias("_g")))
    both = totals.crossJoin(pooled)
    scale = F.try_divide(F.col("_v"), F.col("_g")) if np.isinf(kappa) else F.try_divide(F.col("v") + kappa * F.col("_v"), F.col("g") + kappa * F.col("_g"))
    return both.select("phase", scale.alias("scale"))


def calibration_weights(df: DataFrame, residual: str, auxiliaries: Sequence[str], weight: str = "weight", penalty: float = 1e-8) -> np.ndarray:
    """Weights of auxiliary predictions that best explain a residual, without intercept; the penalty is relative to the mean diagonal, or to 1 if that is less."""
    g = gram(df, list(auxiliaries), [residual], weight)
    a, b = g.normal(intercept=False)
    return np.linalg.solve(a + penalty * max(float(np.trace(a)) / max(len(a), 1), 1.0) * np.eye(len(a)), b[:, 0])


def binned_weights(df: DataFrame, state: str, edges: Sequence[float], residual: str, estimate: str, weight: str = "weight", least: int = 100) -> DataFrame:
    """Per bin of a state (numbered by how many edges are at or below it) the weight of an estimate that best explains the residual: bin, n, share.

    Bins of at most `least` rows have the weight over all rows; 1 where the estimate has no energy.
    """
    from .split import bucket

    w = F.greatest(F.coalesce(F.col(weight), F.lit(0.0)), F.lit(0.0))
    sums = df.groupBy(bucket(F.col(state), edges).alias("bin")).agg(F.count("*").alias("n"), F.sum(w * F.col(residual) * F.col(estimate)).alias("v"), F.sum(w * F.col(estimate) ** 2).alias("g"))
    bins = df.sparkSession.range(len(set(edges)) + 1).select(F.col("id").cast("int").alias("bin"))
    whole = F.broadcast(sums.agg(F.sum("v").alias("_v"), F.sum("g").alias("_g")))
    few = F.coalesce(F.col("n"), F.lit(0)) <= least
    share = F.when(few, F.try_divide("_v", "_g")).otherwise(F.try_divide("v", "g"))
    return bins.join(F.broadcast(sums), "bin", "left").crossJoin(whole).select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(share, F.lit(1.0)).alias("share"))


def blended_by_bin(df: DataFrame, weights: DataFrame, state: str, edges: Sequence[float], market: str, estimate: str) -> DataFrame:
    """market + share of the row's bin x estimate, as `prediction`."""
    from .split import bucket

    return df.withColumn("bin", bucket(F.col(state), edges)).join(F.broadcast(weights.select("bin", "share")), "bin").withColumn("prediction", F.col(market) + F.col("share") * F.col(estimate))


def block_ridge(df: DataFrame, x: Sequence[str], alpha: float, target: str = "target", weight: str = "weight", by: str = "asset_id") -> dict:
    """Ridge without intercept over the design that has a block of columns per key: its matrix is block-diagonal, so each key's equations are solved alone."""
    return {k: ridge(g, alpha, intercept=False) for k, g in grams(df, list(x), [target], weight, by=by).items()}


def scale_artefact(slopes_by_asset: DataFrame) -> DataFrame:
    """Fitted scales (asset_id, slope) as one row of JSON, as stored beside a model."""
    return slopes_by_asset.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("asset_id").cast("string"), "slope"))))).alias("scales"))


def apply_scales(df: DataFrame, artefact: str, prediction: str = "prediction") -> DataFrame:
    """Predictions times the stored scale of their asset; assets that have none keep theirs."""
    scales = F.from_json(F.lit(artefact), "map<string,double>")
    return df.withColumn(prediction, F.col(prediction) * F.coalesce(F.try_element_at(scales, F.col("asset_id").cast("string")), F.lit(1.0)))
