"""Paired comparisons of two arms: fold summaries, sign tests, block bootstraps and verdicts over tables of sums."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranks


def paired_summary(folds: DataFrame, base: str = "base", arm: str = "arm") -> DataFrame:
    """Over folds: mean difference, relative to the base, positive folds, and the mean without the best fold."""
    d = F.col(arm) - F.col(base)
    n = F.count("*")
    return folds.agg(n.alias("folds"), F.avg(d).alias("mean_difference"), F.try_divide(F.avg(d), F.avg(base)).alias("relative"), F.count_if(d > 0).alias("positive"), F.try_divide(F.sum(d) - F.max(d), n - 1).alias("without_best"))


def sign_test(positive: int, negative: int) -> float:
    """Two-sided exact binomial tail; ties are left out before."""
    n = positive + negative
    if not n:
        return 1.0
    tail = sum(math.comb(n, k) for k in range(max(positive, negative), n + 1)) / 2**n
    return min(1.0, 2 * tail)


def summary(df: DataFrame, column: str) -> DataFrame:
    """Mean, sample deviation (0 for one row), standard error, least and largest."""
    sd = F.coalesce(F.stddev_samp(column), F.lit(0.0))
    return df.agg(F.count("*").alias("n"), F.avg(column).alias("mean"), sd.alias("std"), (sd / F.sqrt(F.count("*"))).alias("se"), F.min(column).alias("least"), F.max(column).alias("largest"))


def _peak(v, g, d):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((g > 0) & (d > 0), v * v / (g * d), 0.0)


def _draw(seed: int, *parts: str):
    """A number below 2^32 from md5 of seed:part:part, the same on any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in parts])), 1, 8), 16, 10).cast("long")


def bootstrap_chunks(chunks: DataFrame, samples: int, seed: int, alpha: float = 0.05) -> DataFrame:
    """Confidence interval of the relative gain in peak, arm over base, when chunks are drawn anew; both arms see the same draws.

    chunks: rows (chunk, d, v_base, g_base, v_arm, g_arm), in order of chunk, whose numbers may have gaps. Draws are a table of their own that
    joins the sums, so replicates spread over tasks; each draw is a hash of seed, replicate and place.
    """
    n = chunks.count()
    spark = chunks.sparkSession
    chunks = ranks.numbered(chunks, ["chunk"], "_at").withColumn("chunk", F.col("_at")).drop("_at")
    draws = spark.range(samples).withColumnRenamed("id", "replicate").withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0)))))
    draws = draws.withColumn("chunk", F.pmod(_draw(seed, "replicate", "place"), F.lit(n)))
    sums = draws.join(chunks, "chunk").groupBy("replicate").agg(*[F.sum(c).alias(c) for c in ("d", "v_base", "g_base", "v_arm", "g_arm")])

    def peak(arm: str):
        return F.try_divide(F.col(f"v_{arm}") ** 2, F.col(f"g_{arm}") * F.col("d"))

    gain = F.try_divide(peak("arm"), peak("base")) - 1
    return sums.agg(F.percentile(gain, F.lit(alpha / 2)).alias("low"), F.percentile(gain, F.lit(1 - alpha / 2)).alias("high"), F.avg((gain > 0).cast("double")).alias("positive"))


def prefix_sums(cube: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Running sums over time of a cube of one row per time, with the row's place from 1: what sums of contiguous blocks come from. Added up by ranges of time."""
    sums = ranks.prefix_sums(cube.select("time_id", *columns), ["time_id"], {f"_sum_{c}": c for c in columns})
    return sums.select("time_id", (F.col("place") + 1).cast("int").alias("place"), *[F.col(f"_sum_{c}").alias(c) for c in columns])


def block_bootstrap(cube: DataFrame, columns: Sequence[str], block: int, samples: int, seed: int) -> DataFrame:
    """Sums of contiguous blocks of times drawn with replacement: rows (replicate, columns). A block's sum is the difference of two running sums."""
    sums = prefix_sums(cube, columns)
    n = sums.count()
    if block <= 0 or block > n:
        raise ValueError("a block must have at least one time and at most all")
    draws = cube.sparkSession.range(samples).withColumnRenamed("id", "replicate").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(-(-n // block)))))
    draws = draws.withColumn("start", F.pmod(_draw(seed, "replicate", "k"), F.lit(n - block + 1)))
    ends = sums.select((F.col("place") - block).alias("start"), *[F.col(c).alias(f"e_{c}") for c in columns])
    starts = sums.select(F.col("place").cast("long").alias("start"), *[F.col(c).alias(f"s_{c}") for c in columns])
    joined = draws.join(ends, "start").join(starts, "start", "left")
    return joined.groupBy("replicate").agg(*[F.sum(F.col(f"e_{c}") - F.coalesce(f"s_{c}", F.lit(0.0))).alias(c) for c in columns])


def detection_floor(low: float, high: float) -> float:
    """Half the width of a confidence interval: a gain below it can't be told from chance."""
    return abs(high - low) / 2


def phase_spread(phases: DataFrame) -> DataFrame:
    """Spread (population deviation) over phases of their own best scales v / g."""
    return phases.agg(F.stddev_pop(F.try_divide(F.col("v"), F.col("g"))).alias("spread"))


def pooled_by_energy(folds: DataFrame, difference: str = "difference", energy: str = "d") -> DataFrame:
    return folds.agg(F.try_divide(F.sum(F.col(difference) * F.col(energy)), F.sum(energy)).alias("pooled"))


def one_axis(rungs: Sequence[dict]) -> str:
    """The one parameter that the rungs of a ladder differ in; anything else is an error."""
    changed = sorted(k for k in rungs[0] if len({repr(r.get(k)) for r in rungs}) > 1)
    if len(changed) != 1:
        raise ValueError(f"rungs differ in {changed}")
    return changed[0]


def ladder(rungs: DataFrame, axis: str, value: str = "gain", anchor: tuple[float, float] | None = None, tolerance: float = 1e-9, gate: float = 0.05, climb: float = 0.2) -> DataFrame:
    """A ladder of runs that differ in one parameter: best (its rung), best_value, passes (best_value >= gate), climbing, turned.

    rungs: one row per rung, few rows. climbing: the last rung's value exceeds the one before by `climb` of it, so the ladder ends too early; turned: the
    last is below the best. anchor: a rung and the value it had before; an error if the rung is absent or differs by more than the tolerance.
    """
    rows = sorted((float(r[axis]), float(r[value])) for r in rungs.select(axis, value).collect())
    if not rows or len({a for a, _ in rows}) < len(rows):
        raise ValueError("a ladder needs rungs of distinct values")
    if anchor is not None:
        found = dict(rows).get(float(anchor[0]))
        if found is None or abs(found - anchor[1]) > tolerance:
            raise ValueError(f"the anchor rung {anchor[0]} gives {found}, not {anchor[1]}")
    best = max(rows, key=lambda r: (r[1], -r[0]))
    climbing = len(rows) > 1 and rows[-2][1] > 0 and rows[-1][1] / rows[-2][1] - 1 >= climb
    return rungs.sparkSession.createDataFrame([(best[0], best[1], best[1] >= gate, climbing, rows[-1][1] < best[1])], "best double, best_value double, passes boolean, climbing boolean, turned boolean")


def gain_to_strength(folds: DataFrame) -> DataFrame:
    """Correlation of the base's strength with the arm's gain over folds."""
    return folds.agg(F.corr("base", F.col("arm") - F.col("base")).alias("correlation"))


@dataclass(frozen=True)
class Gate:
    name: str
    value: float | None
    least: float

    @property
    def state(self) -> str:
        return "PENDING" if self.value is None else "PASS" if self.value >= self.least else "FAIL"


def verdict(gates: Sequence[Gate]) -> str:
    """FAIL if any gate fails, else PENDING if any waits for its value, else PASS."""
    states = {g.state for g in gates}
    return "FAIL" if "FAIL" in states else "PENDING" if "PENDING" in states else "PASS"


def moment_check(cube: DataFrame, direct: DataFrame) -> bool:
    """Whether the sums of a cube give the score that the rows give, to 1e-12 of it."""
    s = cube.agg(F.sum("d").alias("d"), F.sum("v_0").alias("v"), F.sum("g_0_0").alias("g")).first()
    want = direct.first()["score"]
    got = (2 * s["v"] - s["g"]) / s["d"] if s["d"] else 0.0
    return abs(got - want) <= 1e-12 * max(1.0, abs(want))


def phase_heterogeneity(cube: DataFrame, block: int, samples: int, seed: int, period: int = 10) -> DataFrame:
    """Do phases differ by more than chance? cube: one row per time with v and d.

    A phase's gain is its sum of v over the sum of d of all. From the variance of the gains over phases goes what
    replicates of blocks of times show as variance of a phase's own gain: observed, sampling, excess, low and high (the
    95 % interval of the replicates' spread less sampling), detected.
    """
    names = [f"p{k}" for k in range(period)]
    phase = F.pmod("time_id", F.lit(period))
    wide = cube.select("time_id", "d", *[F.when(phase == k, F.col("v")).otherwise(0.0).alias(n) for k, n in enumerate(names)])
    drawn = block_bootstrap(wide, ["d", *names], block, samples, seed)
    gains = [F.try_divide(n, "d") for n in names]

    def spread(values):
        mean = sum(values[1:], values[0]) / len(values)
        return sum(((v - mean) ** 2 for v in values), F.lit(0.0)) / (len(values) - 1)

    seen = wide.agg(*[F.sum(c).alias(c) for c in ("d", *names)]).select(spread(gains).alias("observed"))
    each = drawn.select(spread(gains).alias("s"), *[g.alias(n) for g, n in zip(gains, names)])
    own = F.broadcast(each.agg((sum((F.var_samp(n) for n in names), F.lit(0.0)) / period).alias("sampling"), F.percentile("s", F.array(F.lit(0.025), F.lit(0.975))).alias("q")))
    out = seen.crossJoin(own).select("observed", "sampling", (F.col("observed") - F.col("sampling")).alias("excess"), (F.col("q")[0] - F.col("sampling")).alias("low"), (F.col("q")[1] - F.col("sampling")).alias("high"))
    return out.withColumn("detected", (F.col("excess") > 0) & (F.col("low") > 0))


def acceptance(results: DataFrame, least_positive: int) -> DataFrame:
    """Verdict on stored results (label, payload: JSON with folds of base and arm): label, folds, mean_gain, positive, accepted."""
    folds = F.from_json("payload", "folds array<struct<base:double,arm:double>>")["folds"]
    d = F.col("x.arm") - F.col("x.base")
    out = results.select("label", F.explode_outer(folds).alias("x")).groupBy("label").agg(F.count("x").alias("folds"), F.avg(d).alias("mean_gain"), F.count_if(d > 0).alias("positive"))
    return out.withColumn("accepted", F.coalesce((F.col("mean_gain") > 0) & (F.col("positive") >= least_positive), F.lit(False)))
