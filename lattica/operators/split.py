"""Deterministic sampling, folds and blocks of time."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranks


def sample_periodic(df: DataFrame, modulo: int) -> DataFrame:
    """Times divisible by modulo."""
    _positive(modulo)
    return df.filter(F.pmod("time_id", F.lit(modulo)) == 0)


def sample_phase_balanced(df: DataFrame, modulo: int, period: int = 10) -> DataFrame:
    """Whole cross sections such that every phase is kept equally often: (cycle + phase) divisible by modulo."""
    _positive(modulo)
    _positive(period)
    return df.filter(F.pmod(F.floor(F.col("time_id") / period) + F.pmod("time_id", F.lit(period)), F.lit(modulo)) == 0)


def sample_residues(df: DataFrame, modulo: int, residues: Sequence[int], column: str = "time_id") -> DataFrame:
    _positive(modulo)
    return df.filter(F.pmod(column, F.lit(modulo)).isin(list(residues)))


def sample_times(df: DataFrame, n: int, seed: int, most_rows: int | None = None) -> DataFrame:
    """All rows of n distinct times, those with the least seeded hash; of these rows at most `most_rows`, again by least hash (of seed, time and asset)."""
    chosen = df.select("time_id").distinct().orderBy(F.xxhash64("time_id", F.lit(seed)), "time_id").limit(n)
    rows = df.join(chosen, "time_id", "left_semi")
    if most_rows is None:
        return rows
    placed = ranks.numbered(rows.withColumn("_h", F.xxhash64("time_id", "asset_id", F.lit(seed))), ["_h", "time_id", "asset_id"], "_place")
    return placed.filter(F.col("_place") < most_rows).drop("_h", "_place")


def keep_times(df: DataFrame, times: DataFrame) -> DataFrame:
    """Rows whose time is among those of another table, each once however often it is there. Null times match nothing."""
    return df.join(times.select("time_id"), "time_id", "left_semi")


def distinct_times(df: DataFrame) -> DataFrame:
    """Each time once, with its place from 0 in their order and its number of rows; a null time is left out."""
    return ranks.numbered(df.filter("time_id is not null").groupBy("time_id").agg(F.count("*").alias("rows")), ["time_id"])


def evenly_spaced(df: DataFrame, k: int) -> DataFrame:
    """k rows at even distances in order of (time_id, asset_id), the first and the last among them; all rows if there are no more than k."""
    n = df.count()
    k = min(k, n)
    places = sorted({round(i * (n - 1) / max(k - 1, 1)) for i in range(k)})
    return ranks.numbered(df, ["time_id", "asset_id"], "_row").filter(F.col("_row").isin(places)).drop("_row")


def _positive(n: int) -> None:
    if n <= 0:
        raise ValueError("a modulus must be positive")


@dataclass(frozen=True)
class Fold:
    fold: int
    train_low: int
    train_high: int
    valid_low: int
    valid_high: int


def partition_folds(partitions: Sequence[int], window: int) -> list[tuple[list[int], int]]:
    """For each partition to validate on, the `window` partitions before it."""
    if window <= 0 or any(p < window for p in partitions):
        raise ValueError("a partition has too few partitions before it")
    return [(list(range(p - window, p)), p) for p in sorted(partitions)]


def rolling_folds(times: Sequence[int], n_folds: int, train: int, embargo: int = 0, offset: int = 0, reserved: int = 0) -> list[Fold]:
    """Folds over sorted distinct times: a window to train on, a gap of `embargo` times, a chunk to validate on.

    The chunk is what is left after the first window, the gap and the reserved times, over the number of folds. The
    last fold takes the remainder if nothing is reserved. Times, not rows, are counted; `times` is one value per time.
    """
    if n_folds <= 0 or train <= 0 or embargo < 0 or reserved < 0 or not 0 <= offset <= reserved:
        raise ValueError("folds need a positive number and window, and an offset within what is reserved")
    chunk = (len(times) - train - embargo - reserved) // n_folds
    if chunk <= 0:
        raise ValueError("too few times for the folds")
    folds = []
    for k in range(n_folds):
        first = offset + train + embargo + k * chunk
        last = first + chunk - 1
        if k == n_folds - 1 and not reserved:
            last = len(times) - 1
        folds.append(Fold(k, times[first - embargo - train], times[first - embargo - 1], times[first], times[last]))
    return folds


def check_folds(folds: Sequence[Fold]) -> None:
    """Raise if two folds have one number, or validate one time."""
    spans = sorted((f.valid_low, f.valid_high) for f in folds)
    if len({f.fold for f in folds}) < len(folds) or any(a[1] >= b[0] for a, b in zip(spans, spans[1:])):
        raise ValueError("two folds have one number, or validate one time")


def rolling_folds_of(df: DataFrame, n_folds: int, train: int, embargo: int = 0, offset: int = 0, reserved: int = 0) -> list[Fold]:
    """rolling_folds() over the distinct times of a table. Times are numbered by ranges; the driver gets the four ends of each fold only."""
    times = ranks.numbered(df.select("time_id").filter("time_id is not null").distinct(), ["time_id"])
    places = rolling_folds(range(times.count()), n_folds, train, embargo, offset, reserved)
    ends = sorted({p for f in places for p in (f.train_low, f.train_high, f.valid_low, f.valid_high)})
    at = {r["place"]: r["time_id"] for r in times.filter(F.col("place").isin(ends)).collect()}
    return [Fold(f.fold, at[f.train_low], at[f.train_high], at[f.valid_low], at[f.valid_high]) for f in places]


def cut_training(fold: Fold, front: int | None = None, most: int | None = None) -> Fold:
    """A fold whose training begins no earlier than `front`, or spans at most `most` steps of time before its end."""
    low = max(x for x in (fold.train_low, front, None if most is None else fold.train_high - most + 1) if x is not None)
    if low > fold.train_high:
        raise ValueError("no training time is left")
    return Fold(fold.fold, low, fold.train_high, fold.valid_low, fold.valid_high)


def purged_blocks(df: DataFrame, n_splits: int, holdout: float = 0.15) -> DataFrame:
    """Distinct times with their block: the last share (rounded up) is -1, the rest falls in n_splits blocks, the first ones larger by one."""
    times = ranks.numbered(df.select("time_id").distinct(), ["time_id"], "_k")
    n = times.count()
    held = -(-int(round(n * holdout * 1_000_000)) // 1_000_000)
    size, larger = divmod(n - held, n_splits)
    k = F.col("_k")
    block = F.when(k >= n - held, -1).when(k < larger * (size + 1), F.floor(k / (size + 1)))
    return times.select("time_id", (block.otherwise(larger + F.floor((k - larger * (size + 1)) / size)) if size else block).cast("int").alias("block"))


def purge(blocks: DataFrame, block: int, steps: int) -> DataFrame:
    """Roles for one block: valid, train, or purged where a time stands within `steps` places of the block; holdout stays."""
    placed = ranks.numbered(blocks.select("time_id", "block"), ["time_id"], "_p")
    edge = placed.filter(F.col("block") == block).agg(F.min("_p").alias("low"), F.max("_p").alias("high"))
    role = F.when(F.col("block") == -1, "holdout").when(F.col("block") == block, "valid").when((F.col("_p") >= F.col("low") - steps) & (F.col("_p") <= F.col("high") + steps), "purged").otherwise("train")
    return placed.crossJoin(F.broadcast(edge)).select("time_id", "block", role.alias("role"))


@dataclass(frozen=True)
class Seal:
    start: int
    cutoff: int
    blocks: list[tuple[int, int]]


def sealed_period(low: int, high: int, sealed: int, n_blocks: int, embargo: int) -> Seal:
    """The last `sealed` times of a span, in blocks of one size, and the last time before the embargo that decisions may use."""
    if sealed <= 0 or n_blocks <= 0 or sealed % n_blocks or sealed + embargo >= high - low + 1:
        raise ValueError("the sealed times must divide into the blocks and leave time before them")
    start, size = high - sealed + 1, sealed // n_blocks
    return Seal(start, start - embargo - 1, [(start + k * size, start + (k + 1) * size - 1) for k in range(n_blocks)])


def fold_table(df: DataFrame, folds: Sequence[Fold]) -> DataFrame:
    return df.sparkSession.createDataFrame([(f.fold, f.train_low, f.train_high, f.valid_low, f.valid_high) for f in folds], "fold int, train_low long, train_high long, valid_low long, valid_high long")


def assign_folds(df: DataFrame, folds: Sequence[Fold]) -> DataFrame:
    """Rows of each fold's training and validation, with fold and role. The few ranges are broadcast."""
    ranges = F.broadcast(fold_table(df, folds))
    valid = F.col("time_id").between(F.col("valid_low"), F.col("valid_high"))
    train = F.col("time_id").between(F.col("train_low"), F.col("train_high"))
    return df.join(ranges, valid | train).withColumn("role", F.when(valid, "valid").otherwise("train")).drop("train_low", "train_high", "valid_low", "valid_high")


def equal_blocks(low: int, high: int, n: int) -> Column:
    """Number of the equal block of [low, high] that time_id falls in; the last takes the remainder."""
    size = (high - low + 1) // n
    return F.least(F.floor((F.col("time_id") - low) / size), F.lit(n - 1)).cast("int")


def quantile_segments(df: DataFrame, n: int, column: str = "time_id", out: str = "segment") -> DataFrame:
    """Segments between the quantiles k / n of a column (linear between values); equal edges are one."""
    edges = ranks.quantiles(df, [column], [k / n for k in range(1, n)]).get((None, column), [])
    return df.withColumn(out, bucket(F.col(column), edges))


def bucket(x: Column, edges: Sequence[float]) -> Column:
    """How many distinct edges are at or below x."""
    return sum((F.when(x >= e, 1).otherwise(0) for e in sorted(set(edges))), F.lit(0)).cast("int")
