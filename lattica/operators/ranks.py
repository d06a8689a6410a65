"""Exact quantiles and numbers of rows at any size: no task sees all values of a column or all rows of a table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import finite
from ..sources.tables import scratch

#: Bits of a value that one pass counts.
STEP = 16


def _ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned numbers of the same order; -0 is 0."""
    v = (x + 0.0).view(np.int64)
    return np.where(v < 0, ~v, v ^ np.int64(-(2**63))).view(np.uint64)


def _value(key: int) -> float:
    v = np.uint64(key)
    v = ~v if v < np.uint64(1 << 63) else v ^ np.uint64(1 << 63)
    return float(np.array([v], np.uint64).view(np.float64)[0])


def quantiles(df: DataFrame, columns: Sequence[str], at: Sequence[float], by: str | None = None) -> dict[tuple, list[float | None]]:
    """Quantiles of the finite values of many columns, linear between values, by (group, column); by: a column of few whole numbers.

    Radix selection: a pass counts values by their next 16 bits, only where their earlier bits are those of a wanted rank,
    and four passes name the value at each rank. Each pass reads the table once for all columns, quantiles and groups;
    counts meet by bucket in partial sums, and the driver gets two rows per quantile. A group without finite values has no entry. Without `by` the group is None.
    """
    names = list(columns)
    if not names or not at:
        return {}
    own = df.select(*[finite(F.col(c).cast("double")).alias(f"_x{k}") for k, c in enumerate(names)], (F.col(by).cast("long") if by else F.lit(0).cast("long")).alias("_g"))
    wanted: dict[tuple[int, int], list[int]] | None = None
    ranks: list[tuple] = []
    places: dict[tuple, int] = {}
    for level in range(64 // STEP):
        counts = _counted(own, len(names), level, wanted)
        spread = Window.partitionBy("g", "c", "prefix").orderBy("bucket")
        held = counts.withColumn("before", F.sum("n").over(spread.rowsBetween(Window.unboundedPreceding, -1)))
        held = held.withColumn("before", F.coalesce("before", F.lit(0)))
        if level == 0:
            total = F.sum("n").over(Window.partitionBy("g", "c"))
            place = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(p)).alias("p")) for k, p in enumerate(at)]))
            held = held.withColumn("total", total).select("*", place.alias("q")).withColumn("pos", F.col("q.p") * (F.col("total") - 1))
            held = held.select("*", F.explode(F.array(F.struct(F.lit(0).alias("up"), F.floor("pos").alias("rank")), F.struct(F.lit(1).alias("up"), F.ceil("pos").alias("rank")))).alias("r"))
            held = held.select("g", "c", "prefix", "bucket", "before", "n", "pos", F.col("q.k").alias("k"), "r.up", "r.rank")
        else:
            table = df.sparkSession.createDataFrame(ranks, "g long, c int, prefix long, k int, up int, rank long, pos double")
            held = held.join(F.broadcast(table), ["g", "c", "prefix"])
        found = held.filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n")))
        ranks, wanted = [], {}
        for x in found.select("g", "c", "prefix", "bucket", "k", "up", F.col("rank") - F.col("before"), "pos").collect():
            g, c, prefix, bucket, k, up, rank, pos = x
            key = ((prefix & (1 << 64) - 1) << STEP | bucket) & (1 << 64) - 1
            signed = key - (1 << 64) if key >= 1 << 63 else key
            ranks.append((g, c, signed, k, up, rank, pos))
            wanted.setdefault((g, c), []).append(key)
            places[g, c, k, up] = key
        if not ranks:
            return {}
    out: dict[tuple, list[float | None]] = {}
    for g, c, _, k, up, _, pos in ranks:
        if not up:
            low, high = _value(places[g, c, k, 0]), _value(places[g, c, k, 1])
            share = pos - int(pos)
            out.setdefault((g if by else None, names[c]), [None] * len(at))[k] = low if low == high else (1 - share) * low + share * high
    return out


def _counted(own: DataFrame, columns: int, level: int, wanted: dict[tuple[int, int], list[int]] | None) -> DataFrame:
    """How many values have each next 16 bits: g, c, prefix (the earlier bits), bucket, n."""
    prefixes = None if wanted is None else {k: np.unique(np.array(v, np.uint64)) for k, v in wanted.items()}
    shift = np.uint64(64 - STEP * (level + 1))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = batch.column("_g").fill_null(-(2**62)).to_numpy(zero_copy_only=False)
            for c in range(columns):
                x = batch.column(c).to_numpy(zero_copy_only=False)
                ok = ~np.isnan(x)
                key = _ordered(x[ok])
                for g in np.unique(group[ok]).tolist():
                    top = key[group[ok] == g] >> shift
                    if prefixes is not None:
                        held = prefixes.get((g, c))
                        if held is None:
                            continue
                        top = top[np.isin(top >> np.uint64(STEP), held)]
                    value, n = np.unique(top, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), g)), pa.array(np.full(len(n), c, np.int32)), pa.array((value >> np.uint64(STEP)).view(np.int64)), pa.array((value & np.uint64((1 << STEP) - 1)).astype(np.int32)), pa.array(n.astype(np.int64))], ["g", "c", "prefix", "bucket", "n"])

    return own.mapInArrow(partial, "g long, c int, prefix long, bucket int, n long").groupBy("g", "c", "prefix", "bucket").agg(F.sum("n").alias("n"))


def numbered(df: DataFrame, order: Sequence[str], out: str = "place") -> DataFrame:
    """df with the place of each row (from 0) in the order of some columns (NULL first); rows that tie get places in any order.

    Ranges instead of one window: rows are dealt out by range and sorted there, counts per range are added up (one row per
    range), and a place is the range's offset plus the place in it. The sorted rows are written once under spark.checkpoint.dir, so that all
    readers see the same ranges.
    """
    return prefix_sums(df, order, {}, out)


def prefix_sums(df: DataFrame, order: Sequence[str], sums: dict[str, str], place: str = "place") -> DataFrame:
    """df with running sums of columns (by name of the result) up to and with each row, in the order of some columns, and the place of each row from 0.

    Sums are added up range by range, so doubles differ from those of one long sum in their last digits. NULL adds nothing.
    """
    spark = df.sparkSession
    path = scratch(spark, "ranges")
    df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    local = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy("_range").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_s{k}") for k, c in enumerate(sums.values())]).orderBy("_range").collect()
    before, offsets = [0, *[0] * len(sums)], []
    for t in totals:
        offsets.append((t["_range"], *before))
        before = [b + (t[i + 1] or 0) for i, b in enumerate(before)]
    kinds = [f"_o{k} {rows.agg(F.sum(c)).schema[0].dataType.simpleString()}" for k, c in enumerate(sums.values())]
    table = spark.createDataFrame([(r, n, *[type_(v) for type_, v in zip([float if k.endswith("double") else (lambda x: x) for k in kinds], s)]) for r, n, *s in offsets], ", ".join(["_range int", "_before long", *kinds]))
    placed = rows.join(F.broadcast(table), "_range")
    made = {place: F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy("_at")) - 1}
    made |= {name: F.col(f"_o{k}") + F.coalesce(F.sum(c).over(local), F.lit(0)) for k, (name, c) in enumerate(sums.items())}
    return placed.withColumns(made).select(*df.columns, *made)


def with_previous(df: DataFrame, order: str, columns: Sequence[str], prefix: str = "previous_") -> DataFrame:
    """df with columns of the row before it in the order of a column of distinct values, NULL for the first. Rows meet by their place, so no task sees them all."""
    placed = numbered(df, [order], "_place")
    before = placed.select((F.col("_place") + 1).alias("_place"), *[F.col(c).alias(f"{prefix}{c}") for c in columns])
    return placed.join(before, "_place", "left").drop("_place")
