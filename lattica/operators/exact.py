"""Sums of doubles that come out bit for bit the same in any order and any partitioning, and models fitted from them."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import positive_weight, zero_if_missing
from .linear import Gram, Linear, ridge

#: A value in limbs: multiples of 2^60, of 1, and of 2^-30, 2^-60, 2^-90. What is smaller is cut off, row by row.
EXPONENTS = (60, 0, -30, -60, -90)


def limbs(x: Column) -> list[Column]:
    """x as whole multiples of 2^e, for each exponent, all of x's sign. No step rounds, so their sum is x, cut towards 0 after the last."""
    out, rest = [], x
    for e in EXPONENTS:
        digit = (rest * 2.0**-e).cast("long")
        out.append(digit.cast("decimal(20,0)"))
        rest = rest - digit.cast("double") * 2.0**e
    return out


def exact_sums(df: DataFrame, sums: dict[str, Column], by: str | None = None) -> dict:
    """Sums by name, or by group and then name, as the doubles nearest to the exact sums of the values (cut towards 0 after 2^-90).

    Whole numbers are added as decimals, which no order changes; tasks add up their own rows first. Values that are missing, or not finite, add 0.
    Values of 2^122 and more are beyond it: an error.
    """
    parts = [F.sum(p).alias(f"_{i}_{j}") for i, x in enumerate(sums.values()) for j, p in enumerate(limbs(zero_if_missing(x)))]
    rows = (df.groupBy(by) if by else df).agg(*parts).collect()

    def value(row, i: int) -> float:
        total = Fraction(0)
        for j, e in enumerate(EXPONENTS):
            total += Fraction(int(row[f"_{i}_{j}"] or 0)) * Fraction(2) ** e
        return float(total)

    found = {row[by] if by else None: {name: value(row, i) for i, name in enumerate(sums)} for row in rows}
    return found if by else found[None]


def exact_gram(df: DataFrame, x: Sequence[str], y: Sequence[str], weight: str | None = None) -> Gram:
    """linear.gram(), bit for bit the same under any partitioning. One aggregate per pair of columns: for tens of columns, not hundreds."""
    names = [None, *x, *y]
    w = positive_weight(F.col(weight)) if weight else F.lit(1.0)
    one = [F.lit(1.0) if c is None else zero_if_missing(F.col(c).cast("double")) for c in names]
    pairs = {(i, j): (w * one[i]) * one[j] for i in range(len(names)) for j in range(i, len(names))}
    found = exact_sums(df, {f"{i},{j}": v for (i, j), v in pairs.items()})
    products = np.zeros((len(names), len(names)))
    for i, j in pairs:
        products[i, j] = products[j, i] = found[f"{i},{j}"]
    return Gram(products, list(x), list(y))


def rerun(df: DataFrame, x: Sequence[str], target: str, weight: str | None, alpha: float, partitions: Sequence[int]) -> list[tuple[int, Linear]]:
    """The same ridge fitted from rows dealt out in other ways, by the number of partitions."""
    return [(n, ridge(exact_gram(df.repartition(n), x, [target], weight), alpha)) for n in partitions]


def largest_difference(a: Linear, b: Linear) -> float:
    return float(max(np.abs(a.intercept - b.intercept).max(initial=0.0), np.abs(a.weights - b.weights).max(initial=0.0)))
