"""Quantiles by radix selection and running sums by ranges, against NumPy on whole columns."""

import math
import random

import numpy as np
import pytest

from lattica.operators import ranks

AT = [0.0, 0.001, 0.25, 0.5, 0.75, 0.999, 1.0]


def test_quantiles_of_many_columns_and_groups(spark):
    rng = np.random.default_rng(1)
    columns = {
        "normal": rng.normal(size=500) * 10.0 ** rng.integers(-300, 300, 500),
        "few": rng.integers(-2, 3, 500).astype(float),
        "tiny": rng.choice([0.0, -0.0, 5e-324, -5e-324, 2.2e-308], 500),
        "odd": np.where(rng.random(500) < 0.5, math.nan, rng.choice([math.inf, -math.inf, 1.5, -7.25, 1e308], 500)),
        "one": np.full(500, -3.75),
        "none": np.full(500, math.nan),
    }
    group = rng.integers(-1, 3, 500)
    rows = [(int(g), *[None if k % 17 == 3 and c == "few" else float(v[k]) for c, v in columns.items()]) for k, g in enumerate(group)]
    df = spark.createDataFrame(rows, "g int, " + ", ".join(f"{c} double" for c in columns)).repartition(5)

    def want(c, rows_of):
        own = [r[1 + list(columns).index(c)] for r in rows_of]
        own = [v for v in own if v is not None and math.isfinite(v)]
        return [float(np.quantile(own, p)) for p in AT] if own else None

    for by, groups in ((None, [None]), ("g", [-1, 0, 1, 2])):
        got = ranks.quantiles(df, list(columns), AT, by)
        for g in groups:
            for c in columns:
                w = want(c, rows if g is None else [r for r in rows if r[0] == g])
                assert got.get((g, c)) == (None if w is None else pytest.approx(w, rel=1e-12, abs=0)), (g, c)


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([], "x double")
    assert ranks.quantiles(empty, ["x"], [0.5]) == {} and ranks.quantiles(empty, [], [0.5]) == {}
    assert ranks.quantiles(spark.createDataFrame([(2,)], "x int"), ["x"], [0.3]) == {(None, "x"): [2.0]}


def test_numbers_and_running_sums_over_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.randint(-50, 50), k, None if k % 7 == 0 else rng.randint(-9, 9), float(rng.randint(0, 5))) for k in range(700)]
    df = spark.createDataFrame(rows, "t int, id long, a long, b double").repartition(7)
    got = {r.id: r for r in ranks.prefix_sums(df, ["t", "id"], {"sa": "a", "sb": "b"}).collect()}
    a = b = 0
    for place, row in enumerate(sorted(rows, key=lambda r: (r[0], r[1]))):
        a, b = a + (row[2] or 0), b + row[3]
        assert (got[row[1]].place, got[row[1]].sa, got[row[1]].sb) == (place, a, b)
    plan = ranks.numbered(df, ["t", "id"])._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan
    assert sorted(r.place for r in ranks.numbered(df.select("t"), ["t"]).collect()) == list(range(700))
    assert ranks.numbered(df.limit(0), ["t"]).count() == 0
