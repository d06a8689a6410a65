"""Links and components of near vectors against all pairs compared one by one."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from lattica.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, node int, copies string, component_id long"


def brute(rows, threshold=0.95):
    """n_links and smallest reachable id of each row, as the docstring defines them."""
    good = [v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if g else None for (_, v), g in zip(rows, good)]
    part, links = list(range(len(rows))), [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if good[i] and good[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                old, new = part[i], part[j]
                if old != new:
                    part = [new if p == old else p for p in part]
    out = Counter()
    for i, (k, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if part[j] == part[i] and rows[j][0] is not None]
        least = k if not good[i] else min(ids, default=None)
        out[k, links[i], least, k is not None and k == least] += 1
    return out


def found(spark, rows, **how):
    df = spark.createDataFrame([(k, v, 1, "x", 2) for k, v in rows], SCHEMA).repartition(3)
    return Counter(tuple(r) for r in neighbours.near_vectors(df, **how).collect())


def family(rng, dim, sizes, spread):
    out = []
    for n in sizes:
        centre = rng.normal(size=dim)
        out += [(centre + spread * rng.normal(size=dim) * np.linalg.norm(centre) / dim**0.5).tolist() for _ in range(n)]
    return out


def numbered(vectors, seed=0):
    ids = list(range(100, 100 + len(vectors)))
    random.Random(seed).shuffle(ids)
    return list(zip(ids, vectors))


def test_families_small_and_large(spark):
    """Single vectors, pairs, families that fill lists, and one that is compared in blocks, at the threshold and within it."""
    rng = np.random.default_rng(3)
    rows = numbered(family(rng, 16, [1] * 150 + [2] * 30 + [20, 40], 0.15) + family(rng, 16, [130], 0.05) + family(rng, 16, [60], 0.23))
    assert found(spark, rows) == brute(rows)


def test_blocks_count_as_lists_do(spark, monkeypatch):
    """Small lists and blocks: nearly every family is dense, its border isn't, and copies count as rows."""
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng = np.random.default_rng(4)
    vectors = family(rng, 12, [1] * 60 + [30, 50], 0.2) + family(rng, 12, [45], 0.25)
    rows = numbered(vectors + vectors[60:75] * 3 + vectors[:2] * 40)
    assert found(spark, rows, lists=4, most=8) == brute(rows)


def test_odd_rows(spark):
    a, b = [1.0, 0.0, 0.0], [1.0, 0.1, 0.0]
    rows = [(1, a), (2, b), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 0.0]), (7, [float("nan"), 1.0, 1.0]), (8, [float("inf"), 0.0, 0.0]), (9, [1.0, 0.0]), (10, [2.0, 0.0]), (11, [-1.0, 0.0, 0.0])]
    rows += [(None, a), (1, a), (1, [0.0, 0.0, 1.0]), (12, [0.0, 0.0, 2.0]), (None, [0.0, 1.0, 0.0]), (13, [3e38, 3e37, 0.0]), (14, [1e-40, 0.0, 0.0]), (None, None), (15, [-0.0, -2.0, 0.0])]
    assert found(spark, rows) == brute(rows)


def test_empty_and_single(spark):
    assert found(spark, []) == Counter()
    assert found(spark, [(1, None), (2, [0.0])]) == brute([(1, None), (2, [0.0])])
    assert found(spark, [(5, [1.0, 2.0])]) == brute([(5, [1.0, 2.0])])
    rows = [(k, [1.0, 2.0]) for k in range(300)]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("spread", [0.1, 0.2])
def test_turns_find_what_the_first_graph_lacks(spark, monkeypatch, spread):
    """With two orders of short runs, neighbours of neighbours and the audit still bring the links."""
    monkeypatch.setattr(neighbours, "ORDERS", 2)
    monkeypatch.setattr(neighbours, "RUN", 16)
    rng = np.random.default_rng(5)
    rows = numbered(family(rng, 8, [1] * 100 + [3] * 60, spread))
    df = spark.createDataFrame([(k, v, 1, "x", 2) for k, v in rows], SCHEMA)
    nodes = df.selectExpr("vec_id as node", "embedding", "vec_id as least", "1l as copies")
    first = neighbours._first_graph(nodes, 1).filter("sim >= 0.95").select("src", "dst").distinct().count()
    after = neighbours.descend(nodes, seed=1).filter("sim >= 0.95").count()
    want, got = brute(rows), found(spark, rows)
    true = sum(k[1] * n for k, n in want.items())
    assert first < 0.9 * true and after > first
    assert sum((want & got).values()) >= 0.97 * len(rows) and sum(k[1] * n for k, n in got.items()) <= true


def test_the_audit_counts_all_links(spark):
    rng = np.random.default_rng(6)
    rows = numbered(family(rng, 8, [1] * 20 + [7, 9], 0.1))
    df = spark.createDataFrame([(k, v, 1, "x", 2) for k, v in rows], SCHEMA)
    nodes = df.selectExpr("vec_id as node", "embedding", "1l as copies").repartition(3)
    truth = {r.node: r.true_links for r in neighbours._audit(nodes, 0.95, 1_000).collect()}
    assert truth == {k[0]: k[1] for k in brute(rows)}
    none = spark.createDataFrame([], "node long, links long, component long")
    assert neighbours._recall(neighbours._audit(nodes, 0.95, 1_000), none) == 0
    assert neighbours._recall(neighbours._audit(nodes.limit(1), 0.95, 1_000), none) == 1
