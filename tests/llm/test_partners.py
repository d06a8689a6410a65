"""Texts with a near partner are told without components, and more links go on from known components: few jobs, so little in the driver."""

import random

from pyspark.sql import functions as F

from lattica.llm import graph, simhash


def test_partners_are_the_ends_of_all_near_pairs(spark):
    """Buckets of up to 60 nodes, most of them far from the one that stands for their bucket."""
    rng = random.Random(4)
    held = sorted({(key, rng.randrange(400)) for key in range(30) for _ in range(rng.choice([1, 2, 60]))})
    head = {n: rng.randrange(3000) for _, n in held}
    indexed = spark.createDataFrame([(k, n, head[n]) for k, n in held], "key long, node long, head long").repartition(3)
    apart = lambda a, b: F.abs(a - b)
    verify = lambda pairs, first: pairs.filter("(node + other) % 3 > 0")
    # each node looks its own keys up, and those next to them
    found = indexed.select(F.explode(F.array(F.col("key") - 1, "key", F.col("key") + 1)).alias("key"), "node", "head").distinct()
    met = {(a, b) for k, a in held for m, b in held if abs(k - m) <= 1 and a != b and abs(head[a] - head[b]) <= 20 and (a + b) % 3}
    got = [r.node for r in simhash.with_partner(indexed, found, apart, 20, verify).collect()]
    assert sorted(got) == sorted({a for a, _ in met}) and 0 < len(got) < len(head)


def test_more_links_join_known_components(spark):
    rng = random.Random(6)
    for first, more in ((150, 60), (150, 0), (0, 60), (3000, 40)):
        edges = [[(rng.randrange(300 if n < 1000 else 5000), rng.randrange(300 if n < 1000 else 5000)) for _ in range(n)] for n in (first, more)]
        tables = [spark.createDataFrame(e, "a long, b long") for e in edges]
        want = {r.node: r.component for r in graph.components(tables[0].unionByName(tables[1])).collect()}
        rows = graph.joined(graph.components(tables[0]), tables[1]).collect()
        # a loop may be the only link of a node
        got = {r.node: r.component for r in rows}
        assert len(rows) == len(got) and got == want


def executions(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return spark._jsparkSession.sharedState().statusStore().executionsList().last().executionId()


def test_near_texts_starts_few_queries(spark):
    """Chains of near copies; before, 5 computations of components with 4 queries a round started some 60."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = []
    for _ in range(6):
        texts.append([word() for _ in range(60)])
        for k in range(12):
            texts.append([*texts[-1][: 4 * k], word(), *texts[-1][4 * k + 1 :]])
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    docs.count()
    before = executions(spark)
    found = {r.doc_id: r.component for r in simhash.near_texts(docs).collect()}
    assert len(set(found.values())) == 6
    assert executions(spark) - before <= 40
