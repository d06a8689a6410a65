"""Verdicts of rows that share an id or have none."""

import numpy as np

from lattica.llm import quality


def test_each_row_follows_its_own_verdict(spark):
    rng = np.random.default_rng(8)
    good = [" ".join("".join(rng.choice(list("aeiourstln"), 5)) for _ in range(80)) for _ in range(60)]
    bad = [" ".join(f"{w.upper()}!!" for w in g.split()[:5] * 16) for g in good]
    rows = [(k, g if k % 3 else b) for k, (g, b) in enumerate(zip(good, bad))]
    odd = [(None, good[0]), (None, bad[1]), (None, bad[2]), (700, good[3]), (700, bad[4])]
    docs = spark.createDataFrame([(*r, f"host{k % 4}", "en") for k, r in enumerate(rows + odd)], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(60)], "doc_id long, quality int")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    found = [(r.doc_id, r.text) for r in kept.collect()]
    assert [r for r in found if r[0] is None] == [(None, good[0])] and [r for r in found if r[0] == 700] == [(700, good[3])]
