"""Parities of shingle sets tell pairs that can't agree by 0.8 before their sets are compared."""

import random

from pyspark.sql import functions as F

from lattica.llm import simhash


def test_parities_rule_out_no_pair_that_agrees_and_most_others(spark):
    """A cloud of copies of one text with 0 to 12 changed words, many of which agree by less than 0.8."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base, texts = [word() for _ in range(150)], ["", "one"]
    for k in range(60):
        copy = list(base)
        for _ in range(k % 13):
            copy[rng.randrange(150)] = word()
        texts.append(" ".join(copy))
    head = F.struct(F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"), F.size("shingles").cast("long").alias("n"), "parity")
    sets = simhash._shingle_sets(spark.createDataFrame(list(enumerate(texts)), "node long, text string"), 5).withColumn("head", head)
    a, b = (sets.select(F.col("node").alias(x), F.col("head").alias(f"{x}_head"), F.col("shingles").alias(f"{x}_s")) for x in "ab")
    common = F.size(F.array_intersect("a_s", "b_s"))
    pairs = a.join(b, F.col("a") < F.col("b")).select("a", "b", (common * 9 >= 4 * (F.size("a_s") + F.size("b_s"))).alias("agree"), simhash._excess(F.col("a_head"), F.col("b_head")).alias("excess")).collect()
    assert all(r.excess <= 0 for r in pairs if r.agree) and any(r.agree for r in pairs)
    others = [r for r in pairs if not r.agree]
    assert sum(r.excess > 0 for r in others) > 0.8 * len(others)
