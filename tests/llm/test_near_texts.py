"""Near-duplicates by fingerprints and whole shingle sets, against all pairs compared one by one."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lattica.llm import simhash


def shingles(text, words=5):
    found = (text or "").lower().split()
    return {" ".join(found[k : k + words]) for k in range(max(1, len(found) - words + 1))} if found else set()


def texts_with_copies():
    """Groups of near copies around and far beyond 0.8, a line that most texts hold, and chains."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    line, out = [word() for _ in range(12)], []
    for _ in range(40):
        base = [word() for _ in range(rng.randint(30, 250))] + line
        out.append(base)
        for _ in range(rng.randint(0, 6)):
            copy = list(rng.choice(out[-3:]))
            for _ in range(rng.randint(1, max(1, len(copy) // 45))):
                copy[rng.randrange(len(copy))] = word()
            out.append(copy)
    return [" ".join(t) for t in out]


def brute_components(texts):
    sets, part = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if part[i] != part[j] and (sets[i] == sets[j] or 9 * common >= 4 * (len(sets[i]) + len(sets[j]))):
                old, new = max(part[i], part[j]), min(part[i], part[j])
                part = [new if p == old else p for p in part]
    return part


def components_found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.component for r in simhash.near_texts(docs).collect()}
    least = {}
    for i in sorted(found):
        least.setdefault(found[i], i)
    return [least[found[i]] for i in range(len(texts))]


def test_all_pairs_at_08_are_linked_and_no_others(spark, monkeypatch):
    """With as many segments as it takes, the components are those of all pairs."""
    monkeypatch.setattr(simhash, "RECALL", 0.999999)
    texts = texts_with_copies()
    want = brute_components(texts)
    assert len(set(want)) < len(texts) and components_found(spark, texts) == want


def test_recall_of_the_registered_setting(spark):
    texts = texts_with_copies()
    want, found = brute_components(texts), components_found(spark, texts)
    # a component never reaches beyond the true one
    assert all(len({want[k] for k in range(len(texts)) if found[k] == c}) == 1 for c in set(found))
    assert len(texts) - len(set(found)) >= 0.9 * (len(texts) - len(set(want)))


def test_many_near_copies_of_one_text(spark):
    """A large group of near copies, no two equal, is one component; far fewer pairs are verified than the group has."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(150)]
    texts = [" ".join(base[:k] + [word()] + base[k + 1 :]) for k in (rng.randrange(150) for _ in range(1500))] + [" ".join(word() for _ in range(150)) for _ in range(50)]
    found = components_found(spark, texts)
    assert set(found[:1500]) == {0} and found[1500:] == list(range(1500, 1550))


def test_stage_keeps_one_of_each_group(spark, monkeypatch):
    monkeypatch.setattr(simhash, "RECALL", 0.999999)
    texts = texts_with_copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    kept = [r.doc_id for r in corpus_pipeline.distinct_documents(spark, docs, "").select("doc_id").collect()]
    assert sorted(kept) == sorted(set(brute_components(texts)))


def test_rows_of_one_id_stand_for_their_own_groups(spark):
    """A copy under a shared id goes, the other text of that id stays; rows without ids go if a row with one has a near copy."""
    rng = random.Random(3)
    a, b, c = (" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(100)) for _ in range(3))
    rows = [(1, a), (2, a + " end"), (2, b), (2, b), (3, b + " end"), (None, b), (None, c), (None, c + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.distinct_documents(spark, docs, "").collect()]
    named = [r for r in kept if r[0] is not None]
    assert sorted(named) == [(1, a), (2, b)]
    assert len(kept) == 3 and kept[[r[0] for r in kept].index(None)][1] in (c, c + " end")
