"""Collocations against counts in plain dictionaries."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattica.llm import phrases


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_counts(texts, longest=3):
    f, n = Counter(), Counter()
    for text, lang in texts:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    return f, n


def plain(texts, longest=3, least=10, share=50, top=2000):
    f, n = plain_counts(texts, longest)
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    most = Counter()
    for (lang, w), a in candidates.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                inner = lang, w[i : i + size]
                most[inner] = max(most[inner], a)
    out = defaultdict(list)
    for (lang, w), a in candidates.items():
        if 100 * most[lang, w] >= share * a and most[lang, w]:
            continue
        cuts = [(10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return Counter((lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ["Alpha", "beta", "GAMMA", "delta", "é", "İ", "x\x1cy", "a-b", "z\x00", "🙂", "un", "the"]
    line = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "; "]) for _ in range(n))
    out = [(line(rng.randint(0, 60)), rng.choice(["en", "en", "en", "de", None, "und", ""])) for _ in range(150)]
    out += [(None, "en"), ("", None), (" \t\n.,", "en"), ("the the the the " * 400, "en"), ("new york city " * 30 + ". new york. " * 5, "de"), (out[0][0], out[0][1]), ("no separators at all here " * 300, "fr"), ("w" * 3000 + " tail end", "en")]
    return out


@pytest.fixture(scope="module")
def table(spark, texts):
    return spark.createDataFrame([(t, lang, 1, 2.0, "p") for t, lang in texts], "text string, lang string, f int, n double, phrase string").repartition(3)


def got(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("how", [{}, {"block": 64}, {"block": 7}, {"least": 3, "share": 90}, {"longest": 4, "least": 4, "share": 30}, {"longest": 2}, {"least": 2, "top": 5, "block": 300}, {"least": 150}])
def test_rows_equal_plain_counts(table, texts, how):
    want = {k: v for k, v in how.items() if k != "block"}
    assert got(phrases.collocations(table, **how)) == plain(texts, **want)


def test_a_full_sketch_loses_nothing(table, texts, monkeypatch):
    """With all counters reached, every phrase survives and the rows stay."""
    monkeypatch.setattr(phrases, "sketch", lambda texts, bits, *a: np.full((phrases.ROWS, (1 << bits) // 8), 255, np.uint8))
    assert got(phrases.collocations(table)) == plain(texts)


def test_counters_are_never_below_counts_and_drop_most_rare_phrases(spark, texts):
    rng = random.Random(1)
    rare = [(" ".join(f"{rng.randrange(10**6)}" for _ in range(200)), "en") for _ in range(100)]
    df = spark.createDataFrame(texts + rare, "text string, lang string").withColumn("lang", F.coalesce("lang", F.lit("und"))).withColumn("text", F.coalesce("text", F.lit(""))).repartition(4)
    bits = 16
    enough = phrases.sketch(df, bits, block=500)
    f, _ = plain_counts(texts + rare)
    kept = 0
    for (lang, w), count in f.items():
        data = np.frombuffer(" ".join(w).encode(), np.uint8)
        own = phrases.Words.of(data, np.array([len(data)]), [lang], np.array([0]))
        h = own.hashes(len(w))[len(w) - 1]
        at = [int(phrases._counters(h, row, bits)[0]) for row in range(phrases.ROWS)]
        reached = all(enough[row][c >> 3] >> (7 - (c & 7)) & 1 for row, c in enumerate(at))
        assert reached or count < 10
        kept += reached and count < 10
    assert kept < 0.01 * len(f) and len(f) > 50_000


@pytest.mark.parametrize("longest", [1, 2, 3, 5])
def test_long_texts_in_pieces(longest):
    """Every run of words is in exactly one piece, beyond the words that are known."""
    rng = random.Random(longest)
    for _ in range(300):
        text = "".join(rng.choice(["a", "bb", "c" * rng.randint(1, 40)]) + rng.choice([" ", "  ", "\t", " ", ".", "\n"]) for _ in range(rng.randint(0, 60)))
        most = rng.randint(2, 60)
        found = Counter()
        batch = pa.RecordBatch.from_arrays([pa.array([text]), pa.array(["en"])], ["text", "lang"])
        for block in phrases._blocks(iter([batch]), longest, most):
            words = phrases.Words.of(*block)
            for size in range(1, longest + 1):
                for i in words.places(size):
                    found[tuple(words.distinct[int(k)].as_py() for k in words.ids[i : i + size])] += 1
        assert found == Counter({w: c for (_, w), c in plain_counts([(text, "en")], longest)[0].items()})


def test_scores_beyond_64_bits(spark):
    big = 3_000_000_000_000_001
    rows = [("en", 0, "", 10**16), ("en", 1, "a", big), ("en", 1, "b", big + 7), ("en", 2, "a b", big - 5)]
    out = phrases.scored(spark.createDataFrame(rows, "lang string, size int, phrase string, f long")).first()
    assert out.score == 10**6 * (big - 5) ** 2 // (big * (big + 7)) and (out.l, out.r, out.k) == (big, big + 7, 1)


def test_empty_tables(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("", "en"), ("a b", "en")], "text string, lang string")).count() == 0
