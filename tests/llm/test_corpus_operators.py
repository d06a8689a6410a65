"""Operators against plain versions, on texts with every odd case."""

import base64
import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lattica.llm import bpe, chat, fingerprint, graph, labelled, logistic, media, mixing, quality, secrets, simhash, storage, substring, toxicity
from lattica.llm.fmindex import FMIndex, suffix_array
from lattica.llm.text import mix64, n_words
from lattica.llm.trigrams import trigram_query

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def rows(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_word_counts(docs, corpus):
    got = rows(docs.select("doc_id", n_words("text").alias("n")), "doc_id", "n")
    assert got == Counter((c[0], len(WORD.findall(c[1] or ""))) for c in corpus)


# --- media


def test_media(docs, no_docs, corpus):
    got = rows(media.describe(*media.store(docs)), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")
    want = Counter()
    for c in corpus:
        raw = (c[1] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        want[c[0], len(raw), len(payload), sha(payload), zlib.crc32(payload[-64:])] += 1
    assert got == want
    assert media.describe(*media.store(no_docs)).count() == 0


def test_media_round_trip_and_sharing(docs, corpus, monkeypatch):
    packs, shared = media.store(docs)
    assert rows(media.load(packs, shared).select("doc_id", F.sha2("media", 256).alias("m")), "doc_id", "m") == Counter((c[0], sha(media.to_media((c[1] or "").encode()))) for c in corpus)
    # each repeated digest is kept once, and copies don't add to what is stored
    kept = shared.agg(F.count("*").alias("n"), F.count_distinct("digest").alias("d")).first()
    assert kept.n == kept.d > 0
    monkeypatch.setattr(media, "MAX_BROADCAST_DIGESTS", 0)
    by_join = media.describe(*media.store(docs))
    assert rows(by_join, "doc_id", "media_sha256", "feature") == rows(media.describe(packs, shared), "doc_id", "media_sha256", "feature")


def test_chunks_follow_content():
    rng = np.random.default_rng(1)
    body = rng.integers(97, 110, 60_000).astype(np.uint8).tobytes()

    def cut(data):
        marks = media.gear_marks(np.frombuffer(data, np.uint8))
        ends = media.gear_cuts(data, 0, len(data), marks)
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    a, b = cut(body), cut(b"some other beginning" + body)
    assert b"".join(a) == body and all(len(c) <= media.MOST for c in a) and all(len(c) >= media.LEAST for c in a[:-1])
    assert len(set(a) & set(b)) > 0.8 * len(a)


# --- toxicity


def test_toxicity(spark, no_docs):
    rng = np.random.default_rng(2)
    words = ["plain", "river", "stone", "music", "garden", "window"]
    texts = [(k, " ".join(rng.choice(words, 40).tolist() + (["you", "filthy" + words[k % 6][:2]] if k % 4 == 0 else [])), k % 4 == 0) for k in range(400)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in texts] + [(900, None), (901, ""), (0, texts[0][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(y)) for k, _, y in texts if k < 200] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((got[k] >= toxicity.THRESHOLD) == y for k, _, y in texts if k >= 200)
    assert got[900] == got[901] < 0.5 and all(0 <= s <= 1 for s in got.values())
    assert toxicity.score(no_docs, model).count() == 0
    assert not toxicity.train(docs, labels.filter("doc_id < 0")).table.any()


def plain_grams(text):
    """Distinct buckets of a text's n-grams, hashed one by one."""
    points, out = [ord(c) + 1 for c in f" {(text or '').lower()} "], set()
    for n in toxicity.LENGTHS:
        for i in range(len(points) - n + 1):
            h = 0
            for p in points[i : i + n]:
                h = (h * 0x100000001B3 + p) % 2**64
            out.add(int(mix64(np.array([h ^ n], np.uint64))[0]) >> 64 - toxicity.HASH_BITS)
    return out


def test_toxicity_against_a_plain_count(spark):
    """Log-count ratios, the condition of the least loss, and scores; with odd texts, repeated rows, ids and clashing columns."""
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["ab", "cde", "fgh", "zzz"], 6)) + (" vile" if k % 3 == 0 else "") for k in range(60)] + ["", None, "x", "é" * 5000]
    docs = spark.createDataFrame([(k, t, 0.5, 1) for k, t in enumerate(texts)] + [(0, texts[0], 0.5, 1), (None, "vile", 0.5, 1)], "doc_id long, text string, score double, y int")
    labels = [(k, int(k % 3 == 0)) for k in range(len(texts))] + [(None, 1), (3, None), (4, 1)]
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    rows_ = [(plain_grams(texts[k]), y) for k, y in labels if k is not None and y is not None]
    n = {c: sum(y == c for _, y in rows_) for c in (0, 1)}
    size, ratio = 1 << toxicity.HASH_BITS, {}
    for b in set().union(*(g for g, _ in rows_)):
        share = [(sum(b in g for g, y in rows_ if y == c) + toxicity.SMOOTHING * n[c] / len(rows_)) / n[c] for c in (0, 1)]
        ratio[b] = math.log(share[1] / share[0])
    # the table is 0 but for those n-grams, and its slope nearly vanishes: penalty * w = - sum of ratio * residual
    assert set(np.flatnonzero(model.table)) <= set(ratio)
    z = {k: model.intercept + sum(float(model.table[b]) for b in g) for k, (g, _) in enumerate(rows_)}
    loss = lambda scale: sum((toxicity.POSITIVE if y else 1) * (math.log1p(math.exp(-abs(v))) + max(v, 0) - y * v) for v, y in ((model.intercept + scale * (z[k] - model.intercept), y) for k, (_, y) in enumerate(rows_))) + toxicity.PENALTY / 2 * scale**2 * sum((float(model.table[b]) / r) ** 2 for b, r in ratio.items() if r)
    assert loss(1) < loss(0) and loss(1) <= min(loss(0.9), loss(1.1)) * 1.01
    got = Counter((r.doc_id, round(r.score, 5)) for r in toxicity.score(docs, model).collect())
    want = Counter((k, round(1 / (1 + math.exp(-(model.intercept + sum(float(model.table[b]) for b in plain_grams(t))))), 5)) for k, t in [*enumerate(texts), (0, texts[0]), (None, "vile")])
    assert got == want and len(model.table) == size


def test_sample_of_labelled_texts_is_bounded(spark):
    """An id with very many rows gives no more than the bound; equal rows count once."""
    docs = spark.createDataFrame([(1, f"hot {k % 50}") for k in range(500)] + [(k, f"t{k}") for k in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(2, None), (None, 1)], "doc_id long, toxic int")
    every = labelled.labelled_texts(docs, labels, "toxic", 1_000)
    assert rows(every, "text", "y") == Counter([(f"hot {k}", 1) for k in range(50)] + [(f"t{k}", k % 2) for k in range(2, 40)])
    assert 0 < labelled.labelled_texts(docs, labels, "toxic", 20).count() <= 20
    assert labelled.labelled_texts(docs.limit(0), labels, "toxic", 20).count() == 0


def test_logistic_fit_is_a_minimum():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(200, 3)), rng.random(200) < 0.4
    w, b = logistic.fit(x, y.astype(float), 2.0)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(x.T @ (p - y) + 2 * w).max() < 1e-2 and abs((p - y).sum()) < 1e-2


# --- fingerprints


def plain_print(text, rarity):
    """The digest of a text, window by window."""
    data = text.encode()
    if not data:
        return []
    data += bytes(max(0, 64 - len(data)))
    windows = [data[i : i + 64] for i in range(len(data) - 63)]
    keys = [(int(rarity[s]), i) for i, s in enumerate(fingerprint.entropy_steps(np.frombuffer(data, np.uint8)).tolist())]
    frames = [keys[i : i + 64] for i in range(max(1, len(keys) - 63))]
    wins, first = Counter(), {}
    for i in (min(f)[1] for f in frames):
        wins[windows[i]] += 1
        first[windows[i]] = min(i, first.get(windows[i], i))
    enough = min(16, len(frames), max(wins.values()))
    chain = []
    for i in sorted(first.values()):
        if wins[windows[i]] >= enough:
            h = np.array([0x9E3779B97F4A7C15], np.uint64)
            for k in range(8):
                h = mix64(h ^ np.frombuffer(windows[i], "<u8")[k : k + 1]) + np.uint64(k)
            if not chain or chain[-1][1] == 160:
                chain.append([set(), 0])
            chain[-1][0] |= {int(h[0]) >> 11 * k & 2047 for k in range(5)}
            chain[-1][1] += 1
    return chain


def plain_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    if (sum(n for _, n in a), len(a)) > (sum(n for _, n in b), len(b)):
        a, b = b, a
    total = 0
    for x, n in a:
        best = 0
        for y, _ in b:
            chance = len(x) * len(y) / 2048
            chance += 0.1 * (min(len(x), len(y)) - chance)
            best = max(best, min(1, max(0, (len(x & y) - chance) / max(min(len(x), len(y)) - chance, 1e-9))))
        total += n * best
    return total / sum(n for _, n in a)


def plain_string(chain):
    out = []
    for bits, n in chain:
        raw = bytearray(256)
        for b in bits:
            raw[b // 8] |= 128 >> b % 8
        out.append(f"{n:02x}{base64.b64encode(bytes(raw)).decode()}")
    return ".".join(out)


REPEATED = ["x" * 200, "ab" * 5_000, "a b c" * 30, "The same line, again.\n" * 300, "Other words stand here!\n" * 300, "q", "word " * 13, "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis no"]


def test_repetitive_and_short_texts_have_features_of_their_own():
    """Only texts without bytes have none, and unrelated texts are unlike however much they repeat themselves."""
    rarity = np.arange(fingerprint.STEPS)
    rng = np.random.default_rng(3)
    prose = ["".join(rng.choice(list("abcdefghij  "), n)) for n in range(64, 200, 7)]
    found = fingerprint.chains([t.encode() for t in [*REPEATED, *prose, ""]], rarity)
    assert [len(c[0]) > 0 for c in found] == [True] * (len(found) - 1) + [False]
    for i, a in enumerate(found):
        for j, b in enumerate(found):
            assert fingerprint.likeness(a, b) == pytest.approx(1) if i == j else fingerprint.likeness(a, b) < 0.5, (i, j)
    texts = [*REPEATED, *prose]
    assert [fingerprint.to_string(c) for c in found[:-1]] == [plain_string(plain_print(t, rarity)) for t in texts]


def test_edited_texts(docs, no_docs, corpus):
    """Also null and repeated ids, which follow by the hash of their text; against a digest made window by window."""
    rarity = fingerprint.fit_rarity(docs)
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    ordered = sorted((c[:2] for c in corpus), key=lambda c: (c[0] is None, -(c[0] or 0), hashes[c[1]]))
    want, known = Counter(), {}

    def print_of(text):
        if text not in known:
            known[text] = plain_print(text, rarity)
        return known[text]

    for k, (doc, text) in enumerate(ordered):
        text, after = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        a, b, c = map(print_of, (text, new, after))
        want[doc, len(text), sha(new), plain_string(a), plain_string(b), round(plain_likeness(a, b), 4), round(plain_likeness(a, c), 4)] += 1
    found = fingerprint.compare_edits(docs)
    rows_found = found.collect()
    assert Counter(tuple(r)[:5] for r in rows_found) == sum((Counter({k[:5]: n}) for k, n in want.items()), Counter())
    # likeness is summed in single precision
    assert sorted((*tuple(r)[:5], r.near_edited, r.near_next) for r in rows_found if r.doc_id is not None) == [(*w[:5], pytest.approx(w[5], abs=1e-3), pytest.approx(w[6], abs=1e-3)) for w in sorted(w for w in want.elements() if w[0] is not None)]
    assert fingerprint.compare_edits(no_docs).count() == 0


def test_next_text_of_extreme_and_hot_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "HOT_ROWS", 5)
    rows = [(-(2**63), "least"), (2**63 - 1, "most"), (0, "zero")] + [(7, f"seven {k % 30}") for k in range(90)] + [(8, "same")] * 60 + [(None, f"none {k % 3}") for k in range(50)] + [(k, f"t{k}") for k in range(20, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    want = Counter((d, t, ordered[(k + 1) % len(rows)][1]) for k, (d, t) in enumerate(ordered))
    assert Counter((r.doc_id, fingerprint.unpack(r.text), fingerprint.unpack(r.next_text)) for r in fingerprint.with_next(docs).collect()) == want


def test_likeness_tells_related_from_unrelated():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(97, 123, 4000).astype(np.uint8).tobytes() for _ in range(2))
    x, half, y, same = fingerprint.chains([a, a[:2000] + b[2000:], b, a], np.arange(fingerprint.STEPS))
    assert fingerprint.likeness(x, same) == pytest.approx(1) and 0.25 < fingerprint.likeness(x, half) < 0.8 and fingerprint.likeness(x, y) < 0.1


def test_entropy_of_windows():
    data = np.random.default_rng(4).integers(97, 105, 500).astype(np.uint8)
    steps = fingerprint.entropy_steps(data)
    for i in (0, 1, 200, len(steps) - 1):
        share = np.bincount(data[i : i + 64])
        share = share[share > 0] / 64
        assert abs(steps[i] - round(-(share * np.log2(share)).sum() / 6 * 1023)) <= 1


# --- repeated passages


def brute_repeats(pairs, window=50):
    first = {}
    words = [(d, WORD.findall(t or "")) for d, t in pairs]
    for d, w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if d is not None:
                first[k] = min(first.get(k, d), d)
    out = Counter()
    for d, w in words:
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                keep[i : i + window] = [False] * window
        kept = [x for x, k in zip(w, keep) if k]
        out[d, len(w), len(w) - len(kept), sha(" ".join(kept))] += 1
    return out


@pytest.mark.parametrize("runs", [5_000, 1])
def test_repeats(docs, no_docs, corpus, monkeypatch, runs):
    monkeypatch.setattr(substring, "MAX_RUNS", runs)
    got = rows(substring.remove_repeats(docs), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute_repeats([(c[0], c[1]) for c in corpus])
    assert substring.remove_repeats(no_docs).count() == 0


def test_search_of_a_block():
    rng = np.random.default_rng(6)
    for trial in range(20):
        sequences = [rng.integers(0, 3, rng.integers(4, 30)).astype(np.uint64) for _ in range(12)]
        docs = rng.integers(0, 6, 12)
        found = substring.search_block(sequences, docs, window=4)
        for k, s in enumerate(sequences):
            want = {i for i in range(len(s) - 3) if any(docs[j] < docs[k] and any(np.array_equal(t[p : p + 4], s[i : i + 4]) for p in range(len(t) - 3)) for j, t in enumerate(sequences))}
            assert {i for a, n in found[k] for i in range(a, a + n)} == want


def test_fm_index_counts():
    text = np.array([1, 2, 1, 3, 0, 2, 1, 2, 0], np.int64)
    order = suffix_array(text, 16)
    assert [text[i:].tolist() for i in order] == sorted(text[i:].tolist() for i in range(len(text)))
    index = FMIndex(text, np.zeros(len(text), np.int32), 16)
    low, high = np.zeros(1, np.int64), np.full(1, len(text))
    for symbol in (2, 1):  # the pattern 1 2, from its end
        low, high = index.extend(np.array([symbol]), low, high)
    assert high[0] - low[0] == 2


# --- simhash


def brute_print(text, k=4):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(len(w) - k, 0) + 1)] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_near_duplicates(docs, no_docs, corpus):
    texts = {}
    got = Counter((r.doc_id, r.fingerprint & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect())
    prints = [(c[0], texts.setdefault(c[1], brute_print(c[1]))) for c in corpus]
    reach = {f: {f} for _, f in prints}
    for f in reach:
        for g in reach:
            if (f ^ g).bit_count() <= 4 and reach[f] is not reach[g]:
                whole = reach[f] | reach[g]
                for x in whole:
                    reach[x] = whole
    want = Counter((d, f, min((e for e, g in prints if g in reach[f] and e is not None), default=None)) for d, f in prints)
    assert got == want
    assert simhash.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("segments", [None, 2, 3, 4])
def test_components_of_near_prints(spark, segments):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 30)
    values = sorted({int(b) for b in base} | {int(b) ^ sum(1 << int(x) for x in rng.choice(63, rng.integers(1, 8), False)) for b in base for _ in range(8)})
    got = {r.node: r.component for r in simhash.near_prints(spark.createDataFrame([(v,) for v in values], "f long"), segments=segments).collect()}
    want = {v: v for v in values}
    for a in values:
        for b in values:
            if a < b and (a ^ b).bit_count() <= 4 and want[a] != want[b]:
                old, new = max(want[a], want[b]), min(want[a], want[b])
                want = {k: new if g == old else g for k, g in want.items()}
    assert {v: got.get(v, v) for v in values} == want and len(set(want.values())) > 30


def test_segments_follow_the_size_of_the_table():
    assert [simhash.segments_for(n, 4) for n in (1_000, 1_000_000, 10**9)] == [3, 3, 2] and simhash.segments_for(10, 0) == 1
    widths = [simhash.segments_of(n) for n in (10, 10**4, 10**6, 10**9)]
    assert widths == sorted(widths) and all(w >= np.log2(n) for (w, _), n in zip(widths, (10, 10**4, 10**6, 10**9)))


def test_hot_keys_are_joined_as_others(spark):
    """50,000 rows of one key, a thousand of another, and single ones."""
    left = spark.range(60_000).select("id", F.when(F.col("id") < 50_000, 7).when(F.col("id") < 51_000, 8).otherwise(F.col("id")).alias("key"))
    right = left.groupBy("key").agg(F.count("*").alias("copies"), F.max("id").alias("last"))
    joined = storage.join_counted(left, right, ["key"], 60_000)
    assert joined.columns == ["key", "id", "last"]
    got = joined.groupBy("key").agg(F.count("*").alias("n"), F.min("last").alias("last")).collect()
    assert len(got) == 9_002 and {r.key: (r.n, r.last) for r in got if r.key < 10} == {7: (50_000, 49_999), 8: (1_000, 50_999)}
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().toString()


def test_shared_folder_is_asked_for_on_a_cluster():
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError):
        storage.shared_dir(Session())


def test_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 50), (50, 75), (60, 60)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 50, 75: 50, 50: 50}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- mixing


def test_mixing(docs, no_docs, corpus):
    got = mixing.mix(docs).collect()
    sizes = defaultdict(int)
    for c in corpus:
        sizes[c[3]] += len(WORD.findall(c[1] or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, full = {}, set()
    while True:
        rest, weight = sum(sizes.values()) - sum(3 * sizes[s] for s in full), sum(weights[s] for s in order if s not in full)
        target = {s: 3 * sizes[s] if s in full else rest * weights[s] / weight for s in order}
        over = {s for s in order if target[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    assert len(got) == len(corpus)
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source]
        rate = r.target / r.source_size
        assert r.copies in (math.floor(rate), math.ceil(rate)) and r.taken == r.copies * r.size <= 3 * r.size
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(docs.repartition(5)).collect()))
    assert mixing.mix(no_docs).count() == 0


def test_mixing_comes_near_its_targets(spark):
    many = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (1 + F.col("id") % 7).cast("int")).alias("text"), F.concat(F.lit("s"), F.col("id") % 5).alias("source"))
    for r in mixing.mix(many).groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect():
        assert abs(r.taken - r.target) < 0.06 * r.target


@pytest.mark.parametrize("hot, chunk", [(1_000, 4096), (2, 100)])
def test_mixing_of_rows_without_ids_and_of_equal_rows(spark, monkeypatch, hot, chunk):
    """All ids null, and of each source all rows equal; with sources joined either way, and equal rows in one chunk or many."""
    monkeypatch.setattr(storage, "HOT_ROWS", hot)
    monkeypatch.setattr(mixing, "CHUNK", chunk)
    shape = "cast(null as bigint) as doc_id", "repeat('w ', 3 + cast(id % 4 as int)) as text", "'en' as lang", "if(id % 4 = 3, null, concat('s', id % 4)) as source"
    many = spark.range(6000).selectExpr(*shape).union(spark.range(6000, 9000).selectExpr(shape[0], "concat('v', id) as text", *shape[2:]))
    mixed = mixing.mix(many)
    got = mixed.groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in got) == 9000
    for r in got:
        assert abs(r.taken - r.target) < 0.08 * r.target
    assert Counter(map(tuple, mixed.collect())) == Counter(map(tuple, mixing.mix(many.repartition(7)).collect()))


def test_mixing_of_nothing(spark):
    empty = spark.createDataFrame([(1, "", "a"), (2, None, None), (3, " ", "b")], "doc_id long, text string, source string")
    assert {(r.size, r.target, r.taken) for r in mixing.mix(empty).collect()} <= {(0, 0.0, 0)}
    some = spark.createDataFrame([(1, "", "a"), (2, "x y", "b")], "doc_id long, text string, source string")
    assert {r.doc_id: (r.target, r.taken) for r in mixing.mix(some).collect()} == {1: (0.0, 0), 2: (2.0, 2)}


# --- secrets

BASE = (("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16))


def brute_spans(text):
    return sorted((m.start(), k, m.end()) for k, (_, p, g, least) in enumerate(BASE) for m in p.finditer(text) if len(m.group(g)) >= least)


def test_secrets(docs, no_docs, corpus):
    got = Counter((r.doc_id, tuple((s.start, s.kind, s.end) for s in r.spans if s.kind < 3)) for r in secrets.scan(docs).collect())
    assert got == Counter((c[0], tuple(brute_spans(c[1] or ""))) for c in corpus)
    assert secrets.scan(no_docs).count() == 0


def test_secrets_of_awkward_texts(spark):
    texts = ["token=secret=abcdefghijkl12", "secret: token: abcdefghijklmnop", "AKIAAKIA" + "B" * 14, "AKIA" + "1" * 13, "x" + "f" * 16 + "g" + "0" * 15, "API_KEY='" + "z" * 12 + "' apikey=" + "9" * 30, "TOKENK=abcdefabcdefabcdef", "😀token: aaaaaaaaaaaa", "password" * 3 + "=" + "a" * 20]
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.spans if s.kind < 3] for r in secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {k: brute_spans(t) for k, t in enumerate(texts)}


def test_redaction(spark):
    df = spark.createDataFrame([(0, "a token: deadbeefdeadbeef00 b 0123456789abcdef"), (1, "clean"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.t for r in secrets.scan(df).select("doc_id", secrets.redact(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert got == {0: "a <secret> b <secret>", 1: "clean", 2: None}


def test_secrets_of_a_text_with_very_many_matches(spark):
    text = "é" + " ".join(f"token={k:012d}abc AKIA{k:014d}" for k in range(20_000))
    df = spark.createDataFrame([(1, text), (2, "x" * 100_000)], "doc_id long, text string")
    began = time.perf_counter()
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.spans if s.kind < 3] for r in secrets.scan(df).select("doc_id", "spans").collect()}
    assert time.perf_counter() - began < 40
    assert got == {1: brute_spans(text), 2: []} and len(got[1]) >= 40_000
    some = secrets.scan(spark.createDataFrame([(1, text[:100_000])], "doc_id long, text string"))
    clean = some.select(secrets.redact(F.col("text"), F.col("spans")).alias("t")).first().t
    assert re.fullmatch(r"é(<secret> )+\S*", clean)


def test_added_kinds_of_secrets(spark):
    texts = ["ghp_" + "Z" * 36, "gho_" + "Z" * 35, "xoxb-12345-abcdef", "eyJ" + "a" * 10 + ".eyJ" + "b" * 10 + "." + "c" * 10, "-----BEGIN RSA PRIVATE KEY----- -----BEGIN PRIVATE KEY-----", None]
    got = {r.doc_id: [(s.start, secrets.RULES[s.kind].kind, s.end) for s in r.spans] for r in secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {k: sorted((m.start(), r.kind, m.end()) for r in secrets.RULES for m in re.finditer(r.pattern, t or "", re.I if r.ignore_case else 0) if len(m[r.group]) >= r.least) for k, t in enumerate(texts)}
    assert {kind for spans in got.values() for _, kind, _ in spans} == {"hosting", "chat", "jwt", "private"}


def test_running_sums(spark):
    rows = spark.createDataFrame([([],), ([5],), (list(range(1, 20)),)], "x array<int>")
    got = [r.s for r in rows.select(secrets.running(F.col("x"), lambda a, b: a + b).alias("s")).collect()]
    assert got == [[], [5], np.cumsum(range(1, 20)).tolist()]


def test_bitmaps_and_postings_pick_the_same_candidates(docs):
    """Intersections of a table of postings, and of the bits of each row; no rule matches outside of its candidates."""
    keyed = docs.filter("text is not null").select("text", F.md5("text").alias("_id"), F.lit(0).alias("_sum"))
    by_table = {r._id: set(r.rules) for r in secrets.candidates(secrets.postings(keyed)).collect()}
    maps = [m.alias(f"w{k}") for k, m in enumerate(secrets.bitmaps(F.col("text")))]
    met = [secrets.meets(r, secrets.RULES, [F.col(f"w{k}") for k in range(len(maps))]).alias(r.kind) for r in secrets.RULES]
    for row in keyed.select("_id", "text", *maps).select("_id", "text", *met).collect():
        by_bits = {r.kind for r in secrets.RULES if row[r.kind] and r.kind != "hex"}
        assert by_bits == by_table.get(row._id, set()) and row["hex"]
        assert {r.kind for r in secrets.RULES if re.search(r.java, row.text)} <= by_bits | {"hex"}


def test_trigram_queries():
    def sets(p, i=False):
        return {frozenset(s) for s in trigram_query(p, i).any}

    assert sets("abcd|xyz") == {frozenset({"abc", "bcd"}), frozenset({"xyz"})}
    assert sets("Ab?cd", True) == {frozenset({"abc", "bcd"}), frozenset({"acd"})}
    assert sets("x(.*abc)def") == {frozenset({"abc", "def"})}
    assert trigram_query("abcd|ef").matches_all and trigram_query("[0-9]+").matches_all


# --- quality


def test_quality(spark, no_docs):
    rng = np.random.default_rng(8)
    good = [" ".join("".join(rng.choice(list("aeiourstln"), 5)) for _ in range(80)) for _ in range(120)]
    texts = [(k, g if k % 3 else " ".join(f"{w.upper()}!!" for w in g.split()[:5] * 16), f"host{k % 4}", "en") for k, g in enumerate(good)]
    docs = spark.createDataFrame([*texts, (500, None, None, None), (501, "", "new", "en"), texts[1]], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(60)] + [(None, 1), (7, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    assert all(got[k].keep == (k % 3 > 0) for k in range(120)) and {500, 501} <= got.keys()
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.filter("doc_id = 1").count() == 2
    assert quality.judge(no_docs.drop("host"), labels).count() == 0


def test_quality_against_plain_posteriors(spark):
    """Posteriors and combined probabilities by hand from the evidence, with null and repeated sites."""
    rng = np.random.default_rng(9)
    sites = [("a", "x"), ("a", "y"), ("b", "x"), (None, "x"), ("b", None), ("c", "z")]
    rows_ = [(k, *sites[int(rng.integers(6))], float(rng.normal(1, 4))) for k in range(300)] + [(None, "a", "x", 20.0), (0, "c", "z", -20.0)]
    frame = spark.createDataFrame(rows_, "doc_id long, host string, path string, evidence double")
    found, share = quality.site_posteriors(frame, "host", "path")
    good = lambda e: 1 / (1 + math.exp(-max(-quality.EVIDENCE, min(quality.EVIDENCE, e))))
    sums = defaultdict(lambda: [0.0, 0])
    for _, h, p, e in rows_:
        for key in ((), (h,), (h, p)):
            sums[key][0] += good(e)
            sums[key][1] += 1
    whole = sums[()][0] / sums[()][1]
    assert share == pytest.approx(whole)

    def strength(keys, prior):
        some = [(sums[k][0] / sums[k][1], sums[k][1], prior(k)) for k in keys if sums[k][1] >= 2]
        spread, chance = sum(n * (s - p) ** 2 for s, n, p in some), sum(p * (1 - p) for _, _, p in some)
        beyond = (spread - chance) / sum(n * p * (1 - p) for _, n, p in some)
        return min(max(1 / beyond - 1, quality.STRENGTH[0]), quality.STRENGTH[1]) if beyond > 0 else quality.STRENGTH[1]

    hosts, paths = [k for k in sums if len(k) == 1], [k for k in sums if len(k) == 2]
    a = strength(hosts, lambda k: whole)
    of_host = {k: (sums[k][0] + a * whole) / (sums[k][1] + a) for k in hosts}
    b = strength(paths, lambda k: of_host[k[:1]])
    want = {k: (of_host[k[:1]], (sums[k][0] + b * of_host[k[:1]]) / (sums[k][1] + b)) for k in paths}
    got = {(r.host, r.path): (r.host_share, r.path_share) for r in found.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-6) for k in want)


def test_verdicts_follow_from_evidence_and_site(docs, no_docs, spark):
    """On the odd corpus: quality is the log odds moved by the path's posterior against the corpus's share."""
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(1, 40)], "doc_id long, quality int")
    got = quality.judge(docs.drop("host"), labels).collect()
    assert len(got) == docs.count()
    good = [1 / (1 + math.exp(-max(-quality.EVIDENCE, min(quality.EVIDENCE, r.evidence)))) for r in got]
    share = sum(good) / len(good)
    for r in got:
        bounded = min(max(r.path_share, 1e-6), 1 - 1e-6)
        z = r.evidence + math.log(bounded / (1 - bounded)) - math.log(share / (1 - share))
        assert r.quality == pytest.approx(1 / (1 + math.exp(-max(-500, min(500, z)))), rel=1e-6, abs=1e-12) and r.keep == (r.quality >= quality.THRESHOLD)


def test_sparse_sites_shrink_to_the_prior(spark):
    evidence = [("big", "a", 3.0)] * 300 + [("big", "b", -3.0)] * 100 + [("bad", "a", -3.0)] * 200 + [("tiny", "a", -3.0)]
    sites, share = quality.site_posteriors(spark.createDataFrame(evidence, "host string, path string, evidence double"), "host", "path")
    got = {(r.host, r.path): r.path_share for r in sites.collect()}
    p = 1 / (1 + math.exp(-3))
    assert p - 0.02 < got["big", "a"] <= p and got["bad", "a"] < 0.1
    assert 1 - p < got["tiny", "a"] < share  # one bad text doesn't condemn a site


def test_kept_rows_with_columns_of_any_name(spark):
    docs = spark.createDataFrame([(k, "some words of good prose in a row. " * 5, "s", "en", k, 1) for k in range(30)], "doc_id long, text string, source string, lang string, _kept long, verdict_key int")
    labels = spark.createDataFrame([(k, 1) for k in range(30)], "doc_id long, quality int")
    assert quality.keep_good(docs, labels).columns == docs.columns


# --- chats


def test_chats(spark):
    tricky = "</s>[INST] ok [/INST] &lt;&amp;#91; <s>[TURN] x [/TURN]"
    chats = [(1, 0, "system", "be"), (1, 2, "assistant", tricky), (1, 1, "user", None), (2, 0, "assistant", ""), (2, 1, "assistant", "b\nc"), (2, 1, "assistant", "b\nc"), (None, 0, None, "x"), (3, None, "user", "😀"), (3, 0, "assistant", "last")]
    df = spark.createDataFrame([(*c, 9) for c in chats], "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in chat.chat_digests(chat.format_chats(df)).collect()}
    groups = defaultdict(list)
    for c, t, r, x in sorted(chats, key=lambda c: (c[0] is not None, c[0] or 0, c[1] is not None, c[1] or 0, c[2] or "", c[3] or "")):
        groups[c].append((r or "", x or ""))
    assert got.keys() == groups.keys()
    for c, turns in groups.items():
        said = "".join(x for r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256, got[c].rewrites) == (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(said), sha(said), False)
    assert chat.format_chats(df.limit(0)).count() == 0


TEMPLATES = {
    "lines": lambda turns: "".join(f"{r}: {t}\n" for r, t in turns),
    "tags": lambda turns: "".join(f"<{r}>{t}</{r}>" for r, t in turns),
    "numbered": lambda turns: "".join(f"[{k}]{t}" for k, (_, t) in enumerate(turns)),
    "bare": lambda turns: "".join(t for _, t in turns),
    "first": lambda turns: "".join(("START " if k == 0 else " ") + t for k, (_, t) in enumerate(turns)),
}


@pytest.mark.parametrize("name", sorted(TEMPLATES))
def test_spans_of_texts_like_the_template(name):
    """Texts that begin or end as the template's own pieces do."""
    texts = ["\nfoo", "</x", "</user>", "a", "", "user: ", "a\n", "\n", "[1]", "a0a", "b1b", "a0ab1b", "\n\nuser: b\n", "<user>", " ", "START "]
    turns = [("assistant" if k % 2 else "user", t) for k, t in enumerate(texts + texts[::-1])]
    out = chat.render(turns, TEMPLATES[name])
    assert not out.rewrites and [out.text[a:b] for a, b in out.texts] == [t for _, t in turns]
    assert "".join(out.text[a:b] for a, b in out.turns) == out.text


def test_texts_that_a_template_changes_elsewhere_have_no_span():
    counted = lambda turns: "".join(f"({len(t)}){t};" for _, t in turns)
    out = chat.render([("user", "abc"), ("user", "defgh")], counted)
    assert [s if s is None else out.text[slice(*s)] for s in out.texts] in ([None, None], ["abc", None], [None, "defgh"], ["abc", "defgh"])
    trimmed = lambda turns: "".join(f"<{t.strip()}>" for _, t in turns)
    out = chat.render([("user", " x "), ("user", "y")], trimmed)
    assert [out.text[a:b] for a, b in out.texts] == ["x", "y"]


def test_a_very_long_conversation():
    turns = [("user" if k % 2 else "assistant", f"text {k}") for k in range(20_000)]
    began = time.perf_counter()
    out = chat.render(turns)
    assert time.perf_counter() - began < 60
    assert [out.text[a:b] for a, b in out.texts] == [t for _, t in turns]


def test_trained_texts_without_a_span_are_counted(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "Yes"), (1, 2, "assistant", ""), (1, 3, "assistant", "NO")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    shouted = chat.format_chats(df, lambda turns: "".join(f"<{t.upper()}>" for _, t in turns)).first()
    assert shouted.lost >= 1 and len(shouted.loss) + shouted.lost >= 2 and not shouted.rewrites
    plain = chat.format_chats(df).first()
    assert plain.lost == 0 and len(plain.loss) == 3


def test_templates_that_rewrite_history():
    def dated(turns):
        return f"{len(turns)} turns\n" + "".join(f"<{r}>{t}</{r}>" for r, t in turns)

    def drops_thought(turns):
        return "".join(f"<{r}>{'' if r == 'thought' and k + 1 < len(turns) else t}</{r}>" for k, (r, t) in enumerate(turns))

    turns = [("user", "a"), ("thought", "hm"), ("assistant", "b")]
    assert chat.render(turns, dated).rewrites and chat.render(turns, drops_thought).rewrites
    assert chat.render(turns, drops_thought).turns[0] == (0, 14) and chat.render(turns, drops_thought).turns[1] is None
    plain = chat.render(turns)
    assert not plain.rewrites and [plain.text[a:b] for a, b in plain.texts] == ["a", "hm", "b"]


# --- tokens


def test_bpe(docs, no_docs, corpus):
    reference = Tokenizer.from_file(VOCABULARY)
    reference.no_truncation()
    reference.no_padding()
    want = Counter()
    for c in corpus:
        ids = reference.encode(c[1] or "", add_special_tokens=False).ids
        want[c[0], len(ids), sha(np.array(ids, "<u4").tobytes()), sha(reference.decode(ids, skip_special_tokens=False))] += 1
    assert rows(bpe.digests(docs, VOCABULARY), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    full = {(r.doc_id, r.n_tokens, sha(np.array(r.ids, "<u4").tobytes()), sha(r.decoded)) for r in bpe.encode(docs, VOCABULARY).collect()}
    assert full == set(want)
    assert bpe.digests(no_docs, VOCABULARY).count() == 0


def test_bpe_of_odd_letters():
    reference = Tokenizer.from_file(VOCABULARY)
    with open(VOCABULARY, encoding="utf-8") as f:
        encoder = bpe.Encoder(f.read())
    rng = np.random.default_rng(9)
    letters = list("aeinorstABCthe   'sll\n\t\x1c\x85 éÉçñüß<|>0123ΣσςİıK中日한🙂́ﬁ​$%&") + ["<|endoftext|>", "<|startoftext|>"]
    for _ in range(1500):
        text = "".join(rng.choice(letters, rng.integers(0, 50)))
        ids = reference.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids
        assert encoder.decode(np.array(ids, np.int64)).decode() == reference.decode(ids, skip_special_tokens=False)


def test_long_texts_have_the_grams_of_their_pieces():
    import numpy as np

    from lattica.llm import toxicity

    texts = ["", None, "short", "Ab" * 40 + "é" * 30 + "tail words " * 20, "x", "again " * 50]
    whole = [np.sort(x) for x in toxicity.distinct_grams(texts, most=1 << 20)]
    pieces = [np.sort(x) for x in toxicity.distinct_grams(texts, most=64)]
    assert len(whole) == len(pieces) == len(texts)
    assert all((a == b).all() if len(a) == len(b) else False for a, b in zip(whole, pieces))
    assert all(len(np.unique(x)) == len(x) for x in pieces)
