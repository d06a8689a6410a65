"""Quality of documents: a classifier's evidence combined with the posteriors of their site, by hierarchical empirical Bayes.

A logistic regression on a bounded sample of labelled texts gives each text a log odds. The share of good texts of a
host is shrunk toward the share of the whole corpus, and that of a path toward its host's, each by a strength that the
spread of the shares among hosts or paths gives; sites with few texts therefore say little. A text's log odds are then
moved by what its path's posterior differs from the corpus's share.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import labelled_texts
from .logistic import fit
from .storage import discard, materialize
from .text import text_blocks, word_hashes, word_spans

#: The classifier is fitted on at most so many labelled texts.
SAMPLE = 20_000
#: Evidence beyond this many log odds counts as this many when sites' shares are added up.
EVIDENCE = 12.0
#: Texts are rejected if the combined probability of being good is below this.
THRESHOLD = 0.25
#: Bytes of text whose features are worked out at once; a block takes about 60 times as much memory.
BLOCK = 1 << 20
#: Bounds of the strength of a prior, in texts.
STRENGTH = (1.0, 10_000.0)

FEATURES = ("log_words", "upper", "digits", "marks", "bars", "exclaims", "other_signs", "word_length", "distinct_words", "same_as_last", "distinct_pairs", "lines", "high_bytes")


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_CLASSES = (_class(bytes(range(65, 91))), _class(bytes(range(48, 58))), _class(b"#$%&*@^~_=+<>{}\\"), _class(b"|"), _class(b"!"), _class(b"\"'(),-./:;?[]`"))
_HIGH = np.arange(256) >= 128


def describe_texts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text of a block."""
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    sizes = np.maximum(np.diff(offsets), 1)
    starts, ends, first = word_spans(data, offsets)
    n_words = np.diff(first)
    some = np.maximum(n_words, 1)

    def per_text(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    out[:, 0] = np.log1p(n_words)
    for k, table in enumerate(_CLASSES):
        out[:, 1 + k] = np.log(per_text(table[data]) / sizes + 1e-3)
    text = np.repeat(np.arange(n), n_words)
    out[:, 7] = np.bincount(text, (ends - starts).astype(float), n) / some
    words = word_hashes(data, starts, ends)
    if len(words):
        order = np.lexsort((words, text))
        new = np.ones(len(words), bool)
        new[1:] = (words[order][1:] != words[order][:-1]) | (text[order][1:] != text[order][:-1])
        out[:, 8] = np.bincount(text[order][new], minlength=n) / some
        same = np.zeros(len(words), bool)
        same[1:] = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
        out[:, 9] = np.log(np.bincount(text[same], minlength=n) / some + 1e-3)
        pairs = words.copy()
        pairs[1:] += words[:-1] * np.uint64(0x9E3779B97F4A7C15)
        order = np.lexsort((pairs, text))
        new[1:] = (pairs[order][1:] != pairs[order][:-1]) | (text[order][1:] != text[order][:-1])
        out[:, 10] = np.bincount(text[order][new], minlength=n) / some
    out[:, 11] = np.log(per_text(data == 10) / some + 1e-3)
    out[:, 12] = per_text(_HIGH[data]) / sizes
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    intercept: float

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Log odds of being good, of features and of their squares, whose range the sample bounds."""
        return _expand(x, self.mean, self.scale) @ self.weights + self.intercept


def _expand(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -4, 4)
    return np.concatenate([z, z * z], axis=1)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, penalty: float = 1.0) -> Model:
    """Fit on labels (doc_id, quality) and their texts in docs. No labels, or one class only, give a constant.

    Labels that are null don't count; see labelled_texts for ids with several labels or texts.
    """
    texts = labelled_texts(docs, labels, "quality", sample)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_blocks(batches, most=BLOCK):
            x = describe_texts(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))], ["y", "x"])

    found = texts.mapInArrow(rows, "y int, x array<double>").toArrow()
    y = found.column("y").to_numpy().astype(float)
    x = found.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES)) if len(y) else np.zeros((0, len(FEATURES)))
    d = len(FEATURES)
    if len(np.unique(y)) < 2:
        return Model(np.zeros(d), np.ones(d), np.zeros(2 * d), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))) if len(y) else 0.0)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = _expand(x, mean, scale)
    weights, intercept = fit(z, y, penalty)
    return Model(mean, scale, weights, intercept)


def evidence(docs: DataFrame, model: Model) -> DataFrame:
    """The classifier's log odds of every whole text: the columns of docs that it is given, and evidence."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_blocks(batches, most=BLOCK):
            z = shared.value.evidence(describe_texts(data, offsets))
            kept = [c for c in names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(z)], [*kept, "evidence"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(rows, f"{kinds}, evidence double")


def _strength(shares: DataFrame, prior: Column) -> float:
    """Strength of a beta prior from the spread of the shares (good / n) around it beyond what their sizes explain."""
    share = F.col("good") / F.col("n")
    row = shares.filter("n >= 2").agg(F.sum("n").alias("w"), F.sum(F.col("n") * F.pow(share - prior, 2)).alias("spread"), F.sum(prior * (F.lit(1.0) - prior)).alias("chance"), F.sum(F.col("n") * prior * (F.lit(1.0) - prior)).alias("most")).first()
    if not row["w"] or not row["most"]:
        return STRENGTH[1]
    beyond = (row["spread"] - row["chance"]) / row["most"]  # share of the variance that lies between sites
    return float(np.clip(1 / beyond - 1, *STRENGTH)) if beyond > 0 else STRENGTH[1]


def site_posteriors(evidences: DataFrame, host: str, path: str) -> tuple[DataFrame, float]:
    """Posterior share of good texts of each (host, path), and the share of the corpus.

    Sums per path come first, with a partial aggregation in each task; hosts add up their paths.
    """
    p = 1 / (1 + F.exp(-F.greatest(F.least(F.col("evidence"), F.lit(EVIDENCE)), F.lit(-EVIDENCE))))
    paths = materialize(evidences.groupBy(F.col(host).alias("host"), F.col(path).alias("path")).agg(F.sum(p).alias("good"), F.count("*").alias("n")), "quality-paths")
    total = paths.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    share = float(np.clip(total["good"] / total["n"], 1e-6, 1 - 1e-6)) if total["n"] else 0.5
    hosts = paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    a = _strength(hosts, F.lit(share))
    hosts = hosts.select(F.col("host").alias("_host"), ((F.col("good") + F.lit(a * share)) / (F.col("n") + F.lit(a))).alias("host_share"))
    joined = paths.join(hosts, paths["host"].eqNullSafe(hosts["_host"])).drop("_host")
    b = _strength(joined, F.col("host_share"))
    return joined.select("host", "path", "host_share", ((F.col("good") + F.lit(b) * F.col("host_share")) / (F.col("n") + F.lit(b))).alias("path_share")), share


def verdict_key(host: str = "source", path: str = "lang") -> Column:
    """A 64-bit hash of all that a row's verdict rests on, and of its id; nulls are told from values that are absent."""
    return F.xxhash64(*[x for c in ("doc_id", "text", host, path) for x in (F.col(c).isNull(), F.col(c))])


def judge(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = THRESHOLD, keyed: bool = False) -> DataFrame:
    """Every document with its evidence, host_share, path_share, quality (combined probability) and keep (quality >= threshold).

    host and path name the columns that tell sites and their parts; null is a site of its own. Null texts are empty.
    Returns the columns doc_id, host, path besides these, and verdict_key if keyed; other columns of docs don't take part.
    """
    model = train(docs, labels)
    key = [verdict_key(host, path).alias("verdict_key")] if keyed else []
    own = docs.select("doc_id", "text", F.col(host).alias("host"), F.col(path).alias("path"), *key)
    scored = materialize(evidence(own, model), "quality-evidence")
    sites, share = site_posteriors(scored, "host", "path")
    # sites are as many as the corpus has; a few copies of each spread the documents of a hot one over many tasks
    salts = 16
    spread = sites.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "host_share", "path_share", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    joined = salted.join(spread, salted["host"].eqNullSafe(spread["_host"]) & salted["path"].eqNullSafe(spread["_path"]) & (salted["salt"] == spread["_salt"]))
    bounded = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("path_share")))
    logit = F.col("evidence") + F.log(bounded / (1 - bounded)) - F.lit(float(np.log(share / (1 - share))))
    quality = 1 / (1 + F.exp(-F.greatest(F.least(logit, F.lit(500.0)), F.lit(-500.0))))
    return joined.select("doc_id", "host", "path", *["verdict_key"] * keyed, "evidence", "host_share", "path_share", quality.alias("quality")).withColumn("keep", F.col("quality") >= threshold)


def keep_good(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns. Each row follows its own verdict, whatever other rows of its doc_id do."""
    name = f"_kept_{uuid.uuid4().hex}"  # like no column of docs
    kept = judge(docs, labels, host, path, threshold, keyed=True).filter("keep").select(F.col("verdict_key").alias(name)).distinct()
    return docs.join(kept, verdict_key(host, path) == F.col(name), "left_semi")
