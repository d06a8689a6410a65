"""Toxicity of texts: a linear classifier over character n-grams, each scaled by its naive Bayes log-count ratio."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import labelled_texts
from .logistic import log_loss, minimise
from .storage import discard, materialize
from .text import mix64, text_blocks

#: Lengths of the n-grams, and the bits of their hashes: the table of weights that is broadcast has 2 ** HASH_BITS floats (1 MB).
LENGTHS: tuple[int, ...] = (4, 5, 6)
HASH_BITS = 18
#: The classifier is fitted on at most so many labelled texts; all of their n-grams take part.
SAMPLE = 20_000
#: The sample lies in so many parts at most; each gives one vector of sums a pass.
PARTS = 16
#: Rows of the sample hold the n-grams of some BLOCK bytes of text each, so that their arrays stay small for the collector;
#: so many rows are read and go to Python at once.
BLOCK, BATCH = 1 << 14, 32
#: Counts are smoothed by so many texts, divided by the shares of the classes: n-grams of a few texts say little.
SMOOTHING = 100.0
#: Toxic texts are the rarer class and count so many times in the fit.
POSITIVE = 20.0
PENALTY = 1.0
THRESHOLD = 0.7

_PRIME = np.uint64(0x100000001B3)


def _distinct(parts: list[str], lengths: Sequence[int], last: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct buckets of the n-grams of each part. last: a table of 2 ** HASH_BITS places to work in."""
    ends = np.cumsum([len(p) for p in parts]).tolist()
    points = np.frombuffer("".join(parts).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64) + np.uint64(1)
    hashes, buckets = np.zeros(len(points), np.uint64), []
    for n in range(1, max(lengths) + 1):
        shifted = np.zeros(len(points), np.uint64)
        shifted[: max(0, len(points) - n + 1)] = points[n - 1 :]
        hashes = hashes * _PRIME + shifted
        if n in lengths:
            buckets.append((n, (mix64(hashes ^ np.uint64(n)) >> np.uint64(64 - HASH_BITS)).astype(np.int64)))
    for a, b in zip([0, *ends], ends):
        own = np.concatenate([at[a : max(a, b - n + 1)] for n, at in buckets])
        # of equal buckets the place written last stays
        places = np.arange(len(own))
        last[own] = places
        yield own[last[own] == places]


def distinct_grams(texts: Sequence[str | None], lengths: Sequence[int] = LENGTHS, most: int = 1 << 16) -> Iterator[np.ndarray]:
    """The distinct buckets of each whole text's n-grams, in lower case and with a blank before and after it.

    Work is done on some `most` characters at once; a longer text is read in pieces that overlap, which have the same n-grams.
    """
    last = np.zeros(1 << HASH_BITS, np.int64)
    held, parts = 0, []
    for text in texts:
        part = f" {(text or '').lower()} "
        if held + len(part) > most:
            yield from _distinct(parts, lengths, last)
            held, parts = 0, []
        if len(part) <= most:
            parts.append(part)
            held += len(part)
            continue
        there = np.zeros(1 << HASH_BITS, bool)
        for at in range(0, len(part), most):
            for own in _distinct([part[at : at + most + max(lengths) - 1]], lengths, last):
                there[own] = True
        yield np.flatnonzero(there)
    yield from _distinct(parts, lengths, last)


@dataclass
class Model:
    lengths: tuple[int, ...]
    #: Of each bucket the weight times the log-count ratio.
    table: np.ndarray
    intercept: float = 0.0


def ratios(clean: np.ndarray, toxic: np.ndarray, n_clean: int, n_toxic: int) -> np.ndarray:
    """Naive Bayes log-count ratios from the numbers of texts that hold each n-gram. Smoothed so that an n-gram of no text has 0."""
    n = n_clean + n_toxic
    return np.log((toxic + SMOOTHING * n_toxic / n) / n_toxic) - np.log((clean + SMOOTHING * n_clean / n) / n_clean)


def _sample_blocks(lengths: Sequence[int]) -> Callable:
    """Texts with labels as rows of many texts each: labels, ends of the lists, buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in text_blocks(batches, most=BLOCK):
            found = list(distinct_grams(batch.column("text").to_pylist(), lengths))
            ends = np.cumsum([len(x) for x in found])
            values = [batch.column("y").to_numpy().astype(np.int8), ends, np.concatenate(found).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in values], ["y", "ends", "buckets"])

    return run


def _passed(blocks: DataFrame, use: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum over the sample of what use(labels, text of each entry, buckets) gives: one vector per part reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros(size), ""
        for batch in batches:
            for y, ends, buckets in zip(*(batch.column(c) for c in ("y", "ends", "buckets"))):
                sizes = np.diff(np.frombuffer(ends.as_buffer(), np.int64), prepend=0)
                values = np.frombuffer(buckets.as_buffer(), np.int32)
                first = first or f"{len(values)}:{values[:4].tolist()}"
                total += use(np.frombuffer(y.as_buffer(), np.int8).astype(float), np.repeat(np.arange(len(sizes)), sizes), values)
        if first:
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["first", "sums"])

    out, conf = np.zeros(size), blocks.sparkSession.conf
    # both readers take thousands of rows at once otherwise, here the whole part
    before = {key: conf.get(key) for key in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")}
    for key in before:
        conf.set(key, str(BATCH))
    try:
        for row in sorted(blocks.mapInArrow(run, "first string, sums binary").collect()):
            out += np.frombuffer(row["sums"], np.float32)
    finally:
        for key, value in before.items():
            conf.set(key, value)
    return out


def train(docs: DataFrame, labels: DataFrame, lengths: tuple[int, ...] = LENGTHS, sample: int = SAMPLE, penalty: float = PENALTY, positive: float = POSITIVE) -> Model:
    """Fit on the rows of labels (doc_id, toxic) and their texts in docs. labels without rows, or of one class, give a constant score.

    Labels that are null don't count; see labelled_texts for ids with several labels or texts. The tasks hold the sample;
    the driver holds vectors of 2 ** HASH_BITS values. Each pass over the sample gives the loss and its slope.
    """
    size = 1 << HASH_BITS
    texts = labelled_texts(docs, labels, "toxic", sample)
    blocks = materialize(texts.coalesce(PARTS).mapInArrow(_sample_blocks(lengths), "y binary, ends binary, buckets binary"), "toxicity-sample")

    def count(y: np.ndarray, text: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        marks = y[text]
        return np.concatenate([np.bincount(buckets[marks == c], minlength=size) for c in (0, 1)] + [[(y == c).sum() for c in (0, 1)]])

    counts = _passed(blocks, count, 2 * size + 2)
    n_clean, n_toxic = (int(x) for x in counts[-2:])
    prior = float(np.log((n_toxic + 0.5) / (n_clean + 0.5)))
    if not n_clean or not n_toxic:
        discard(blocks)
        return Model(lengths, np.zeros(size, np.float32), prior)
    ratio = ratios(counts[:size], counts[size : 2 * size], n_clean, n_toxic)
    context = docs.sparkSession.sparkContext

    def f(w: np.ndarray) -> tuple[float, np.ndarray]:
        now = context.broadcast(((w[:-1] * ratio).astype(np.float32), float(w[-1])))

        def slopes(y: np.ndarray, text: np.ndarray, buckets: np.ndarray) -> np.ndarray:
            table, intercept = now.value
            value, slope = log_loss(np.bincount(text, table[buckets], len(y)) + intercept, y, positive)
            return np.append(np.bincount(buckets, slope[text], size), [slope.sum(), value])

        sums = _passed(blocks, slopes, size + 2)
        now.unpersist()
        return float(sums[-1]) + penalty * float(w[:-1] @ w[:-1]) / 2, np.append(sums[:size] * ratio + penalty * w[:-1], sums[-2])

    start = np.zeros(size + 1)
    start[-1] = prior + np.log(positive)
    w = minimise(f, start, steps=30, tolerance=1e-3)
    discard(blocks)
    return Model(lengths, (w[:-1] * ratio).astype(np.float32), float(w[-1]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Probability that a whole text is toxic: doc_id, score. Null and empty texts have the score of no n-grams at all.

    Rows stay as they are, also those that repeat; other columns don't take part.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch, _, _ in text_blocks(batches):
            z = np.array([float(model.table[own].sum(dtype=float)) for own in distinct_grams(batch.column("text").to_pylist(), model.lengths)]) + model.intercept
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], ["doc_id", "score"])

    own = docs.select("doc_id", "text")
    return own.mapInArrow(rows, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, score double")
