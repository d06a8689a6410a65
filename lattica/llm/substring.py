"""Removal of passages that repeat across documents, by an FM-index per shard.

The windows of a document (50 consecutive words) are cut in runs whose windows share their minimizer, the least hash
among their 8-word grams. Equal windows have equal minimizers, so runs that share one meet in the same shard, and each
window meets the windows it can equal exactly once. Runs that are equal as a whole are merged first. Words are told apart by
XXH64 and runs by the XXH3-128 of their words' hashes. A shard indexes
the distinct runs of its minimizers in an FM-index; the same runs are then streamed through it: backward search over
the wavelet matrix follows a window as long as the match also occurs in a document of a smaller id, and reports the
intervals that reach the full length. Minimizers that occur in one document only never leave the first stage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fmindex import FMIndex
from .storage import discard, materialize
from .text import exact_word_hashes, mix64, range_hashes, text_blocks, word_spans

WINDOW, GRAM = 50, 8
#: Words in one index; a shard builds one index after another, each over whole minimizers.
BLOCK_WORDS = 300_000
#: A minimizer with more distinct runs than this would be a group without bound in one task. Its windows are compared one by
#: one instead: each goes by its own hash, with a minimum per hash as a partial aggregation. Results are the same.
MAX_RUNS = 5_000
#: A run that makes up more than this share of all goes to its verdict by a broadcast join, as one task would get them all otherwise; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1e-3


def _runs(words: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of all texts of a block: text, start (in the block), number of windows, minimizer's hash."""
    n = len(words) - gram + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    grams = np.zeros(n, np.uint64)
    for j in range(gram):
        grams = grams * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n]
    grams = mix64(grams)
    # leftmost minimum of each window's grams, by doubling
    span = window - gram + 1
    least, place, size = grams, np.arange(n), 1
    while 2 * size <= span:
        left, right = least[:-size], least[size:]
        take = left <= right
        least, place = np.where(take, left, right), np.where(take, place[:-size], place[size:])
        size *= 2
    if size < span:
        gap = span - size
        take = least[:-gap] <= least[gap:]
        least, place = np.where(take, least[:-gap], least[gap:]), np.where(take, place[:-gap], place[gap:])
    # windows that lie within one text
    starts = [np.arange(a, b - window + 1) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
    text = np.repeat(np.arange(len(first) - 1), [len(s) for s in starts])
    at = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    cut = np.concatenate([[0], np.flatnonzero((text[1:] != text[:-1]) | (place[at[1:]] != place[at[:-1]])) + 1])
    return text[cut], at[cut], np.diff(np.append(cut, len(at))), least[at[cut]]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in text_blocks(batches):
        starts, ends, first = word_spans(data, offsets)
        words = exact_word_hashes(data, starts, ends).astype("<u8")
        text, at, windows, key = _runs(words.astype(np.uint64), first, WINDOW, GRAM)
        raw = words.tobytes()
        digest = pa.array([xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) for a, b in zip(at.tolist(), (at + windows + WINDOW - 1).tolist())], pa.binary())
        rows = pa.array(text)
        yield pa.RecordBatch.from_arrays([_signed(key), digest, batch.column("doc_id").take(rows), batch.column("sum").take(rows), pa.array((at - first[text]).astype(np.int32)), pa.array(windows.astype(np.int32))], ["key", "digest", "doc_id", "sum", "start", "windows"])


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The word hashes of the wanted runs of each text."""
    for batch, data, offsets in text_blocks(batches):
        starts, ends, first = word_spans(data, offsets)
        words = exact_word_hashes(data, starts, ends).astype("<u8")
        wanted = batch.column("wanted")
        wanted = pa.concat_arrays([wanted])
        owner = np.repeat(np.arange(len(wanted)), np.diff(wanted.offsets.to_numpy()))
        runs = wanted.flatten()
        at = first[owner] + runs.field("start").to_numpy()
        sizes = runs.field("windows").to_numpy().astype(np.int64) + WINDOW - 1
        raw = words.tobytes()
        values = [raw[8 * a : 8 * (a + b)] for a, b in zip(at.tolist(), sizes.tolist())]
        rows = pa.array(owner)
        yield pa.RecordBatch.from_arrays([runs.field("key"), runs.field("digest"), batch.column("doc_id").take(rows), runs.field("hot"), pa.array(values, pa.binary())], ["key", "digest", "doc_id", "hot", "words"])


def search_block(sequences: list[np.ndarray], docs: np.ndarray, window: int = WINDOW) -> list[list[tuple[int, int]]]:
    """For each sequence of word hashes, the intervals (first window, number) of its windows that also occur in a sequence of a smaller doc.

    All sequences are indexed, then all are searched, in step with each other.
    """
    sizes = np.array([len(s) for s in sequences])
    base = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    text = np.zeros(int(sizes.sum()) + len(sizes), np.int64)
    inside = np.ones(len(text), bool)
    inside[base + sizes] = False
    text[inside] = np.unique(np.concatenate(sequences), return_inverse=True)[1] + 1
    owner = np.unique(docs, return_inverse=True)[1].astype(np.int32)
    owners = np.repeat(owner, sizes + 1)
    index = FMIndex(text, owners, 2 * window)
    found: list[list[tuple[int, int]]] = [[] for _ in sequences]
    windows = sizes - window + 1
    active = np.flatnonzero((windows > 0) & (owner > 0))
    start = np.zeros(len(active), np.int64)
    at = start + window - 1
    low, high = np.zeros(len(active), np.int64), np.full(len(active), len(text))
    reach = np.arange(window)
    while len(active):
        new_low, new_high = index.extend(text[base[active] + at], low, high)
        good = new_high > new_low
        good[good] = index.least_owner(new_low[good], new_high[good]) < owner[active[good]]
        full = good & (at == start)
        next_start = np.where(good, start, at + 1)
        if full.any():
            own = np.flatnonzero(full)
            places = np.array([index.places[a + int(np.argmin(index.least[0][a:b]))] for a, b in zip(new_low[own].tolist(), new_high[own].tolist())])
            # follow the match to the right of the window
            here, there = (base[active[own]] + start[own] + window)[:, None] + reach, (places + window)[:, None] + reach
            same = (text[np.minimum(here, len(text) - 1)] == text[np.minimum(there, len(text) - 1)]) & (text[np.minimum(here, len(text) - 1)] > 0)
            more = np.minimum(np.logical_and.accumulate(same, axis=1).sum(axis=1), windows[active[own]] - 1 - start[own])
            for q, a, n in zip(active[own].tolist(), start[own].tolist(), (more + 1).tolist()):
                found[q].append((a, n))
            next_start[own] = start[own] + more + 1
        moved = next_start != start
        low, high = np.where(moved, 0, new_low), np.where(moved, len(text), new_high)
        at = np.where(moved, next_start + window - 1, at - 1)
        left = next_start < windows[active]
        active, start, at, low, high = active[left], next_start[left], at[left], low[left], high[left]
    return found


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard: rows in order of key; blocks of whole keys are indexed and searched one after another."""

    def result(rows: list[tuple]) -> pa.RecordBatch:
        found = search_block([np.frombuffer(w, "<u8") for *_, w in rows], np.array([r[2] for r in rows]))
        kept = [(r[0], r[1], f) for r, f in zip(rows, found) if f]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in kept], pa.int64()), pa.array([d for _, d, _ in kept], pa.binary()), pa.array([[{"first": a, "count": n} for a, n in f] for _, _, f in kept], pa.list_(pa.struct([("first", pa.int32()), ("count", pa.int32())])))], ["key", "digest", "intervals"])

    rows: list[tuple] = []
    size = begun = 0  # words, and where the rows of the last key begin
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "digest", "doc_id", "words"))):
            if rows and row[0] != rows[-1][0]:
                begun = len(rows)
            if size >= BLOCK_WORDS and begun:
                yield result(rows[:begun])
                rows, begun = rows[begun:], 0
                size = sum(len(r[3]) // 8 for r in rows)
            rows.append(row)
            size += len(row[3]) // 8
    if rows:
        yield result(rows)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of runs by its own hash."""
    for batch in batches:
        for key, digest, doc, raw in zip(*(batch.column(c).to_pylist() for c in ("key", "digest", "doc_id", "words"))):
            words = np.frombuffer(raw, "<u8").astype(np.uint64)
            at = np.arange(len(words) - WINDOW + 1)
            n = len(at)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, key)), pa.array([digest] * n, pa.binary()), pa.array(np.full(n, doc)), _signed(range_hashes(words, at, at + WINDOW)), pa.array(at.astype(np.int32))], ["key", "digest", "doc_id", "window", "first"])


def repeats(docs: DataFrame) -> DataFrame:
    """Word ranges that a smaller document's passages cover: doc_id, sum (hash of the text), ranges (array of from, to), for documents that have any.

    Rows with a null doc_id neither repeat nor are repeated.
    """
    own = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("sum"), "text")
    runs = materialize(own.mapInArrow(_find_runs, "key long, digest binary, doc_id long, sum long, start int, windows int"), "substring-runs")
    # equal runs are one; the smallest document that has it stands for it
    distinct = materialize(runs.groupBy("key", "digest").agg(F.min(F.struct("doc_id", "sum", "start", "windows")).alias("at"), F.max("doc_id").alias("last"), F.count("*").alias("copies")), "substring-distinct")
    by_key = distinct.groupBy("key").agg(F.count("*").alias("n"), F.min("at.doc_id").alias("low"), F.max("last").alias("high")).filter("low < high")
    shared = materialize(distinct.join(by_key.select("key", "n"), "key"), "substring-shared")
    wanted = shared.filter("n > 1").select(F.col("at.doc_id").alias("doc_id"), F.col("at.sum").alias("sum"), F.struct(F.col("at.start").alias("start"), F.col("at.windows").alias("windows"), "key", "digest", (F.col("n") > MAX_RUNS).alias("hot")).alias("run")).groupBy("doc_id", "sum").agg(F.collect_list("run").alias("wanted"))
    texts = own.join(wanted, ["doc_id", "sum"]).select("doc_id", "text", "wanted")
    fetched = materialize(texts.mapInArrow(_fetch, "key long, digest binary, doc_id long, hot boolean, words binary"), "substring-fetched")
    intervals = "array<struct<first:int,count:int>>"
    searched = fetched.filter("not hot").select("key", "digest", "doc_id", "words").repartition("key").sortWithinPartitions("key", "doc_id", "digest").mapInArrow(_search, f"key long, digest binary, intervals {intervals}")
    single = fetched.filter("hot").mapInArrow(_windows, "key long, digest binary, doc_id long, window long, first int")
    least = single.groupBy("key", "window").agg(F.min("doc_id").alias("least"))
    slow = single.join(least, ["key", "window"]).filter("doc_id > least").groupBy("key", "digest").agg(F.collect_list(F.struct("first", F.lit(1).alias("count"))).alias("intervals"))
    found = materialize(searched.unionByName(slow).groupBy("key", "digest").agg(F.flatten(F.collect_list("intervals")).alias("intervals")), "substring-found")
    verdicts = materialize(shared.select("key", "digest", F.col("at.doc_id").alias("first_doc"), "last", "copies").join(found, ["key", "digest"], "left").filter("first_doc < last or intervals is not null").drop("last"), "substring-verdicts")
    often = max(1_000, int(runs.count() * HOT_SHARE))
    hot = F.broadcast(verdicts.filter(F.col("copies") > often))
    rest = verdicts.filter(F.col("copies") <= often)
    judged = runs.join(hot, ["key", "digest"]).unionByName(runs.join(hot.select("key", "digest"), ["key", "digest"], "left_anti").join(rest, ["key", "digest"]))
    covered = judged.select("doc_id", "sum", "start", F.when(F.col("doc_id") > F.col("first_doc"), F.array(F.struct(F.lit(0).alias("first"), F.col("windows").alias("count")))).otherwise(F.col("intervals")).alias("in")).filter("in is not null")
    ranges = covered.select("doc_id", "sum", F.explode("in").alias("x"), "start").select("doc_id", "sum", F.struct((F.col("start") + F.col("x.first")).alias("from"), (F.col("start") + F.col("x.first") + F.col("x.count") + WINDOW - 1).alias("to")).alias("range"))
    out = materialize(ranges.groupBy("doc_id", "sum").agg(F.collect_list("range").alias("ranges")), "substring-ranges")
    for table in (runs, distinct, shared, fetched, found, verdicts):
        discard(table)
    return out


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Each text's words, and a list of which of them stay (None: all)."""
    for batch, data, offsets in text_blocks(batches):
        raw, ends = data.tobytes(), offsets.tolist()
        out = []
        for k, ranges in enumerate(batch.column("ranges").to_pylist()):
            words = raw[ends[k] : ends[k + 1]].split()
            kept = None
            if ranges:
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, [r["from"] for r in ranges], 1)
                np.add.at(change, [r["to"] for r in ranges], -1)
                kept = (np.cumsum(change[:-1]) == 0).tolist()
            out.append((words, kept))
        yield batch, out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in _keep(batches):
        counts = [(len(w), 0 if kept is None else len(w) - sum(kept), hashlib.sha256(b" ".join(w if kept is None else compress(w, kept))).hexdigest()) for w, kept in texts]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([c[0] for c in counts], pa.int64()), pa.array([c[1] for c in counts], pa.int64()), pa.array([c[2] for c in counts], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in _keep(batches):
        kept = [b" ".join(w if kept is None else compress(w, kept)).decode() for w, kept in texts]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.string())], ["doc_id", "text"])


def _with_ranges(docs: DataFrame) -> DataFrame:
    own = docs.select("doc_id", F.xxhash64("text").alias("sum"), "text")
    return own.join(repeats(docs), ["doc_id", "sum"], "left").select("doc_id", "text", "ranges")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row of docs, what stays of its words: doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space).

    A word goes if a window of 50 consecutive words that covers it also starts in a document with a smaller doc_id;
    all windows are judged on the input. Null texts have no words. Rows that share a doc_id don't remove each other's
    words. Other columns don't take part.
    """
    ids = docs.schema["doc_id"].dataType.simpleString()
    return _with_ranges(docs).mapInArrow(_digests, f"doc_id {ids}, n_words long, n_removed long, kept_sha256 string")


def kept_texts(docs: DataFrame) -> DataFrame:
    """As remove_repeats(), with the text that stays: doc_id, text."""
    ids = docs.schema["doc_id"].dataType.simpleString()
    return _with_ranges(docs).mapInArrow(_texts, f"doc_id {ids}, text string")
