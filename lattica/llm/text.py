"""Words and blocks of texts, shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def n_words(text: str) -> Column:
    """Number of words of a column; null has none. Counts the pieces between blanks, but not those before the first and after the last."""
    whole = F.col(text)
    pieces = F.size(F.split(whole, r"[\x20\x09-\x0D]+", -1))
    edges = whole.rlike(r"\A[\x20\x09-\x0D]").cast("int") + whole.rlike(r"[\x20\x09-\x0D]\z").cast("int")
    return F.when(whole.rlike(WORD), pieces - edges).otherwise(0).cast("long")


def text_blocks(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches so that a block holds about `most` bytes of text (one text may be longer).

    Yields the rows, their texts as one array of UTF-8 bytes, and the offsets of the texts in it. Null texts are empty.
    """
    for batch in batches:
        at = batch.schema.get_field_index(column)
        texts = batch.column(at).cast(pa.large_string()).fill_null("")
        # fill_null and cast may keep an offset; a copy through concat starts at 0
        texts = pa.concat_arrays([texts])
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        start = 0
        while start < len(texts):
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
            yield batch.slice(start, end - start), data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
            start = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of a block, and for each text the index of its first word (one more entry at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_BLANK[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    begins[firsts] = inside[firsts]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    lasts = offsets[1:] - 1
    lasts = lasts[lasts >= 0]
    ends[lasts] = inside[lasts]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    return range_hashes(data.astype(np.uint64) + np.uint64(1), starts, ends)


def exact_word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XXH64 of each word's bytes, worked out once for each distinct word of the block. Unlike word_hashes(), no pattern of letters makes words collide."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] = 1
    inside[ends] -= 1
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[np.cumsum(inside[:-1]).astype(bool)])]).dictionary_encode()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w.as_buffer()) for w in found.dictionary), np.uint64, len(found.dictionary))
    return hashes[found.indices.to_numpy(zero_copy_only=False)] if len(starts) else np.zeros(0, np.uint64)


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of 64-bit values, from prefix sums of a polynomial."""
    n = len(values)
    powers, inverse = np.full(n + 1, _ODD), np.full(n + 1, _ODD_INVERSE)
    powers[0] = inverse[0] = 1
    np.multiply.accumulate(powers, out=powers)
    np.multiply.accumulate(inverse, out=inverse)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers[:-1], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
