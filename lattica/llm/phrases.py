"""Collocations: phrases whose words stand together more often than apart, counted exactly after a count-min sketch has dropped rare ones."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize
from .text import mix64, range_hashes

#: Where pieces end, and what stands between the words of a piece.
SEPARATORS, BLANKS = (*b".,;:!?", *range(0x0A, 0x0E)), (0x20, 0x09)
#: Words in a phrase, least count, share of a phrase's count (in percent) that a longer one needs to take its place, phrases kept per language.
LONGEST, LEAST, SHARE, TOP = 3, 10, 50, 2_000
#: Rows of the sketch; bytes of text per counter of a row, and the most counters of a row (2^k). The tasks of the second pass get one bit per counter: ROWS * 2^MOST_BITS / 8 bytes (128 MB) at most.
ROWS, BYTES_PER_COUNTER, LEAST_BITS, MOST_BITS = 2, 8, 16, 29
#: A row of the sketch travels in so many slices, 2^k, whatever its width: 2 MB of counters each at most.
SLICES = 8
#: Occurrences that a task gathers before it sends what they add to the sketch.
OCCURRENCES = 1 << 23
#: Counted phrases travel packed: a task gathers about so many rows before it sums and packs them, in one part for every so many bytes of text.
GATHERED, BYTES_PER_PART, MOST_PARTS = 1 << 19, 16 << 20, 4_096
#: Bytes of text that a task works on at once.
BLOCK = 3 << 20
#: Parts of a language's phrases that are ranked apart before the best of all parts are.
RANK_PARTS = 64

_SEPARATOR, _BLANK = np.zeros(256, bool), np.zeros(256, bool)
_SEPARATOR[list(SEPARATORS)] = True
_BLANK[list(BLANKS)] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _cuts(text: bytes, most: int, longest: int) -> Iterator[tuple[bytes, int]]:
    """A long text in pieces of about `most` bytes, each with how many of its first words an earlier piece has counted.

    Cut after a separator where there is one in the second half; else between words, and then the next piece begins with
    the last longest - 1 words before the cut, so that no phrase is lost or counted twice. A word is never cut.
    """
    at = seen = 0
    reach = most
    while len(text) - at > reach:
        window = np.frombuffer(text, np.uint8, reach, at)
        after = np.flatnonzero(_SEPARATOR[window])
        last = int(after[-1]) + 1 if len(after) else 0
        if last > reach // 2:
            yield text[at : at + last], seen
            at, seen, reach = at + last, 0, most
            continue
        blank = np.flatnonzero(_BLANK[window])
        cut = int(blank[-1]) if len(blank) else 0
        inside = ~(_BLANK[window[:cut]] | _SEPARATOR[window[:cut]])
        starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
        # words of the piece that is open at the cut
        last = int(after[after < cut][-1]) + 1 if len(after) and after[0] < cut else 0
        again = starts[starts >= last][-(longest - 1) :] if longest > 1 else starts[:0]
        ahead = int(again[0]) if len(again) else cut
        if not ahead:  # words so long that the next piece would be this one
            reach *= 2
            continue
        yield text[at : at + cut], seen
        at, seen, reach = at + ahead, len(again), most
    yield text[at:], seen


def _blocks(batches: Iterator[pa.RecordBatch], longest: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[str], np.ndarray]]:
    """Texts of about `most` bytes in all: their bytes with A-Z in lower case, their ends, their languages, and how many first words of each are known."""
    held: list[tuple[bytes, str, int]] = []
    size = 0

    def block():
        data = np.frombuffer(b"".join(t for t, _, _ in held), np.uint8).copy()
        data[(data >= 65) & (data <= 90)] += 32
        return data, np.cumsum([len(t) for t, _, _ in held]), [lang for _, lang, _ in held], np.array([s for _, _, s in held])

    for batch in batches:
        for text, lang in zip(batch.column("text").cast(pa.large_binary()), batch.column("lang")):
            for piece, seen in _cuts(text.as_py() or b"", most, longest):
                held.append((piece, lang.as_py(), seen))
                size += len(piece)
                if size >= most:
                    yield block()
                    held, size = [], 0
    if held:
        yield block()


@dataclass
class Words:
    """The words of a block: their ids among its distinct words, their language, the piece they stand in, and whether an earlier piece has counted them."""

    ids: np.ndarray
    distinct: pa.Array
    lang: np.ndarray
    langs: list[str]
    piece: np.ndarray
    known: np.ndarray

    @staticmethod
    def of(data: np.ndarray, ends: np.ndarray, langs: list[str], seen: np.ndarray) -> Words:
        separator = _SEPARATOR[data]
        inside = ~(separator | _BLANK[data])
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        firsts = ends[:-1][ends[:-1] < len(data)]
        begins[firsts] = inside[firsts]
        starts = np.flatnonzero(begins)
        text = np.searchsorted(ends, starts, "right")
        # both grow with the place, so the sum is the same only where both are
        piece = np.cumsum(separator)[starts] + text
        stops = np.concatenate((np.cumsum(inside)[starts] - 1, [int(inside.sum())]))
        found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(stops.astype(np.int64)), pa.py_buffer(data[inside])).dictionary_encode()
        own = {lang: k for k, lang in enumerate(dict.fromkeys(langs))}
        order = np.arange(len(starts)) - np.searchsorted(starts, np.concatenate(([0], ends[:-1])))[text] if len(starts) else starts
        return Words(found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary, np.array([own[x] for x in langs])[text], list(own), piece, order < seen[text])

    def places(self, size: int) -> np.ndarray:
        """First words of the phrases of so many words, each phrase in one piece and counted here alone."""
        n = len(self.ids) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        return np.flatnonzero((self.piece[:n] == self.piece[size - 1 :]) & ~self.known[size - 1 :])

    def hashes(self, longest: int) -> list[np.ndarray]:
        """For each number of words, a hash of every run of so many words and its language. Equal phrases have one hash in all blocks."""
        each = self.distinct.cast(pa.large_binary())
        offsets = np.frombuffer(each.buffers()[1], np.int64)[each.offset : each.offset + len(each) + 1]
        raw = np.frombuffer(each.buffers()[2], np.uint8) if len(each) else np.zeros(0, np.uint8)
        words = range_hashes(raw.astype(np.uint64) + np.uint64(1), offsets[:-1], offsets[1:])
        own = [np.frombuffer(lang.encode() + b"/", np.uint8).astype(np.uint64) + np.uint64(1) for lang in self.langs]
        langs = np.array([range_hashes(x, np.array([0]), np.array([len(x)]))[0] for x in own], np.uint64)
        one = mix64(words[self.ids] * _STEP + langs[self.lang])
        runs = [one]
        for size in range(2, longest + 1):
            n = max(0, len(one) - size + 1)
            runs.append(mix64(runs[-1][:n] * _STEP + one[size - 1 :][:n]))
        return runs

    def counted(self, places: list[np.ndarray]) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
        """For each number of words, the distinct phrases at the given places: size, phrases, numbers of their languages, counts, a place of each. Keys are exact: no two phrases share one."""
        n, v = len(self.langs), max(1, len(self.distinct))
        for size, at in enumerate(places, 1):
            key = self.ids[at] * n + self.lang[at]
            for k in range(1, size):  # numbered anew from 0, so that the product stays in 64 bits
                key = np.unique(key, return_inverse=True)[1] * v + self.ids[at + k]
            _, one, count = np.unique(key, return_index=True, return_counts=True)
            words = [self.distinct.take(pa.array(self.ids[at[one] + k])) for k in range(size)]
            yield size, words[0] if size == 1 else pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string())), self.lang[at[one]], count, at[one]


def _counters(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mix64(h + np.uint64(row) * _STEP) >> np.uint64(64 - bits)


def _pack(places: np.ndarray, counts: np.ndarray) -> bytes:
    """Places in a slice, in order, as the gaps between them, and their counts: low bytes, higher bytes (mostly 0) and counts (mostly 1) apart, as they compress best."""
    gaps = np.diff(places.astype(np.int64), prepend=0).astype("<u4")
    raw = gaps.view(np.uint8).reshape(-1, 4)[:, :3].T.tobytes() + counts.astype(np.uint8).tobytes()
    return len(raw).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = pa.decompress(packed[4:], int.from_bytes(packed[:4], "little"), codec="zstd", asbytes=True)
    raw = np.frombuffer(raw, np.uint8).reshape(4, -1)
    return np.cumsum(raw[0].astype(np.int64) + (raw[1].astype(np.int64) << 8) + (raw[2].astype(np.int64) << 16)), raw[3]


def sketch(texts: DataFrame, bits: int, longest: int = LONGEST, least: int = LEAST, block: int = BLOCK) -> np.ndarray:
    """Which counters of the merged count-min sketch reach `least`: one packed bit per counter, ROWS x 2^bits.

    Blocks of text make sketches of their own, kept sparse: only the counters that they touch, in slices. Slices are
    merged by sums in the tasks that they are dealt to; no task holds a whole row. Counts stop at `least` (at 100 if that is
    more) in each part and in the sum, which leaves open nothing but how far beyond it they are, so a counter fits in a byte.
    """
    least = min(least, 100)
    inner = bits - SLICES

    def sent(row: int, held: list[np.ndarray]) -> pa.RecordBatch:
        at, count = np.unique(np.concatenate(held), return_counts=True)
        part = (at >> np.uint32(inner)).astype(np.int64)
        edges = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(at) else np.zeros(1, np.int64)
        count = np.minimum(count, least)
        packed = [_pack(at[a:b] & np.uint32((1 << inner) - 1), count[a:b]) for a, b in zip(edges[:-1], edges[1:])]
        return pa.RecordBatch.from_arrays([pa.array((row << SLICES) + part[edges[:-1]] if len(at) else [], pa.int32()), pa.array(packed, pa.binary())], ["slice", "counters"])

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(ROWS)]
        for own in _blocks(batches, longest, block):
            words = Words.of(*own)
            runs = words.hashes(longest)
            h = np.concatenate([runs[size - 1][words.places(size)] for size in range(1, longest + 1)])
            for row in range(ROWS):
                held[row].append(_counters(h, row, bits).astype(np.uint32))
            if sum(map(len, held[0])) >= OCCURRENCES:
                yield from (sent(row, held[row]) for row in range(ROWS))
                held = [[] for _ in range(ROWS)]
        if held[0]:
            yield from (sent(row, held[row]) for row in range(ROWS))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, packed in zip(batch.column("slice").to_pylist(), batch.column("counters")):
                at, count = _unpack(packed.as_py())
                total = sums.setdefault(part, np.zeros(1 << inner, np.uint8))
                total[at] = np.minimum(total[at] + count, least)
        for part, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], ["slice", "counters"])

    slices = ROWS << SLICES
    # about 4 MB of counters in a task
    dealt = texts.mapInArrow(touched, "slice int, counters binary").repartition(max(8, ROWS << bits >> 22), "slice")
    out = np.zeros((slices, 1 << inner - 3), np.uint8)
    for r in dealt.mapInArrow(merged, "slice int, counters binary").collect():
        out[r["slice"]] = np.frombuffer(r["counters"], np.uint8)
    return out.reshape(ROWS, -1)


def text_bytes(texts: DataFrame) -> int:
    return texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def width(size: int) -> int:
    """Bits that number the counters of a row for so many bytes of text: so many that, on average, a few phrases share one."""
    return min(MOST_BITS, max(LEAST_BITS, int(size // BYTES_PER_COUNTER).bit_length()))


def _planes(x: np.ndarray) -> bytes:
    """Unsigned numbers as their lowest bytes, then the next ones, and so on."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(8, -1).T.copy().view("<u8").ravel().astype(np.int64)


def _packed(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
    """Counted phrases summed, sorted and compressed, one row per part: their words by place in the part's own list of words."""
    summed = pa.concat_tables(held).group_by(["part", "lang", "size", "phrase"], use_threads=False).aggregate([("f", "sum")])
    summed = summed.sort_by([("part", "ascending"), ("lang", "ascending"), ("size", "ascending"), ("phrase", "ascending")]).combine_chunks()
    part = summed["part"].to_numpy()
    edges = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
    for a, b in zip(edges[:-1], edges[1:]):
        own = summed.slice(a, b - a)
        size = own["size"].to_numpy()
        found = pc.list_flatten(pc.split_pattern(own["phrase"].filter(pa.array(size > 0)), " ")).combine_chunks().dictionary_encode()
        order = pc.sort_indices(found.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        langs = own["lang"].combine_chunks().dictionary_encode()
        columns = {
            "langs": json.dumps(langs.dictionary.to_pylist()).encode(), "lang": _planes(langs.indices.to_numpy()), "size": _planes(size), "f": _planes(own["f_sum"].to_numpy()),
            "words": " ".join(found.dictionary.take(pa.array(order)).to_pylist()).encode(), "word": _planes(place[found.indices.to_numpy()] if len(found) else np.zeros(0, np.int64)),
        }
        yield pa.RecordBatch.from_arrays([pa.array([int(part[a])], pa.int32()), *(pa.array([len(c)], pa.int64()) for c in columns.values()), *(pa.array([pa.compress(c, codec="zstd", asbytes=True)], pa.binary()) for c in columns.values())], ["part", *(f"n_{c}" for c in columns), *columns])


_PACKED = ("langs", "lang", "size", "f", "words", "word")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            raw = {c: pa.decompress(batch.column(c)[k].as_py(), decompressed_size=batch.column(f"n_{c}")[k].as_py(), codec="zstd", asbytes=True) for c in _PACKED}
            size = _from_planes(raw["size"])
            words = pa.array(raw["words"].decode().split(" "), pa.string()).take(pa.array(_from_planes(raw["word"])))
            phrase = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), words), " ")
            lang = pa.array(json.loads(raw["langs"]), pa.string()).take(pa.array(_from_planes(raw["lang"])))
            yield pa.RecordBatch.from_arrays([lang, pa.array(size.astype(np.int32)), phrase, pa.array(_from_planes(raw["f"]))], ["lang", "size", "phrase", "f"])


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, block: int = BLOCK, bits: int | None = None) -> DataFrame:
    """All phrases of 1 to `longest` words that occur `least` times or more: lang, size, phrase, f; and a row of size 0 with all word occurrences of each language.

    A first pass makes the sketch, whose counters are never below a count. The second counts exactly, by the words
    themselves, those phrases whose counters, and those of their parts, all reach `least`: a task sums its own and packs them, sorted
    and compressed, for the exchange; opened again, they meet by language and phrase. Where texts are so many that the sketch fills up (beyond about 8 * 2^MOST_BITS bytes) it lets more rare phrases
    through, which costs time and no result.
    """
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    total = text_bytes(texts)
    bits = width(total) if bits is None else bits
    parts = min(MOST_PARTS, max(8, total // BYTES_PER_PART))
    reached = texts.sparkSession.sparkContext.broadcast(sketch(texts, bits, longest, least, block))

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enough, held, rows = reached.value, [], 0
        for own in _blocks(batches, longest, block):
            words = Words.of(*own)
            runs, places, whole = words.hashes(longest), [], np.ones(len(words.ids) + 1, bool)
            for size in range(1, longest + 1):
                at = words.places(size)
                if size > 1:  # a phrase occurs no more often than its parts
                    at = at[whole[at] & whole[at + 1]]
                for row in range(ROWS):
                    c = _counters(runs[size - 1][at], row, bits)
                    at = at[(enough[row][(c >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (c & np.uint64(7))).astype(np.uint8)) & 1 == 1]
                places.append(at)
                whole = words.known.copy() if size == 1 else words.known[: 1 - size].copy()
                whole[at] = True
            totals = np.bincount(words.lang[~words.known], minlength=len(words.langs))
            held.append(_counts(words.langs, 0, pa.array([""] * len(totals), pa.string()), np.arange(len(totals)), totals, np.zeros(len(totals), np.int32)))
            for size, phrase, lang, count, first in words.counted(places):
                held.append(_counts(words.langs, size, phrase, lang, count, (runs[size - 1][first] % np.uint64(parts)).astype(np.int32)))
            rows += sum(len(p) for p in places)
            if rows >= GATHERED:
                yield from _packed(held)
                held, rows = [], 0
        if held:
            yield from _packed(held)

    kinds = ", ".join(["part int", *(f"n_{c} long" for c in _PACKED), *(f"{c} binary" for c in _PACKED)])
    packed = texts.mapInArrow(survivors, kinds).repartition(parts, "part")
    each = packed.mapInArrow(_opened, "lang string, size int, phrase string, f long")
    return each.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).filter((F.col("size") == 0) | (F.col("f") >= least))


def _counts(langs: list[str], size: int, phrase: pa.Array, lang: np.ndarray, count: np.ndarray, part: np.ndarray) -> pa.Table:
    return pa.table({"part": part, "lang": pa.array(langs, pa.string()).take(pa.array(lang)), "size": np.full(len(count), size, np.int32), "phrase": phrase.cast(pa.string()), "f": count.astype(np.int64)})


def _words(phrase: str, first: int | Column, n: int | Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, n), " ")


def scored(counts: DataFrame) -> DataFrame:
    """Candidates, i.e. all phrases of 2 words or more in phrase_counts(): lang, phrase, a, l, r, score, k (the cut with the lowest score, the first of equals), longer.

    score is floor(10^6 a^2 / (l r)) in whole numbers of 38 digits, exact for counts up to 10^16. longer is the largest count of a
    longer candidate that holds the phrase, NULL if there is none; it comes in the same grouping as the scores.
    """
    candidates = counts.filter("size > 1")
    size = F.size(F.split("phrase", " "))
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    # a part occurs at least as often as the whole, so it is in the table
    for name, part in (("l", _words("phrase", 1, F.col("k"))), ("r", _words("phrase", F.col("k") + 1, size))):
        of = counts.filter("size > 0").select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("f").alias(name))
        cuts = cuts.join(of, (F.col("lang") == F.col("_lang")) & (part == F.col("_part"))).drop("_lang", "_part")
    wide = {c: F.col(c).cast("decimal(19,0)") for c in "alr"}
    score = F.call_function("div", wide["a"] * wide["a"] * F.lit(1_000_000).cast("decimal(7,0)"), wide["l"] * wide["r"])
    own = cuts.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("x"), F.lit(None).cast("long").alias("longer"))
    inner = candidates.filter("size > 2").withColumn("n", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    inner = inner.withColumn("first", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("n") + 1)))
    inside = inner.select("lang", _words("phrase", F.col("first"), F.col("n")).alias("phrase"), F.lit(None).cast("long").alias("a"), F.lit(None).cast(own.schema["x"].dataType).alias("x"), F.col("f").alias("longer"))
    best = own.unionByName(inside).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min("x").alias("x"), F.max("longer").alias("longer"))
    return best.select("lang", "phrase", "a", "x.l", "x.r", "x.score", "x.k", "longer")


def unsubsumed(candidates: DataFrame, share: int = SHARE) -> DataFrame:
    """Candidates that don't stand, by `share` percent of their occurrences or more, inside one longer candidate."""
    return candidates.filter(F.coalesce(F.lit(100) * F.col("longer") < F.lit(share) * F.col("a"), F.lit(True))).drop("longer")


def _best_of_tasks(candidates: DataFrame, top: int) -> DataFrame:
    """The first `top` rows of each language in each task, so that no others are exchanged."""
    schema = candidates.schema

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            own = pa.Table.from_batches([batch])
            own = own if held is None else pa.concat_tables([held, own])
            own = own.sort_by([("lang", "ascending"), ("score", "descending"), ("a", "descending"), ("phrase", "ascending")])
            lang = own["lang"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.concatenate(([True], lang[1:] != lang[:-1]))) if len(lang) else lang
            held = own.filter(pa.array(np.arange(len(lang)) - np.repeat(first, np.diff(np.append(first, len(lang)))) < top))
        if held is not None:
            yield from held.to_batches()

    return candidates.mapInArrow(best, schema)


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, share: int = SHARE, top: int = TOP, **how) -> DataFrame:
    """The `top` phrases of each language by score, count and phrase: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut at separators and split at blanks; a phrase stands in one piece. Null texts are empty,
    a null lang is `und` and one with rows of that name. Rows count as often as they occur; ids and other columns don't
    take part. Empty tables, and texts without a phrase of `least` occurrences, give no rows.
    """
    counts = materialize(phrase_counts(docs, longest, least, **how), "phrase-counts")
    kept = _best_of_tasks(unsubsumed(scored(counts), share), top)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # the best of each part hold the best of all
    parts = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    parts = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    totals = counts.filter("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
