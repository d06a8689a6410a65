"""Improbable-feature digests: byte windows that are rare by their entropy, kept in chained Bloom filters.

Every 64-byte window has an entropy; windows whose entropy is rare in the corpus are the better marks of a document.
Among each 64 consecutive windows the rarest wins (the first of equals), and windows that win often, wherever they stand
in the text, are the features; where none does, those that win most are. So only texts without bytes have no features.
They are inserted in Bloom filters of 2,048 bits with 5 bits a feature; a filter takes 160 features, then the next in
the chain begins. Two digests are compared filter by filter by their common bits, less those that chance explains.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import HOT_ROWS, discard, materialize
from .text import mix64, text_blocks

WINDOW, FRAME = 64, 64
#: Wins, over all its places in a text, that make a window a feature.
POPULAR = 16
BITS, HASHES, FULL = 2048, 5, 160
#: Entropy is told apart in so many steps.
STEPS = 1024

#: c * log2(c) for counts up to a window's length, in whole units, so that sums don't depend on where a window stands.
_UNIT = 1 << 24
_TERM = np.array([0] + [round(c * np.log2(c) * _UNIT) for c in range(1, WINDOW + 1)], np.int64)


def entropy_steps(data: np.ndarray) -> np.ndarray:
    """The entropy of every 64-byte window, in steps of 1/1023 of the most possible. The bytes of a window are never sorted:

    a window differs from the next by one byte that goes and one that comes, and what each changes depends on how often
    it stands in the window, which 63 comparisons of the bytes with themselves, moved by 1 to 63 places, give for all.
    """
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int16)
    earlier, later = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for k in range(1, WINDOW):
        same = (data[k:] == data[:-k]).view(np.uint8)
        earlier[k:] += same
        later[:-k] += same
    gain = _TERM[1:] - _TERM[:-1]
    # by place: what the byte adds when it comes, and what it takes when it goes
    comes, goes = gain[earlier], gain[later]
    first = np.bincount(data[:WINDOW], minlength=256)
    start = _TERM[first].sum()
    # the next window: data[i] goes while 63 others stay, then data[i + 64] comes
    total = start + np.concatenate([[0], np.cumsum(comes[WINDOW:] - goes[: n - WINDOW])])
    entropy = np.log2(WINDOW) - total / (WINDOW * _UNIT)
    return np.clip(np.rint(entropy / np.log2(WINDOW) * (STEPS - 1)), 0, STEPS - 1).astype(np.int16)


def _blocks(texts: list[bytes], most: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Texts put together: number of the first, their bytes, and offsets. One that is not empty but shorter than a window is filled up with 0."""
    first, size, parts = 0, 0, []
    for k, text in enumerate(texts):
        parts.append(text + bytes(WINDOW - len(text)) if 0 < len(text) < WINDOW else text)
        size += len(parts[-1])
        if size >= most or k == len(texts) - 1:
            yield first, np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            first, size, parts = k + 1, 0, []


def _sliding_least(key: np.ndarray, frame: int) -> np.ndarray:
    size = 1
    while 2 * size <= frame:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    return np.minimum(key[: len(key) - (frame - size)], key[frame - size :]) if size < frame else key


def features(texts: list[bytes], rarity: np.ndarray) -> Iterator[np.ndarray]:
    """64-bit hashes of each text's selected windows in order, each once. rarity: rank of each entropy step, 0 the rarest."""
    for _, data, offsets in _blocks(texts):
        steps = entropy_steps(data)
        key = rarity[steps].astype(np.int64) << 40 | np.arange(len(steps))
        counts = np.maximum(np.diff(offsets) - WINDOW + 1, 0)  # windows of each text
        wins, least = np.zeros(len(steps), np.int64), np.full(len(counts), POPULAR)
        if len(steps) >= FRAME:
            best = _sliding_least(key, FRAME)
            # frames that lie within one text
            change = np.zeros(len(best) + 1, np.int64)
            whole = counts >= FRAME
            np.add.at(change, offsets[:-1][whole], 1)
            np.add.at(change, (offsets[:-1] + counts - FRAME + 1)[whole], -1)
            wins += np.bincount(best[np.cumsum(change[:-1]) > 0] & ((1 << 40) - 1), minlength=len(steps))
        for k in np.flatnonzero((counts > 0) & (counts < FRAME)).tolist():  # one frame
            wins[int(key[offsets[k] : offsets[k] + counts[k]].min()) & ((1 << 40) - 1)] += 1
            least[k] = 1
        least = np.where(counts >= FRAME, np.minimum(POPULAR, np.maximum(counts - FRAME + 1, 1)), least)
        at = np.flatnonzero(wins)
        text = np.searchsorted(offsets, at, "right") - 1
        rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, WINDOW)[at]).view("<u8") if len(at) else np.zeros((0, WINDOW // 8), "<u8")
        hashes = np.full(len(at), 0x9E3779B97F4A7C15, np.uint64)
        for k in range(rows.shape[1]):
            hashes = mix64(hashes ^ rows[:, k]) + np.uint64(k)
        # equal windows of a text win together, from their first place on
        order = np.lexsort((hashes, text))
        cut = np.flatnonzero(np.concatenate(([True], (text[order][1:] != text[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])))) if len(at) else at
        total = np.add.reduceat(wins[at][order], cut) if len(at) else wins[at]
        first, owner, value = order[cut], text[order][cut], hashes[order][cut]  # lexsort is stable, so order[cut] is the first place
        most = np.zeros(len(counts), np.int64)
        np.maximum.at(most, owner, total)
        good = total >= np.minimum(least, most)[owner]
        first, owner, value = first[good], owner[good], value[good]
        place = np.lexsort((first, owner))
        ends = np.searchsorted(owner[place], np.arange(len(counts) + 1))
        for k in range(len(counts)):
            yield value[place[ends[k] : ends[k + 1]]]


def filters(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chain: a row of bits for each filter, and the number of features in each."""
    n = -(-len(hashes) // FULL)
    bits = np.zeros((n, BITS), bool)
    row = np.arange(len(hashes)) // FULL
    for k in range(HASHES):
        bits[row, ((hashes >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = True
    return bits, np.bincount(row, minlength=n) if n else np.zeros(0, np.int64)


def to_string(chain: tuple[np.ndarray, np.ndarray]) -> str:
    bits, counts = chain
    return ".".join(f"{c:02x}{base64.b64encode(np.packbits(b).tobytes()).decode()}" for b, c in zip(bits, counts.tolist()))


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """0 to 1: each filter of the chain with fewer features takes its best match in the other, weighted by its features.

    A match is the number of common bits beyond what two unrelated filters of these loads have by chance, over the most
    there could be. Chains without features are alike (1), and unlike (0) any other.
    """
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    if (a[1].sum(), len(a[0])) > (b[1].sum(), len(b[0])):
        a, b = b, a
    x, y = a[0].astype(np.float32), b[0].astype(np.float32)
    common = x @ y.T
    nx, ny = x.sum(axis=1)[:, None], y.sum(axis=1)[None, :]
    chance = nx * ny / BITS
    chance = chance + 0.1 * (np.minimum(nx, ny) - chance)
    score = np.clip((common - chance) / np.maximum(np.minimum(nx, ny) - chance, 1e-9), 0, 1).max(axis=1)
    return float((score * a[1]).sum() / a[1].sum())


def fit_rarity(docs: DataFrame) -> np.ndarray:
    """Ranks of the entropy steps by how often they occur in all texts, the rarest first; steps of no window come last.

    One row per step and task meets in the sum, so what is collected has at most 1,024 rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(STEPS, np.int64)
        for _, data, offsets in text_blocks(batches):
            raw = data.tobytes()
            for _, block, ends in _blocks([raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]):
                steps = entropy_steps(block)
                change = np.zeros(len(block) + 1, np.int64)
                whole = np.diff(ends) >= WINDOW
                np.add.at(change, ends[:-1][whole], 1)
                np.add.at(change, ends[1:][whole] - WINDOW + 1, -1)
                counts += np.bincount(steps[np.cumsum(change[: len(steps)]) > 0], minlength=STEPS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["step", "n"])

    counts = np.zeros(STEPS, np.int64)
    for row in docs.select("text").mapInArrow(count, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).collect():
        counts[row["step"]] = row["n"]
    order = np.lexsort((np.arange(STEPS), counts, counts == 0))
    rarity = np.empty(STEPS, np.int64)
    rarity[order] = np.arange(STEPS)
    return rarity


def chains(texts: list[bytes], rarity: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    return [filters(f) for f in features(texts, rarity)]


def fingerprints(docs: DataFrame, rarity: np.ndarray | None = None) -> DataFrame:
    """The digest of every whole text: doc_id, fingerprint. Null and empty texts have an empty one. Other columns don't take part."""
    ranks = fit_rarity(docs) if rarity is None else rarity

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_blocks(batches):
            found = [to_string(c) for c in chains([data[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], ranks)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    own = docs.select("doc_id", "text")
    return own.mapInArrow(rows, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed bytes, for the exchange; null stays null."""
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        texts = batch.column("text")
        packed = pa.array((None if not t.is_valid else squeeze(t.as_buffer()) for t in texts), pa.binary())
        yield batch.set_column(batch.schema.get_field_index("text"), "text", packed)


def unpack(packed: bytes | None) -> str:
    return zstandard.ZstdDecompressor().decompress(packed).decode() if packed is not None else ""


def _pieces(own: DataFrame, rows: int) -> DataFrame:
    """Rows (doc_id, sum, ...) with `piece`, a struct whose order is that of descending doc_id (null last), then of sum.

    Ids are cut at quantiles. An id that many rows share, or none, is a range of its own, cut by the hash of the text;
    rows of one id and text that are very many are equal, so they are dealt out among pieces in any order.
    """
    spark = own.sparkSession
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    often = max(HOT_ROWS, rows // n)
    quantiles = own.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 10 * n).alias("cuts")).first()["cuts"] or []
    # at most n ids and n texts are so frequent
    groups = materialize(own.groupBy("doc_id", "sum").agg(F.count("*").alias("rows")), "fingerprint-groups")
    hot_ids = {r["doc_id"]: r["rows"] for r in groups.groupBy("doc_id").agg(F.sum("rows").alias("rows")).filter(F.col("rows") > often).collect()}
    hot_rows = groups.filter(F.col("rows") > often).collect()
    discard(groups)
    cuts = sorted({*quantiles, *(i for i in hot_ids if i is not None)}, reverse=True)
    kind = own.schema["doc_id"].dataType
    larger = F.size(F.filter(F.array(*[F.lit(c).cast(kind) for c in cuts]), lambda c: c > F.col("doc_id"))) if cuts else F.lit(0)
    of_hot = F.lit(False)
    parts = F.lit(1)
    for doc, count in hot_ids.items():
        same = F.col("doc_id").eqNullSafe(F.lit(doc).cast(kind))
        of_hot, parts = of_hot | same, F.when(same, F.lit(-(-count // often))).otherwise(parts)
    number = F.when(F.col("doc_id").isNull(), 2 * len(cuts) + 3).otherwise(2 * larger + F.when(of_hot, 2).otherwise(1) if cuts else F.lit(1))
    # the share of all hashes below this one
    below = F.least(F.col("sum").cast("double") / F.lit(2.0**64) + F.lit(0.5), F.lit(1 - 1e-9))
    place, tie = F.lit(0), F.lit(0)
    for r in sorted(hot_rows, key=lambda r: r["sum"]):
        same = F.col("doc_id").eqNullSafe(F.lit(r["doc_id"]).cast(kind))
        place = place + F.when(same & (F.col("sum") > r["sum"]), 2).when(same & (F.col("sum") == r["sum"]), 1).otherwise(0)
        tie = F.when(same & (F.col("sum") == r["sum"]), F.pmod(F.monotonically_increasing_id(), F.lit(-(-r["rows"] // often)))).otherwise(tie)
    piece = F.struct(number.cast("int").alias("range"), F.floor(below * parts).cast("int").alias("part"), place.cast("int").alias("place"), tie.cast("int").alias("tie"))
    return own.withColumn("piece", piece)


def with_next(docs: DataFrame) -> DataFrame:
    """Each row with the text of the next one in descending doc_id, after the last the first: doc_id, text, next_text, both packed (see unpack).

    Equal ids follow by the hash of their text, null ids come last. Ranges of ids are windows of their own, so no task
    sees all rows, nor all of one id (see _pieces); each also gets the first row of the range after it.
    """
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("sum"))
    ids = own.schema["doc_id"].dataType.simpleString()
    packed = materialize(_pieces(own, own.count()).mapInArrow(_pack, f"doc_id {ids}, text binary, sum long, piece struct<range:int,part:int,place:int,tie:int>"), "fingerprint-packed")
    # ~x turns the order of whole numbers around and has a value for each
    first = F.struct(F.bitwise_not("doc_id").alias("order"), F.col("sum"))
    heads = packed.groupBy("piece").agg(F.min(first).alias("head")).orderBy("piece").collect()
    before = {h["piece"]: heads[k - 1]["piece"] for k, h in enumerate(heads)}
    kind = packed.schema["piece"].dataType.simpleString()
    guests = docs.sparkSession.createDataFrame([(h["piece"], before[h["piece"]], h["head"]) for h in heads], f"of {kind}, host {kind}, head struct<order:{ids},sum:long>")
    # as many guests as pieces
    same = (F.col("piece") == F.col("of")) & F.col("head.sum").eqNullSafe(F.col("sum")) & F.col("head.order").eqNullSafe(F.bitwise_not("doc_id"))
    copies = packed.join(F.broadcast(guests), same).groupBy("of").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.first("sum").alias("sum"), F.first("host").alias("piece"))
    both = packed.withColumn("guest", F.lit(0)).unionByName(copies.drop("of").withColumn("guest", F.lit(1)))
    order = Window.partitionBy("piece").orderBy("guest", F.desc_nulls_last("doc_id"), "sum")
    return both.withColumn("next_text", F.lead("text").over(order)).filter("guest = 0").select("doc_id", "text", "next_text")


def edited(text: str, following: str) -> str:
    """The last half of the code points (rounded down) replaced by the first as many of the following text, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of texts and of their edited forms: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited form takes its end from the next document in descending doc_id (see with_next). Null texts are empty.
    """
    rarity = fit_rarity(docs)
    pairs = with_next(docs)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for whole in batches:
            sizes = np.cumsum([len(t or b"") for t in whole.column("text").to_pylist()])
            cuts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(sizes >> 19)) + 1, [whole.num_rows]])).tolist()
            for batch in (whole.slice(a, b - a) for a, b in zip(cuts, cuts[1:])):
                texts = [unpack(t) for t in batch.column("text").to_pylist()]
                after = [unpack(t) for t in batch.column("next_text").to_pylist()]
                new = [edited(t, f).encode() for t, f in zip(texts, after)]
                own, other = chains([t.encode() for t in texts], rarity), chains(new, rarity)
                # the next row's text is mostly this row's next text
                rest = [k for k, f in enumerate(after) if k + 1 == len(texts) or texts[k + 1] != f]
                follow = own[1:] + own[:1]
                for k, chain in zip(rest, chains([after[k].encode() for k in rest], rarity)):
                    follow[k] = chain
                out = [(doc, len(t), hashlib.sha256(raw).hexdigest(), to_string(a), to_string(b), likeness(a, b), likeness(a, c)) for doc, t, raw, a, b, c in zip(batch.column("doc_id").to_pylist(), texts, new, own, other, follow)]
                columns = list(zip(*out)) if out else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k or batch.schema.field("doc_id").type) for c, k in zip(columns, kinds)], names)

    return pairs.mapInArrow(rows, f"doc_id {pairs.schema['doc_id'].dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
