"""SimHash near-duplicates by multi-index hashing.

Fingerprints are cut in segments. The index holds each fingerprint under each of its segments; a probe enumerates the
Hamming ball around each of its own segments and fetches what the index holds there; whole fingerprints are compared
next. near_duplicates() takes 64 bits and misses nothing within its distance. near_texts() links texts by the similarity
of their shingle sets: its fingerprints have as many segments as a stated recall takes, and whole sets are compared last.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components, joined
from .storage import discard, join_counted, materialize
from .text import mix64, text_blocks, word_spans

SEED = 42
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_PLACE = 256 * np.arange(8)
_BITS_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)

#: near_texts(): pairs of sets with this Jaccard similarity or more are linked, as 4 / 5 in whole numbers.
SIMILAR = (4, 5)
#: Share of the pairs of just that similarity which the index has to find; pairs that are more alike are found more often.
RECALL = 0.9
#: Bits of a segment beyond the logarithm of the number of texts, and at least.
SPARE_BITS, LEAST_BITS = 3, 12
#: Fingerprints too far apart are not compared by their sets: of HEAD bits, and of all, so many may differ that a pair of just that similarity is lost with this probability at most (see far()).
LOST, HEAD = 1e-4, 128
#: Bytes of text whose shingle sets near_texts() makes at once.
SET_BLOCK = 1 << 20
#: How many of the nearest texts that stand for a bucket a text is compared with in the first round.
NEAREST = 3
#: Bits of a set's parities (see _shingle_sets()).
PARITY = 512


def shingle_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: int) -> np.ndarray:
    """XXH64 of each shingle of consecutive words of one text, joined by blanks; a text of fewer words is one shingle."""
    raw = data.tobytes().translate(_LOWER)
    lengths = ends - starts
    if np.any(starts[1:] - ends[:-1] != 1) or np.any(data[ends[:-1]] != 0x20):
        raw = b" ".join([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())])
        starts = np.concatenate([[0], np.cumsum(lengths[:-1] + 1)])
        ends = starts + lengths
    last = max(0, len(starts) - words) + 1
    digest, seed = xxhash.xxh64_intdigest, SEED
    stops = ends[min(words, len(ends)) - 1 :]
    return np.array([digest(raw[a:b], seed) for a, b in zip(starts[:last].tolist(), stops.tolist())], np.uint64)


def _text_shingles(batches: Iterator[pa.RecordBatch], words: int, most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Batches with the shingle hashes of each text; texts without words have none."""
    none = np.zeros(0, np.uint64)
    for batch, data, offsets in text_blocks(batches, most=most):
        starts, ends, first = word_spans(data, offsets)
        found = []
        for k in range(batch.num_rows):
            a, b, own = first[k], first[k + 1], offsets[k]
            found.append(shingle_hashes(data[own : offsets[k + 1]], starts[a:b] - own, ends[a:b] - own, words) if b > a else none)
        yield batch, found


def majority(hashes: np.ndarray) -> np.ndarray:
    """For each of 64 bits, the highest first, whether over half of the hashes have it. Bytes are counted by their value and place, bits follow from that."""
    counts = np.zeros(8 * 256, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.bincount((hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8) + _PLACE).ravel(), minlength=8 * 256)
    return 2 * (counts.reshape(8, 256)[:, :, None] * _BITS_OF).sum(axis=1).ravel() > len(hashes)


def _signed(bits: np.ndarray) -> int:
    return int(np.packbits(bits).view(">i8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """SimHash of every whole text: doc_id, fingerprint (long). Null texts and texts without words have 0.

    Rows stay as they are, also those that repeat; other columns don't take part.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _text_shingles(batches, words):
            prints = np.array([_signed(majority(h)) for h in found], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints)], ["doc_id", "fingerprint"])

    own = docs.select("doc_id", "text")
    return own.mapInArrow(rows, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, fingerprint long")


def ball(width: int, radius: int) -> list[int]:
    """All values of `width` bits with at most `radius` bits set."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def index(nodes: DataFrame) -> DataFrame:
    """The tables of all segments as one: (key, node, head) for nodes of (node, head, segments); a key is a segment's number and value."""
    each = nodes.select("node", "head", F.posexplode("segments").alias("k", "value"))
    return each.select(F.shiftleft(F.col("k").cast("long"), 48).bitwiseOR(F.col("value")).alias("key"), "node", "head")


def lookups(indexed: DataFrame, width: int, radius: int, near: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(key, node, head): for each node the keys in the balls around its segments under which the index holds another node.

    With near (of two heads), keys that hold two nodes at most, of which no other one is near, are left out at once; they lead to no link.
    """
    masks = F.array(*[F.lit(m).cast("long") for m in ball(width, radius)])
    if near is not None:
        probes = indexed.select("node", "head", F.explode(F.transform(masks, lambda m: F.col("key").bitwiseXOR(m))).alias("key"))
        ends = indexed.groupBy("key").agg(F.min(F.struct("node", "head")).alias("least"), F.max(F.struct("node", "head")).alias("most"), F.count("*").alias("n"))
        met = [(F.col(f"{end}.node") != F.col("node")) & near(F.col("head"), F.col(f"{end}.head")) for end in ("least", "most")]
        return probes.join(ends, "key").filter((F.col("n") > 2) | met[0] | met[1]).select("key", "node", "head")
    # most probes find nothing, so heads join only those that do
    probes = indexed.select("node", F.explode(F.transform(masks, lambda m: F.col("key").bitwiseXOR(m))).alias("key"))
    held = indexed.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most"))
    found = probes.join(held, "key").filter((F.col("least") != F.col("node")) | (F.col("most") != F.col("node"))).select("key", "node")
    heads = indexed.groupBy("node").agg(F.first("head").alias("head"))
    return found.join(heads, "node").select("key", "node", "head")


def linked(indexed: DataFrame, found: DataFrame, apart: Callable[[Column, Column], Column], most: int, verify: Callable[[DataFrame, bool], DataFrame] | None = None, name: str = "simhash") -> DataFrame:
    """Components (node, component) over all pairs that the index finds, whose heads are at most `most` apart and that verify() keeps.

    A group of very many near nodes never meets in pairs. First each node meets the one node that stands for each of its
    buckets; that joins most of a group at a cost in proportion to its size. Then the pairs that are still in different
    components meet, so no link between components is missed; those within one need no more links.
    """
    keep = verify or (lambda pairs, first: pairs)
    met = _with_stand(indexed, found, apart, most)
    links = keep(met, True).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    parts = materialize(components(links, f"{name}-parts"), f"{name}-parts")

    def with_part(table: DataFrame) -> DataFrame:
        return table.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")

    shelved = with_part(indexed)
    # a pair counts from its smaller node, so only lookups of buckets that hold a larger one go on
    mixed = shelved.groupBy("key").agg(F.min("part").alias("least"), F.max("part").alias("most"), F.max("node").alias("last"))
    still = with_part(found).join(mixed, "key").filter((F.col("node") < F.col("last")) & ((F.col("least") != F.col("part")) | (F.col("most") != F.col("part")))).drop("least", "most", "last")
    other = shelved.select("key", F.col("node").alias("other"), F.col("head").alias("other_head"), F.col("part").alias("other_part"))
    met = still.join(other, "key").filter((F.col("node") < F.col("other")) & (F.col("part") != F.col("other_part")) & (apart(F.col("head"), F.col("other_head")) <= most))
    met = met.select("node", "other", apart(F.col("head"), F.col("other_head")).alias("apart")).distinct()
    return joined(parts, keep(met, False).select(F.col("node").alias("a"), F.col("other").alias("b")), f"{name}-parts")


def _with_stand(indexed: DataFrame, found: DataFrame, apart: Callable[[Column, Column], Column], most: int) -> DataFrame:
    """(node, other, apart): nodes with the one node that stands for each of the buckets that their lookups found, if that is near."""
    one = indexed.groupBy("key").agg(F.min(F.struct(F.xxhash64("node").alias("by"), "node", "head")).alias("one"))
    met = found.join(one, "key").filter((F.col("node") != F.col("one.node")) & (apart(F.col("head"), F.col("one.head")) <= most))
    return met.select("node", F.col("one.node").alias("other"), apart(F.col("head"), F.col("one.head")).alias("apart")).distinct()


def with_partner(indexed: DataFrame, found: DataFrame, apart: Callable[[Column, Column], Column], most: int, verify: Callable[[DataFrame, bool], DataFrame], name: str = "simhash") -> DataFrame:
    """(node): the nodes in some pair that the index finds, whose heads are at most `most` apart and that verify() keeps.

    No components are needed for that. Nodes first meet those that stand for their buckets; only a node that has no pair
    by then meets all others, so a large group of near nodes never meets in pairs. A pair is found from both of its
    nodes, so none of a pair is missed.
    """

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("node", "other")).alias("node")).distinct()

    # one side of a pair is enough here; whom that leaves out meets all others next
    some = materialize(ends(verify(_with_stand(indexed, found, apart, most).filter("node < other"), True)), f"{name}-some")
    other = indexed.select("key", F.col("node").alias("other"), F.col("head").alias("other_head"))
    far_off = apart(F.col("head"), F.col("other_head"))
    met = found.join(some, "node", "left_anti").join(other, "key").filter((F.col("node") != F.col("other")) & (far_off <= most))
    more = ends(verify(met.select("node", "other", far_off.alias("apart")).distinct(), False))
    return some.unionByName(more).distinct()


def _differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _differing_heads(a: Column, b: Column) -> Column:
    return _differing(a["low"], b["low"]) + _differing(a["high"], b["high"])


def segments_for(nodes: int, most: int) -> int:
    """Number of segments of 64-bit fingerprints with the least lookups and candidates per node, in a table of so many nodes. Balls have a radius of 1 at least."""

    def cost(s: int) -> float:
        lookups = s * sum(math.comb(64 // s, r) for r in range(most // s + 1))
        return lookups * (1 + nodes / 2 ** (64 // s))

    return min(range(1, max(1, most) + 1), key=cost)


def near_prints(prints: DataFrame, most: int = 4, segments: int | None = None) -> DataFrame:
    """Components (node, component) of distinct fingerprints `f` over links of at most `most` differing bits.

    Two such values differ in at most most // segments bits in one of the segments, so balls of that radius find them all.
    """
    nodes = prints.select(F.col("f").alias("node"))
    segments = segments or segments_for(nodes.count(), most)
    cuts = [64 * k // segments for k in range(segments + 1)]
    parts = [F.shiftrightunsigned(F.shiftleft("node", 64 - cuts[k + 1]), 64 - cuts[k + 1] + cuts[k]) for k in range(segments)]
    indexed = materialize(index(nodes.select("node", F.col("node").alias("head"), F.array(*parts).alias("segments"))), "simhash-index")
    found = materialize(lookups(indexed, max(b - a for a, b in zip(cuts, cuts[1:])), most // segments, lambda a, b: _differing(a, b) <= most), "simhash-found")
    out = materialize(linked(indexed, found, _differing, most), "simhash-components")
    discard(indexed)
    discard(found)
    return out


def near_duplicates(docs: DataFrame, words: int = 4, most: int = 4, segments: int | None = None) -> DataFrame:
    """Fingerprint and component of every document: doc_id, fingerprint, component_id, the smallest doc_id reachable over links of at most `most` bits.

    Documents of one fingerprint are one node, so copies are never paired. Rows with a null doc_id link as others do;
    a component of only such rows has a null id.
    """
    prints = materialize(fingerprints(docs, words), "simhash")
    nodes = materialize(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "simhash-nodes")
    parts = near_prints(nodes.select(F.col("fingerprint").alias("f")), most, segments)
    rooted = nodes.join(parts, nodes["fingerprint"] == parts["node"], "left").select("fingerprint", "least", "copies", F.coalesce("component", "fingerprint").alias("component"))
    ids = rooted.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("prints"))
    of = materialize(join_counted(rooted, ids, ["component"], nodes.count(), "prints").select("fingerprint", "component_id", "copies"), "simhash-ids")
    discard(nodes)
    discard(parts)
    return join_counted(prints, of, ["fingerprint"], prints.count()).select("doc_id", "fingerprint", "component_id")


# --- texts by the similarity of their shingle sets


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A 64-bit hash of a row's id and text; rows without an id have keys too."""
    return F.xxhash64(F.col(doc_id).isNull(), doc_id, F.col(text).isNull(), text)


def segments_of(texts: int) -> tuple[int, int]:
    """Bits of a segment and number of segments for so many texts.

    Sets of one size n with a Jaccard similarity s share c = 2 s / (1 + s) of their elements, so a bit differs with
    probability arccos(c) / pi. A segment finds the pair if at most one of its bits differs; enough segments find RECALL.
    """
    width = max(LEAST_BITS, math.ceil(math.log2(max(texts, 1))) + SPARE_BITS)
    p = _differs()
    one = (1 - p) ** width + width * p * (1 - p) ** (width - 1)
    # what the two limits of far() lose is found beside it
    return width, max(-(-HEAD // width), math.ceil(math.log(max(1 - RECALL - 2 * LOST, 1e-12)) / math.log(1 - one)))


def _differs() -> float:
    """Probability that one bit differs between two sets of the least similarity."""
    s = SIMILAR[0] / SIMILAR[1]
    return math.acos(2 * s / (1 + s)) / math.pi


def far(bits: int) -> int:
    """The most bits of so many that may differ between fingerprints still compared: more do in a pair of the least similarity with a probability of LOST at most."""
    p, tail = _differs(), 0.0
    for k in range(bits, -1, -1):
        tail += math.exp(math.lgamma(bits + 1) - math.lgamma(k + 1) - math.lgamma(bits - k + 1) + k * math.log(p) + (bits - k) * math.log(1 - p))
        if tail > LOST:
            return k
    return bits


def set_prints(docs: DataFrame, words: int, width: int, segments: int) -> DataFrame:
    """Fingerprints of the shingle sets of whole texts: doc_id, row_key, node (a hash of the set), n (its size), head (HEAD bits as two values), segments (array<long>)."""
    blocks = -(-width * segments // 64)
    weights = (1 << np.arange(width)).astype(np.int64)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _text_shingles(batches, words, SET_BLOCK):
            nodes, sizes, heads, parts = [], [], [], []
            for hashes in map(np.unique, found):
                bits = np.concatenate([majority(hashes if k == 0 else mix64(hashes + np.uint64(k))) for k in range(blocks)])
                nodes.append(xxhash.xxh64_intdigest(hashes.tobytes()))
                sizes.append(len(hashes))
                heads.append((_signed(bits[:64]), _signed(bits[64:128])))
                parts.append(bits[: width * segments].reshape(segments, width) @ weights)
            ends = pa.array(np.arange(len(found) + 1, dtype=np.int32) * segments)
            arrays = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.StructArray.from_arrays([pa.array([h[k] for h in heads], pa.int64()) for k in (0, 1)], ["low", "high"]), arrays], ["doc_id", "row_key", "node", "n", "head", "segments"])

    own = docs.select("doc_id", row_key().alias("row_key"), "text")
    return own.mapInArrow(rows, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, row_key long, node long, n long, head struct<low:long,high:long>, segments array<long>")


def _shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, shingles, parity): the shingle set of each text, and for each of PARITY classes of hashes whether the set has an odd number of them.

    Parities of two sets differ at most as often as their shingles, so they tell that two sets are too different, and never wrongly.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _text_shingles(batches, words, SET_BLOCK):
            sets = [np.unique(h).view(np.int64) for h in found]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            odd = [np.packbits((np.bincount(s & (PARITY - 1), minlength=PARITY) & 1).astype(bool)).view(np.int64) for s in sets]
            places = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * (PARITY // 64))
            arrays = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets))), pa.ListArray.from_arrays(places, pa.array(np.concatenate(odd)))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), *arrays], ["node", "shingles", "parity"])

    return texts.select("node", "text").mapInArrow(rows, "node long, shingles array<long>, parity array<long>")


def _excess(a: Column, b: Column) -> Column:
    """Over 0 if the parities of two sets (of head) show that they agree by less than SIMILAR: they differ by over (|a| + |b|) (q - p) / (p + q) shingles for p / q. Null if their heads are too far apart."""
    p, q = SIMILAR
    odd = sum((F.bit_count(F.get(a["parity"], k).bitwiseXOR(F.get(b["parity"], k))) for k in range(PARITY // 64)), F.lit(0))
    return F.when(_differing_heads(a, b) <= far(HEAD), odd * (p + q) - (a["n"] + b["n"]) * (q - p))


def near_texts(docs: DataFrame, words: int = 5) -> DataFrame:
    """Component of every row: doc_id, row_key, component, over links between texts whose shingle sets agree by 0.8 or more.

    Texts of equal sets are one node; texts without words are one component. No link joins texts that agree by less.
    The index finds at least RECALL of the pairs at 0.8 (see segments_of), and nearly all that agree by more.
    """
    rows = docs.count()
    width, segments = segments_of(rows)
    prints = materialize(set_prints(docs, words, width, segments), "simhash-sets")
    nodes = materialize(prints.groupBy("node").agg(F.first("n").alias("n"), F.first("head").alias("head"), F.first("segments").alias("segments"), F.min("row_key").alias("row_key"), F.count("*").alias("copies")), "simhash-nodes")
    indexed = materialize(index(nodes), "simhash-index")
    found = materialize(lookups(indexed, width, 1), "simhash-found")
    whole = nodes.select("node", "n", "segments")

    def sides(pairs: DataFrame, table: DataFrame) -> DataFrame:
        for side in ("node", "other"):
            pairs = pairs.join(table.select(F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in table.columns if c != "node"]), side)
        return pairs

    def near_whole(pairs: DataFrame, first: bool) -> DataFrame:
        if first:  # the nearest few join most of a group; all others that stay apart are compared afterwards
            best = pairs.groupBy("node").agg(F.slice(F.array_sort(F.collect_set(F.struct("apart", "other"))), 1, NEAREST).alias("best"))
            pairs = best.select("node", F.explode("best").alias("x")).select("node", "x.other", "x.apart")
        distance = sum((F.bit_count(F.get("node_segments", k).bitwiseXOR(F.get("other_segments", k))) for k in range(segments)), F.lit(0))
        a, b = SIMILAR
        sizes = (F.col("node_n") * b >= F.col("other_n") * a) & (F.col("other_n") * b >= F.col("node_n") * a)
        return sides(pairs, whole).filter(sizes & (distance <= far(width * segments))).select("node", "other", "apart")

    groups = materialize(with_partner(indexed, found, _differing_heads, far(HEAD), near_whole), "simhash-groups")
    # only texts whose fingerprint is near another one are read again, and compared by their sets
    keyed = docs.select(row_key().alias("row_key"), "text")
    copies = prints.groupBy("row_key").agg(F.count("*").alias("copies"))
    some = nodes.join(groups, "node").select("node", "row_key").join(copies, "row_key")
    chosen = join_counted(keyed, some, ["row_key"], rows).groupBy("row_key").agg(F.first("node").alias("node"), F.first("text").alias("text"))
    sets = materialize(_shingle_sets(chosen, words), "simhash-shingles")

    def alike(pairs: DataFrame, first: bool) -> DataFrame:
        pairs = near_whole(pairs, first)
        a, b = SIMILAR
        common, sizes = F.size(F.array_intersect("node_shingles", "other_shingles")), F.size("node_shingles") + F.size("other_shingles")
        return sides(pairs.select("node", "other"), sets.select("node", "shingles")).filter(common * (a + b) >= sizes * a)

    marked = sets.select("node", F.size("shingles").cast("long").alias("n"), "parity")
    head = F.struct("head.low", "head.high", "n", "parity").alias("head")
    some_index, some_found = (materialize(t.join(marked, "node").select("key", "node", head), "simhash-index") for t in (indexed, found))
    parts = materialize(linked(some_index, some_found, _excess, 0, alike), "simhash-alike")
    of = materialize(nodes.join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "copies"), "simhash-components")
    for table in (indexed, found, some_index, some_found, sets, groups, parts, nodes):
        discard(table)
    return join_counted(prints.select("doc_id", "row_key", "node"), of, ["node"], rows).select("doc_id", "row_key", "component")
