"""Media columns: payloads stored as images of 8-bit samples, cut in chunks by their content, each chunk kept once.

A rolling gear hash cuts the stored form where the low bits of the last bytes' hash are 0, so equal passages give equal
chunks wherever they stand. Chunks whose digest occurs more than once are kept in one table, once each; the others stay
in the pack of their only document, and so never move. A document is an ordered list of digests; reading it back joins
the chunks it shares, puts all in order and verifies the digest of the whole.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize
from .text import text_blocks

WIDTH = 64
LEAST, MOST, MASK_BITS = 512, 8192, 11
#: Up to so many repeated digests (16 bytes each) go to the tasks as a broadcast; beyond, they reach the documents by a join.
MAX_BROADCAST_DIGESTS = 1_000_000

_GEAR = np.random.default_rng(64).integers(0, 1 << 32, 256, np.uint32)
_PACK = "doc_id {ids}, sum long, media_sha256 string, n_bytes long, chunks array<struct<digest:binary,size:int,shared:boolean>>, pack binary"


def to_media(text: bytes) -> bytes:
    """The payload, padded with 0 to a positive multiple of 64, as a grey image 64 samples wide (portable graymap)."""
    rows = max(1, -(-len(text) // WIDTH))
    return b"P5\n%d %d\n255\n" % (WIDTH, rows) + text + bytes(rows * WIDTH - len(text))


def samples(media: bytes) -> bytes:
    """The payload of an image that to_media() made."""
    kind, size, depth, payload = media.split(b"\n", 3)
    width, rows = map(int, size.split())
    if (kind, depth) != (b"P5", b"255") or len(payload) != width * rows:
        raise ValueError("not an image of 8-bit samples of the stated size")
    return payload


def feature(payload: bytes) -> str:
    """Mean and entropy of the samples, and for each column whether it is brighter than the mean."""
    grid = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    columns = grid.sum(axis=0, dtype=np.int64)
    counts = np.bincount(grid.ravel(), minlength=256)
    share = counts[counts > 0] / grid.size
    bits = np.packbits(columns * WIDTH > columns.sum()).tobytes().hex()
    return f"{columns.sum() / grid.size:.3f}:{abs(float(-(share * np.log2(share)).sum())):.3f}:{bits}"


def gear_cuts(data: np.ndarray, begin: int, end: int, marks: np.ndarray) -> list[int]:
    """Ends of the chunks of data[begin:end]; marks: places after which the hash allows a cut, in order."""
    cuts = []
    at = int(np.searchsorted(marks, begin))
    n = len(marks)
    while begin < end:
        while at < n and marks[at] < begin + LEAST:
            at += 1
        cut = min(end, begin + MOST)
        if at < n and marks[at] < cut:
            cut = int(marks[at])
        cuts.append(cut)
        begin = cut
    return cuts


def gear_marks(data: np.ndarray) -> np.ndarray:
    """Places after which a chunk may end: where the hash of the MASK_BITS bytes before has no bit set.

    The low k bits of a gear hash depend on the last k bytes only, so the hashes of all places follow by doubling.
    """
    h, size = _GEAR[data] & np.uint32((1 << MASK_BITS) - 1), 1
    while size < MASK_BITS:
        older = np.zeros_like(h)
        older[size:] = h[:-size] << np.uint32(size)
        h = (h + older) & np.uint32((1 << MASK_BITS) - 1)
        size *= 2
    return np.flatnonzero(h == 0) + 1


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[bytes, int, list[bytes]]]]]:
    """Per text: its media, the length of the text, and its chunks in order."""
    for batch, data, offsets in text_blocks(batches):
        raw = data.tobytes()
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            media = to_media(raw[a:b])
            cuts = gear_cuts(media, 0, len(media), gear_marks(np.frombuffer(media, np.uint8)))
            out.append((media, b - a, [media[x:y] for x, y in zip([0, *cuts], cuts)]))
        yield batch, out


def _digest(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()[:16]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in _cut_texts(batches):
        rows = pa.array([k for k, (_, _, chunks) in enumerate(texts) for _ in chunks], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([_digest(c) for _, _, chunks in texts for c in chunks], pa.binary()), batch.column("doc_id").take(rows), batch.column("sum").take(rows)], ["digest", "doc_id", "sum"])


def _pack(repeated: Callable[[pa.RecordBatch], list]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch, texts in _cut_texts(batches):
            known = repeated(batch)
            sums, sizes, lists, packs = [], [], [], []
            for (media, n, chunks), shared in zip(texts, known):
                digests = [_digest(c) for c in chunks]
                lists.append([{"digest": d, "size": len(c), "shared": d in shared} for d, c in zip(digests, chunks)])
                packs.append(squeeze(b"".join(c for d, c in zip(digests, chunks) if d not in shared)))
                sums.append(hashlib.sha256(media).hexdigest())
                sizes.append(n)
            kind = pa.list_(pa.struct([("digest", pa.binary()), ("size", pa.int32()), ("shared", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("sum"), pa.array(sums, pa.string()), pa.array(sizes, pa.int64()), pa.array(lists, kind), pa.array(packs, pa.binary())], ["doc_id", "sum", "media_sha256", "n_bytes", "chunks", "pack"])

    return run


def _shared_bytes(repeated: Callable[[pa.RecordBatch], list]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        sent: set[bytes] = set()  # what this task has sent; emptied before it grows large
        for batch, texts in _cut_texts(batches):
            found = {}
            for (_, _, chunks), shared in zip(texts, repeated(batch)):
                if shared:
                    found |= {d: c for c in chunks if (d := _digest(c)) in shared and d not in sent}
            if len(sent) > 500_000:
                sent.clear()
            sent |= found.keys()
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([squeeze(c) for c in found.values()], pa.binary())], ["digest", "bytes"])

    return run


def store(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Write the media of all texts in the shared folder: the packs (one row per document) and the shared chunks (one row per digest).

    Null texts are empty. Rows stay as they are, also those that repeat; other columns don't take part.
    """
    spark = docs.sparkSession
    own = docs.select("doc_id", F.xxhash64("text").alias("sum"), "text")
    ids = own.schema["doc_id"].dataType.simpleString()
    cut = materialize(own.mapInArrow(_digests, f"digest binary, doc_id {ids}, sum long"), "media-digests")
    often = materialize(cut.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest"), "media-repeated")
    if often.count() <= MAX_BROADCAST_DIGESTS:
        known = spark.sparkContext.broadcast(frozenset(often.toArrow().column("digest").to_pylist()))

        def repeated(batch: pa.RecordBatch) -> list:
            return [known.value] * batch.num_rows

        texts = own
    else:

        def repeated(batch: pa.RecordBatch) -> list:
            return [frozenset(x or ()) for x in batch.column("repeated").to_pylist()]

        lists = cut.join(often, "digest").groupBy("doc_id", "sum").agg(F.collect_set("digest").alias("repeated"))
        texts = own.join(lists, own["doc_id"].eqNullSafe(lists["doc_id"]) & (own["sum"] == lists["sum"]), "left").select(own["doc_id"], own["sum"], "text", "repeated")
    packs = materialize(texts.mapInArrow(_pack(repeated), _PACK.format(ids=ids)), "media-packs")
    shared = materialize(texts.mapInArrow(_shared_bytes(repeated), "digest binary, bytes binary").groupBy("digest").agg(F.first("bytes").alias("bytes")), "media-chunks")
    discard(cut)
    return packs, shared


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    expand = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        joined = batch.column("joined").to_pylist() if "joined" in batch.schema.names else [None] * batch.num_rows
        for doc, n, digest, chunks, pack, other in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media_sha256", "chunks", "pack")), joined):
            own, at, parts = expand(pack), 0, []
            known = {x["digest"]: x["bytes"] for x in other or ()}
            for c in chunks:
                if c["shared"]:
                    parts.append(expand(known[c["digest"]]))
                else:
                    parts.append(own[at : at + c["size"]])
                    at += c["size"]
            media = b"".join(parts)
            if hashlib.sha256(media).hexdigest() != digest:
                raise ValueError(f"the chunks of document {doc} don't give back its media")
            yield doc, n, media, digest


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [None, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        rows = []
        for doc, n, media, digest in _rebuild([batch]):
            payload = samples(media)
            rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), digest, feature(payload)))
        columns = list(zip(*rows)) if rows else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k or batch.schema.field("doc_id").type) for c, k in zip(columns, kinds)], names)


def _media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = list(_rebuild([batch]))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.schema.field("doc_id").type), pa.array([r[2] for r in rows], pa.binary())], ["doc_id", "media"])


def _parts(packs: DataFrame, shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packs that stand alone, and packs with the shared chunks they need as `joined`."""
    needs = F.exists("chunks", lambda c: c["shared"])
    ids = F.struct(F.col("doc_id"), F.col("sum"))
    whole = packs.filter(needs).withColumn("id", ids)
    refs = whole.select("id", F.explode(F.array_distinct(F.transform(F.filter("chunks", lambda c: c["shared"]), lambda c: c["digest"]))).alias("digest")).distinct()
    lists = refs.join(shared, "digest").groupBy("id").agg(F.collect_list(F.struct("digest", "bytes")).alias("joined"))
    return packs.filter(~needs), whole.join(lists, "id").drop("id")


def load(packs: DataFrame, shared: DataFrame) -> DataFrame:
    """The media of every document, put together and verified: doc_id, media (binary)."""
    schema = f"doc_id {packs.schema['doc_id'].dataType.simpleString()}, media binary"
    alone, joined = _parts(packs, shared)
    return alone.mapInArrow(_media, schema).unionByName(joined.mapInArrow(_media, schema))


def describe(packs: DataFrame, shared: DataFrame) -> DataFrame:
    """Sizes, digests and features from the media read back: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    schema = f"doc_id {packs.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    alone, joined = _parts(packs, shared)
    return alone.mapInArrow(_describe, schema).unionByName(joined.mapInArrow(_describe, schema))
