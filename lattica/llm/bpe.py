"""BPE by backtracking: longest matches of an Aho-Corasick automaton, checked against the table of compatible pairs.

The exact merges of a word follow without merging: a sequence of tokens is the BPE result if every token is its own
result and no two neighbours could have been merged across their border. From the left, the longest match that is
compatible with the token before it is taken; where none is, the last token gives way to its next shorter prefix. No
place of a word is tried twice, so the time is linear. Decoding copies each token's bytes by an offset table.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .text import text_blocks

#: Stands for the end of a word inside the automaton; no token's own letters hold it.
END = ""
#: Words that are kept encoded, per Python worker; the store is emptied when full. Longer words than KEPT_LENGTH are not kept.
KEPT_WORDS, KEPT_LENGTH, KEPT_PAIRS = 500_000, 64, 500_000


#: Latin letters beyond ASCII, as a part of a class.
LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_NOT_LATIN = re.compile(f"[^\\x00-\\x7f{LATIN}]").search


@lru_cache(maxsize=1)
def _byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabularies of this kind: printable bytes stand for themselves, the others for letters from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = iter(range(256, 512))
    own = set(plain)
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class Encoder:
    """Encodes words by a vocabulary with merges. Tokens' ids rise with the rank of the merge that makes them."""

    def __init__(self, spec: str) -> None:
        model = json.loads(spec)
        parts = model["model"]
        self.suffix = parts["end_of_word_suffix"]
        vocabulary: dict[str, int] = parts["vocab"]
        named = {token: (token[: -len(self.suffix)] + END if token.endswith(self.suffix) and token != self.suffix else token) for token in vocabulary}
        self.token = {named[t]: i for t, i in vocabulary.items()}
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in parts["merges"]]
        self.made: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for a, b in pairs:
            whole = vocabulary[a + b]
            self.made[vocabulary[a], vocabulary[b]] = whole
            self.halves[whole] = (vocabulary[a], vocabulary[b])
        self.length = [0] * (max(vocabulary.values()) + 1)
        for t, i in self.token.items():
            self.length[i] = len(t)
        self.fits_kept: dict[int, bool] = {}
        # a token that its own letters don't merge to never occurs in a result
        whole = {t: i for t, i in self.token.items() if i not in self.halves or self.fits(*self.halves[i], below=i)}
        self.automaton = ahocorasick.Automaton()
        for t, i in whole.items():
            self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        self.shorter = [-1] * len(self.length)
        for t, i in whole.items():
            self.shorter[i] = next((whole[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in whole), -1)
        self.split_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        split = next(p for p in model["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.any_pieces = regex.compile(split.replace(r"\s", r"\p{White_Space}")).findall
        # the same pattern for texts of ASCII and Latin letters alone, where the classes are short
        self.latin_pieces = re.compile(split.replace(r"\s", r"\t-\r ").replace(r"\p{L}", "A-Za-z" + LATIN).replace(r"\p{N}", "0-9")).findall
        # decoding: the bytes of all tokens, each with the blank that joins it to the next, and where each begins
        texts = {i: t for t, i in vocabulary.items()} | {i: t for t, i in self.special.items()}
        joined = [(texts.get(i, "") + " ").encode() for i in range(max(texts) + 1)]
        self.begin = np.concatenate([[0], np.cumsum([len(x) for x in joined])]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(joined), np.uint8)
        self.words = _Words(self)

    def fits(self, left: int, right: int, below: int | None = None) -> bool:
        """Whether BPE leaves the border between two tokens alone; below: only merges of a lower id than this count."""
        a, b = left, right
        limit = len(self.length) if below is None else below
        while True:
            whole = self.made.get((a, b))
            if whole is not None and whole < limit:
                return False
            # undo the later of the two tokens: its half at the border stood there before
            if a > b:
                limit, halves = a, self.halves.get(a)
                if halves:
                    a = halves[1]
                    continue
                limit, halves = b + 1, self.halves.get(b)
                if not halves:
                    return True
                b = halves[0]
            else:
                limit, halves = b + 1, self.halves.get(b)
                if halves:
                    b = halves[0]
                    continue
                limit, halves = a, self.halves.get(a)
                if not halves:
                    return True
                a = halves[1]

    def encode_word(self, word: str) -> list[int]:
        """The tokens of one word."""
        letters = word if word.isascii() and word.isprintable() else "".join(map(_byte_letters().__getitem__, word.encode()))
        last_place = len(letters)
        # by start, the longest match; a later end of the same start is the longer one
        longest: list[int] = [-1] * (last_place + 1)
        for end, (token, size) in self.automaton.iter(letters + END):
            longest[end - size + 1] = token
        kept, length, shorter = self.fits_kept, self.length, self.shorter
        closed: set[int] = {last_place}  # the mark of the word's end belongs to a token and can't stand alone
        out: list[int] = []
        at, token, last = 0, longest[0], -1
        while at < last_place:
            while token >= 0:
                end = at + length[token]
                if end not in closed:
                    if last < 0:
                        break
                    good = kept.get(last << 32 | token)
                    if good is None:
                        if len(kept) > KEPT_PAIRS:
                            kept.clear()
                        good = kept[last << 32 | token] = self.fits(last, token)
                    if good:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, last = end, token
                if at < last_place:
                    token = longest[at]
            else:
                closed.add(at)
                token = out.pop()
                at -= length[token]
                token = shorter[token]
                last = out[-1] if out else -1
        return out

    def pieces(self, text: str) -> list[str]:
        """The words of a text in lower case."""
        return self.any_pieces(text) if _NOT_LATIN(text) else self.latin_pieces(text)

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers. Special tokens' strings become those tokens."""
        if self.split_special is None or "<|" not in text and not any(s in text for s in self.special):
            return b"".join(map(self.words.__getitem__, self.pieces(_plain(text))))
        out = []
        for part in self.split_special.split(text):
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            else:
                out.extend(map(self.words.__getitem__, self.pieces(_plain(part))))
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' strings joined by blanks, in UTF-8."""
        if not len(ids):
            return b""
        begin = self.begin[ids]
        lengths = self.begin[ids + 1] - begin
        ends = np.cumsum(lengths)
        places = np.arange(int(ends[-1]), dtype=np.int64) + np.repeat(begin - (ends - lengths), lengths)
        return self.bytes[places[:-1]].tobytes()


class _Words(dict):
    def __init__(self, encoder: Encoder) -> None:
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.encoder.encode_word(word), "<u4").tobytes()
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = ids
        return ids


def _plain(text: str) -> str:
    """NFC and lower case letter by letter (a final sigma is a sigma). White space is left: it only parts words."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


@lru_cache(maxsize=2)
def _encoder(spec: str) -> Encoder:
    return Encoder(spec)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every whole text: doc_id, n_tokens, ids (array<int>), decoded (string).

    path: a vocabulary file that the driver reads; its text (1 to 2 MB) goes to the executors as a broadcast. Null and
    empty texts have no tokens. Rows are kept as they are, also those that repeat or have a null doc_id; other columns
    don't take part. Memory is bounded by the longest text.
    """

    def rows(encoder: Encoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in text_blocks(batches):
            ids, texts = [], []
            for text in batch.column("text").to_pylist():
                coded = np.frombuffer(encoder.encode(text or ""), "<u4")
                ids.append(coded.astype(np.int32))
                texts.append(encoder.decode(coded.astype(np.int64)).decode())
            sizes = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(sizes).astype(np.int64)), pa.ListArray.from_arrays(pa.array(sizes), pa.array(values)), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return _mapped(docs, path, rows, "doc_id {}, n_tokens long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """As encode(), with digests in place of the ids and the decoded text: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def rows(encoder: Encoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in text_blocks(batches):
            counts, ids, texts = [], [], []
            for text in batch.column("text").to_pylist():
                coded = encoder.encode(text or "")
                counts.append(len(coded) // 4)
                ids.append(hashlib.sha256(coded).hexdigest())
                texts.append(hashlib.sha256(encoder.decode(np.frombuffer(coded, "<u4").astype(np.int64))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _mapped(docs, path, rows, "doc_id {}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _mapped(docs: DataFrame, path: str, rows, schema: str) -> DataFrame:
    spark: SparkSession = docs.sparkSession
    with open(path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows(_encoder(spec.value), batches)

    own = docs.select("doc_id", "text")
    return own.mapInArrow(run, schema.format(own.schema["doc_id"].dataType.simpleString()))
