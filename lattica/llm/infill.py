"""Fill-in-the-middle: texts cut at two places between their tokens and put together in another order, and back again."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A token with the blanks before it; blanks at the end of a text are a token of their own.
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
#: What stands before prefix, suffix and middle in the output. Texts that hold one of these stay plain.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many are cut, and of 100 cut ones so many begin with the suffix.
CUT, SUFFIX_FIRST = 50, 80
MADE = ("n", "form", "prefix_chars", "middle_chars", "output")


def count_units(text: str) -> int:
    """First pass: how many tokens a text has. Matches come one by one and none is kept."""
    return sum(1 for _ in UNIT.finditer(text))


def unit_ends(text: str, low: int, high: int) -> tuple[int, int]:
    """Second pass: where the first `low` tokens end and where the first `high` do, from one iterator that stops there."""
    matches = UNIT.finditer(text)
    first = next(islice(matches, low - 1, low)).end() if low else 0
    return first, next(islice(matches, high - low - 1, high - low)).end() if high > low else first


def draws(doc_id: str, seed: int) -> list[Column]:
    """h1 to h4: the first four groups of eight hexadecimal digits of the SHA-256 of "seed:id"."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"_h{k + 1}") for k in range(4)]


def _assemble(text: str, h: tuple[int, int, int, int], cut: int, suffix_first: int) -> tuple[int, str, int | None, int | None, str]:
    n = count_units(text)
    if not text or h[2] % 100 >= cut or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = unit_ends(text, low, high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < suffix_first:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(docs: DataFrame, seed: int = 42, cut: int = CUT, suffix_first: int = SUFFIX_FIRST, most: int = 8 << 20) -> DataFrame:
    """docs with n (tokens), form ("plain", "psm" or "spm"), prefix_chars and middle_chars (code points, NULL if plain) and output.

    What happens to a text depends on seed, doc_id and the text alone, so reruns agree and rows with one id and text get
    one output; rows with one id and different texts share their draws, a null id draws as "null". A null text is empty,
    and an empty one is plain. A task holds one text, its output, and no list of tokens, however long the text is;
    outputs leave it in batches of about `most` code points. Columns of docs that are called as the made ones are
    replaced, all others stay.
    """
    taken = {*MADE, *(f"_h{k}" for k in range(1, 5)), "text"}
    kept = [f for f in docs.schema if f.name.lower() not in taken]
    texts = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.coalesce("text", F.lit("")).alias("text"), *draws("doc_id", seed))
    names = [*(f.name for f in kept), "text", *MADE]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, held, made = 0, 0, []
            last = batch.num_rows - 1
            hashes = [batch.column(f"_h{k}") for k in range(1, 5)]
            for i in range(batch.num_rows):
                out = _assemble(batch.column("text")[i].as_py(), tuple(h[i].as_py() for h in hashes), cut, suffix_first)
                made.append(out)
                held += len(out[-1])
                if held >= most or i == last:
                    own = [batch.column(c).slice(start, len(made)) for c in names[: -len(MADE)]]
                    yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, k) for c, k in zip(zip(*made), kinds))], names)
                    start, held, made = i + 1, 0, []

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "text string, n long, form string, prefix_chars long, middle_chars long, output string"])
    return texts.mapInArrow(rows, schema)


def restore(output: Column, form: Column) -> Column:
    """The text again, from output and form alone. No text that was cut holds a mark, and marks can't form where pieces meet one."""

    def pieces(second: str) -> tuple[Column, Column, Column]:
        rest = F.substr(output, F.lit(4))
        one = F.substring_index(rest, second, 1)
        rest = F.substr(rest, F.length(one) + 4)
        two = F.substring_index(rest, MIDDLE, 1)
        return one, two, F.substr(rest, F.length(two) + 4)

    prefix, suffix, middle = pieces(SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = pieces(PREFIX)
    spm = F.concat(prefix, middle, suffix)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
