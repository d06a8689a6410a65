"""Secret scans: a trigram index picks the documents that a rule can match at all, native regular expressions verify them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .trigrams import trigram_query


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match stands if its group `group` has at least `least` characters.

    `pattern` is a regular expression as Java and Python read it alike. Matches are the leftmost ones that don't overlap.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    ignore_case: bool = False

    @property
    def java(self) -> str:
        return ("(?i)" if self.ignore_case else "") + self.pattern


#: The base rules, in their order. Runs of one class are matched with their least length in the pattern, which leaves the
#: same spans as dropping shorter runs afterwards, as a run is matched whole or not at all.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Further well-known formats, after the base rules.
MORE_RULES = (
    Rule("hosting", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES


#: Bits of a bitmap that a long value holds.
WORD_BITS = 60


def _numbers(rules: Sequence[Rule]) -> dict[str, int]:
    """The trigrams that some query names, numbered: under "lower:" those of rules that ignore case, which are looked for in the text in lower case, under "exact:" the others."""
    return {t: k for k, t in enumerate(sorted({("lower:" if r.ignore_case else "exact:") + t for r in rules for s in trigram_query(r.pattern, r.ignore_case).any for t in s}))}


def _holds(trigram: str, text: Column) -> Column:
    return F.contains(F.lower(text) if trigram.startswith("lower:") else text, F.lit(trigram[6:]))


def postings(keyed: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The inverted index for the trigrams of the rules as a table: one row (trigram, _id, _sum) per trigram and text that holds it. For indexes that are kept; trigrams that no query names aren't indexed."""
    held = [F.when(_holds(t, F.col("text")), F.lit(t)) for t in _numbers(rules)]
    return keyed.select("_id", "_sum", F.explode(F.array_compact(F.array(*held)) if held else F.array().cast("array<string>")).alias("trigram"))


def bitmaps(text: Column, rules: Sequence[Rule] = RULES) -> list[Column]:
    """The same index as bits of a text's own row: bit k % WORD_BITS of value k // WORD_BITS says whether it is in the postings of trigram k."""
    words: dict[int, Column] = {}
    for t, k in _numbers(rules).items():
        bit = F.when(_holds(t, text), F.lit(1 << k % WORD_BITS).cast("long")).otherwise(F.lit(0).cast("long"))
        words[k // WORD_BITS] = words[k // WORD_BITS].bitwiseOR(bit) if k // WORD_BITS in words else bit
    return [words[w] for w in sorted(words)]


def meets(rule: Rule, rules: Sequence[Rule], words: Sequence[Column]) -> Column:
    """Whether the bitmaps satisfy a rule's Boolean query: intersections of postings are conjunctions of bits, alternatives are disjunctions."""
    number, query = _numbers(rules), trigram_query(rule.pattern, rule.ignore_case)

    def all_of(trigrams: frozenset[str]) -> Column:
        masks: dict[int, int] = {}
        for t in trigrams:
            k = number[("lower:" if rule.ignore_case else "exact:") + t]
            masks[k // WORD_BITS] = masks.get(k // WORD_BITS, 0) | 1 << k % WORD_BITS
        return reduce(Column.__and__, [words[w].bitwiseAND(F.lit(m).cast("long")) == F.lit(m).cast("long") for w, m in sorted(masks.items())])

    return F.lit(True) if query.matches_all else reduce(Column.__or__, [all_of(s) for s in sorted(query.any, key=sorted)])


def candidates(index: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Texts (_id, _sum) with an array `rules` of the indexed rules whose Boolean query a table of postings satisfies. A text's postings meet as bits; their union is a partial aggregation in each task."""
    number = _numbers(rules)
    words = []
    for w in range(-(-len(number) // WORD_BITS)):
        bits = F.create_map(*[x for t, k in number.items() if k // WORD_BITS == w for x in (F.lit(t), F.lit(1 << k % WORD_BITS).cast("long"))])
        words.append(F.bit_or(F.coalesce(F.try_element_at(bits, "trigram"), F.lit(0).cast("long"))).alias(f"w{w}"))
    merged = index.groupBy("_id", "_sum").agg(*words)
    met = [F.when(meets(r, rules, [F.col(f"w{w}") for w in range(len(words))]), F.lit(r.kind)) for r in rules if not trigram_query(r.pattern, r.ignore_case).matches_all]
    return merged.select("_id", "_sum", F.array_compact(F.array(*met)).alias("rules")).filter(F.size("rules") > 0)


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """The running combination of an array of numbers, by doubling: each pass combines every value with the one 1, 2, 4, ... places before."""
    passes = F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int")
    doubled = lambda acc, k: F.transform(acc, lambda x, i: F.coalesce(combine(x, F.get(acc, i - F.call_function("shiftleft", F.lit(1), k))), x))
    return F.when(F.size(values) < 2, values).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(passes - 1, F.lit(0))), values, doubled))


def _spans(rule: Rule, number: int, text: Column) -> Column:
    """Array of (start, kind, end) of a rule's matches that stand, in code points, from the pieces between the matches."""
    whole = F.regexp_extract_all(text, F.lit(rule.java), F.lit(0))
    value = whole if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.java), F.lit(rule.group))
    lengths = F.transform(whole, lambda m: F.length(m))
    # as many pieces as matches, each before its match
    ends = running(F.zip_with(F.slice(F.split(text, rule.java, -1), 1, F.size(whole)), lengths, lambda gap, n: F.length(gap) + n), lambda x, y: x + y)
    placed = F.zip_with(F.arrays_zip(ends.alias("end"), lengths.alias("len")), value, lambda x, v: F.struct((x["end"] - x["len"]).alias("start"), F.lit(number).alias("kind"), x["end"].alias("end"), F.length(v).alias("of")))
    return F.transform(F.filter(placed, lambda s: s["of"] >= rule.least), lambda s: F.struct(s["start"], s["kind"], s["end"]))


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Spans of every rule in every whole text: doc_id, text, lang, source, spans (array of start, kind as number of the rule, end).

    A rule's pattern is tried only on the texts that satisfy its trigram query by their bitmaps; rules whose pattern has
    no mandatory trigram read every text. Each row has its own results, in one pass without an exchange. Null texts have no
    spans; spans are in code points, ends exclusive, in order of start, then of the rules. Other columns of docs don't take part.
    """
    kept = [c for c in ("doc_id", "text", "lang", "source") if c in docs.columns]
    text = F.coalesce(F.col("text"), F.lit(""))
    maps = bitmaps(text, rules)
    indexed = docs.select(*kept, *[m.alias(f"_w{w}") for w, m in enumerate(maps)])
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    found = [F.when(meets(r, rules, [F.col(f"_w{w}") for w in range(len(maps))]) & text.rlike(r.java), _spans(r, k, text)).otherwise(none) for k, r in enumerate(rules)]
    return indexed.select(*kept, F.array_sort(F.flatten(F.array(*found))).alias("spans"))


def span_list(spans: Column | str, rules: Sequence[Rule] = RULES) -> Column:
    """Spans as kind:start:end, joined by commas."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "<secret>") -> Column:
    """The text with every span, or run of spans that overlap, replaced by a mark. Spans are in order of start."""
    reach = running(F.transform(spans, lambda s: s["end"]), lambda x, y: F.greatest(x, y))
    # where all spans before a span end; a span that begins there or later begins a new mark
    before = F.concat(F.array(F.lit(0)), F.slice(reach, 1, F.size(spans) - 1))
    begins = F.filter(F.zip_with(spans, before, lambda s, b: F.struct(s["start"].alias("start"), b.alias("before"))), lambda x: x["start"] >= x["before"])
    pieces = F.transform(begins, lambda x: F.substring(text, x["before"] + 1, x["start"] - x["before"]))
    rest = F.substring(text, F.array_max(reach) + 1, F.length(text))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(pieces, mark), F.lit(mark), rest))
