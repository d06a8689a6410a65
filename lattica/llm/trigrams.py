"""Boolean trigram queries of regular expressions."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from re import _constants as sre
from re import _parser as sre_parser

#: Sets of exact strings beyond this size are given up for their trigrams.
MAX_EXACT = 64


@dataclass(frozen=True)
class Query:
    """A Boolean query: `any` of alternatives, each a set of trigrams that must all occur. One empty alternative matches every text."""

    any: frozenset[frozenset[str]]

    @property
    def matches_all(self) -> bool:
        return frozenset() in self.any

    def both(self, other: "Query") -> "Query":
        return Query(_least({a | b for a in self.any for b in other.any}))

    def either(self, other: "Query") -> "Query":
        return Query(_least(self.any | other.any))


def _least(sets: set | frozenset) -> frozenset:
    """Without alternatives that include another one."""
    return frozenset(s for s in sets if not any(t < s for t in sets))


ALL = Query(frozenset([frozenset()]))


def _of_strings(strings: frozenset[str]) -> Query:
    return Query(_least({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}))


def _walk(items) -> tuple[frozenset[str] | None, Query]:
    """The finite set of strings that a sequence can match (or None), and a query that holds wherever it matches."""
    run: frozenset[str] | None = frozenset([""])  # what may stand just before here, as far as it is known
    whole = True
    query = ALL
    for op, value in items:
        part: frozenset[str] | None = None
        part_query = ALL
        if op is sre.LITERAL:
            part = frozenset([chr(value)])
        elif op is sre.IN and all(k is sre.LITERAL for k, _ in value):
            part = frozenset(chr(c) for _, c in value)
        elif op is sre.SUBPATTERN:
            part, part_query = _walk(value[3])
        elif op is sre.BRANCH:
            parts = [_walk(x) for x in value[1]]
            if all(p is not None for p, _ in parts):
                part = frozenset().union(*(p for p, _ in parts))
            else:
                part_query = Query(frozenset())
                for p, q in parts:
                    part_query = part_query.either(_of_strings(p) if p is not None else q)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, inner = value
            p, q = _walk(inner)
            if (least, most) == (0, 1) and p is not None:
                part = p | {""}
            elif least >= 1:
                part_query = _of_strings(p) if p is not None else q
        if part is not None and run is not None and len(part) * len(run) <= MAX_EXACT:
            run = frozenset(a + b for a, b in product(run, part))
            continue
        whole = False
        query = query.both(part_query)
        if run is not None:
            query = query.both(_of_strings(run))
        run = part
    if whole:
        return run, ALL
    return None, query.both(_of_strings(run)) if run is not None else query


def trigram_query(pattern: str, ignore_case: bool = False) -> Query:
    """The trigrams that any text with a match of the pattern must hold, in lower case if ignore_case.

    Strings are followed through literals, small classes, groups, alternatives and optional parts; all else matches
    anything. A pattern without mandatory trigrams gives a query that matches all, so it has to be scanned in full.
    """
    exact, query = _walk(sre_parser.parse(pattern.lower() if ignore_case else pattern))
    return query if exact is None else _of_strings(exact)
