"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns to a string. The turns of a conversation are rendered as prefixes, one
turn more each time; where an output begins with the one before, what is new is that turn's span. Where it doesn't, the
template has rewritten history, and the conversation is marked. Two more outputs of the whole conversation, with marks
in place of the texts that differ in their first and last characters, show where the texts stand: all that is equal in
both is the template's own. Texts that can't be told from the template so are rendered one by one with such marks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: Characters that begin a control string, and their escapes. The first escapes the sign that begins all escapes.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
_TURN = re.compile(r"<s>\[TURN\] ([^<\[]*) \[/TURN\] ([^<\[]*)</s>\n")


def escape(text: str) -> str:
    for sign, code in ESCAPES:
        text = text.replace(sign, code)
    return text


def unescape(text: str) -> str:
    for sign, code in reversed(ESCAPES):
        text = text.replace(code, sign)
    return text


@lru_cache(1 << 15)
def _turn(turn: Turn) -> str:
    return f"<s>[TURN] {escape(turn[0])} [/TURN] {escape(turn[1])}</s>\n"


def template(turns: list[Turn]) -> str:
    """Each turn as <s>[TURN] role [/TURN] text</s>, with escapes for what could be read as control strings."""
    return "".join(map(_turn, turns))


def read_back(formatted: str) -> list[Turn]:
    """The turns of an output of template()."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("text outside of turns")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("text outside of turns")
    return turns


@dataclass
class Formatted:
    text: str
    #: Of each turn, where its output begins and ends; None where the template rewrote what stood before.
    turns: list[tuple[int, int] | None]
    #: Of each turn, where its text stands in the output.
    texts: list[tuple[int, int] | None]
    rewrites: bool

    def lost(self, turns: list[Turn], trained: str = "assistant") -> int:
        """How many trained texts have no span although they aren't empty: the loss doesn't see them."""
        return sum(role == trained and text != "" and span is None for (role, text), span in zip(turns, self.texts))

    def loss_spans(self, roles: list[str], trained: str = "assistant") -> list[tuple[int, int]]:
        return [span for role, span in zip(roles, self.texts) if role == trained and span is not None]


#: Texts that stand for a turn's text. They share neither their first nor their last character.
MARKS = ("a0a", "b1b")


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def _text_span(turns: list[Turn], k: int, whole: str, template: Template) -> tuple[int, int] | None:
    """Where the text of turn k stands in the output of all turns, from two outputs in which marks take its place."""
    x, y = (template([*turns[:k], (turns[k][0], m), *turns[k + 1 :]]) for m in MARKS)
    head = _common(x, y)
    tail = _common(x[head:][::-1], y[head:][::-1])
    end = len(whole) - tail
    if x[head : len(x) - tail] != MARKS[0] or end < head or whole[:head] != x[:head] or whole[end:] != x[len(x) - tail :]:
        return None  # the text changes more of the output than the place where it stands
    return head, end


def _text_spans(turns: list[Turn], whole: str, template: Template) -> list[tuple[int, int] | None]:
    """Where the texts of all turns stand in the output of all turns; None where that can't be told."""
    marked = template([(role, MARKS[0]) for role, _ in turns])
    other = template([(role, MARKS[1]) for role, _ in turns])
    # the template's own pieces: what is equal in both outputs, between the marks
    pieces, at = [], 0
    for _ in turns:
        next_at = marked.find(MARKS[0], at)
        while next_at >= 0 and other[next_at : next_at + 3] != MARKS[1]:
            next_at = marked.find(MARKS[0], next_at + 1)
        if next_at < 0:
            break
        pieces.append(marked[at:next_at])
        at = next_at + 3
    pieces.append(marked[at:])
    if len(pieces) == len(turns) + 1 and MARKS[1].join(pieces) == other:
        # how a text is written shows when it is alone; all pieces and texts together have to give the output
        alone = {turn: _text_span([turn], 0, template([turn]), template) for turn in set(turns)}
        if None not in alone.values():
            written = {turn: template([turn])[a:b] for turn, (a, b) in alone.items()}
            spans, at = [], 0
            for piece, turn in zip(pieces, turns):
                spans.append((at + len(piece), at + len(piece) + len(written[turn])))
                at = spans[-1][1]
            if whole == "".join(x for piece, turn in zip(pieces, turns) for x in (piece, written[turn])) + pieces[-1]:
                return list(spans)
    return [_text_span(turns, k, whole, template) for k in range(len(turns))]


def _prefixes(turns: list[Turn], of: Template) -> Iterator[str]:
    """The outputs of all prefixes, one turn more each time. The pieces of the library's own template are escaped once and put together for each."""
    if of is template:
        pieces = [_turn(t) for t in turns]
        yield from ("".join(pieces[: k + 1]) for k in range(len(pieces)))
    else:
        yield from (of(turns[: k + 1]) for k in range(len(turns)))


def render(turns: list[Turn], template: Template = template) -> Formatted:
    """Spans of all turns, found by comparing the outputs of successive prefixes of the conversation.

    A template whose outputs end in something fixed rewrites that end with each turn, so it counts as one that rewrites.
    """
    spans: list[tuple[int, int] | None] = []
    before = template([])
    rewrites = False
    for now in _prefixes(turns, template):
        if now.startswith(before):
            spans.append((len(before), len(now)))
        else:
            rewrites = True
            kept = _common(before, now)
            spans = [s if s is not None and s[1] <= kept else None for s in spans] + [None]
        before = now
    return Formatted(before, spans, _text_spans(turns, before, template), rewrites)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[Turn]]]:
    """Whole conversations from rows in order."""
    current, turns, begun = None, [], False
    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            if begun and conv != current:
                yield current, turns
                turns = []
            current, begun = conv, True
            turns.append((role or "", text or ""))
    if begun:
        yield current, turns


def _ordered(conversations: DataFrame) -> DataFrame:
    own = conversations.select("conv_id", "turn", "role", "text")
    return own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def _spans(spans: list[tuple[int, int] | None]) -> list[dict | None]:
    return [None if s is None else {"start": s[0], "end": s[1]} for s in spans]


def format_chats(conversations: DataFrame, template: Template = template) -> DataFrame:
    """One row per conversation: conv_id, roles, formatted, turns and texts (spans in code points, end exclusive), loss (spans of assistants' texts), lost, rewrites.

    Rows are taken in order of turn (null first), then role, then text; repeated rows are turns of their own. Null roles
    and texts are empty; rows with a null conv_id are one conversation. lost counts the assistants' texts that the template
    has changed (say, to capitals) or repeats elsewhere, so that they have no span and take no part in the loss. A conversation is held in memory as a whole, as
    its output is one string. Other columns don't take part.
    """
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, turns in _conversations(batches):
            out = render(turns, template)
            roles = [r for r, _ in turns]
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv], pa.int64()), pa.array([roles], pa.list_(pa.string())), pa.array([out.text]), pa.array([_spans(out.turns)], pa.list_(span)), pa.array([_spans(out.texts)], pa.list_(span)), pa.array([_spans(out.loss_spans(roles))], pa.list_(span)), pa.array([out.lost(turns)]), pa.array([out.rewrites])],
                ["conv_id", "roles", "formatted", "turns", "texts", "loss", "lost", "rewrites"],
            )

    spans = "array<struct<start:long,end:long>>"
    return _ordered(conversations).mapInArrow(rows, f"conv_id long, roles array<string>, formatted string, turns {spans}, texts {spans}, loss {spans}, lost long, rewrites boolean")


def chat_digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from format_chats(): conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewrites."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, text, loss, rewrites in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss", "rewrites"))):
                turns = read_back(text)
                said = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                out.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), len(text), rewrites))
            columns = list(zip(*out)) if out else [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"])

    return formatted.select("conv_id", "formatted", "loss", "rewrites").mapInArrow(rows, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean")
