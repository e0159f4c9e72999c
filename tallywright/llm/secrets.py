"""Secret scans: all rules in one automaton, one pass over the bytes of a text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallywright.llm.automaton import Automaton
from tallywright.llm.common import ROW, with_text


class Rule(NamedTuple):
    """``least``: characters that the last, open-ended part of a match must have; shorter matches are dropped."""

    kind: str
    pattern: str
    any_case: bool = False
    least: int = 1


#: The base rules of the contract, in its order. ``least`` is checked after the match, as a match
#: too short still takes its place. Only for ``hex``, where short matches are everywhere, the length is part of
#: the pattern: the whole match is one class, so that a run of it is a match or is not.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", True, 8),
    Rule("access", r"AKIA[A-Z0-9]+", least=12),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: Public token formats.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", least=36),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=8),
)
RULES = BASE_RULES + MORE_RULES


@cache
def compiled(rules: tuple[Rule, ...]) -> tuple[Automaton, list[Automaton]]:
    """The automaton of all rules, and one for each rule that reads a match backwards to find its start."""
    whole = Automaton([(r.pattern, r.any_case) for r in rules])
    return whole, [Automaton([(r.pattern, r.any_case)], search=False, backwards=True) for r in rules]


def _start_of(back: Automaton, data: bytes, end: int, floor: int) -> int:
    """Leftmost start, not before ``floor``, of a match that ends at ``end``."""
    state, found = back.start, end
    for i in range(end - 1, floor - 1, -1):
        state = back.table[state + back.symbols[data[i]]]
        if back.dead[state // back.width]:
            break
        if state >= back.quiet:
            found = i
    return found


def scan(data: bytes, rules: tuple[Rule, ...] = RULES, automata: tuple[Automaton, list[Automaton]] | None = None) -> list[tuple[int, int, int]]:
    """(start, rule, end) in bytes of all kept matches: leftmost, not overlapping within a rule.

    A match of a rule lasts from the byte where the rule first accepts while it goes on accepting. When it
    ends, that rule alone starts afresh there; the others go on. This equals a leftmost greedy search for
    rules whose last part is a repeated class, or that end in a fixed text.
    """
    whole, backs = automata or compiled(rules)
    table, width, quiet, accepts, state = whole.table, whole.width, whole.quiet, whole.accepts, whole.start
    found: list[tuple[int, int, int]] = []
    floors, begun, open_bits = [0] * len(rules), [0] * len(rules), 0

    def close(bits: int, end: int) -> None:
        for k in range(len(rules)):
            if bits >> k & 1:
                first_end = begun[k]
                start = _start_of(backs[k], data, first_end + 1, floors[k])
                if end - first_end >= rules[k].least:
                    found.append((start, k, end))
                floors[k] = end

    limit, before = quiet, state  # while a match is open every byte is looked at
    for at, symbol in enumerate(data.translate(whole.symbols)):
        state = table[state + symbol]
        if state < limit:
            continue
        ended = open_bits & ~accepts[state // width]
        if ended:
            close(ended, at)
            for k in range(len(rules)):
                if ended >> k & 1:
                    before = table[before + whole.reset + k]
            open_bits &= ~ended
            state = table[before + symbol]
        fresh = accepts[state // width] & ~open_bits
        for k in range(len(rules)):
            if fresh >> k & 1:
                begun[k] = at
        open_bits |= fresh
        limit, before = (-1 if open_bits else quiet), state
    close(open_bits, len(data))
    found.sort()
    return found


def in_characters(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same spans counted in code points."""
    if data.isascii():
        return spans
    out, at, chars = [], 0, 0
    for start, kind, end in spans:
        chars += len(data[at:start].decode("utf-8", "replace")) if start >= at else -len(data[start:at].decode("utf-8", "replace"))
        at = start
        out.append((chars, kind, chars + len(data[start:end].decode("utf-8", "replace"))))
    return out


def _scan_batches(rules: tuple[Rule, ...]):
    automata = compiled(rules)  # once on the driver; tasks get the tables
    kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for value in batch.column(1):
                data = value.as_py() or b""
                spans = in_characters(data, scan(data, rules, automata))
                found.append([{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind_of)], names=[ROW, "spans"])

    return run


def find_secrets(docs: DataFrame, keep: list[str], text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Columns ``keep`` packed as ``_row``, and spans: array of (kind, start, end) in code points, by start and rule.

    Null and empty texts have no spans; texts of any length are read whole; equal rows give equal results; an
    empty table gives an empty result. Only the text and ``keep`` leave the scan, so further columns don't matter.
    """
    packed = with_text(docs, keep, text_col).withColumn("data", F.col("data").cast("binary"))
    inner = packed.schema[ROW].dataType.simpleString()
    return packed.mapInArrow(_scan_batches(tuple(rules)), f"{ROW} {inner}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def span_text(spans):
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
