"""Rebuilding a text around its spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .catalog import ALL_TYPES, PATTERN_TYPES, parse_types
from .exprs import let
from .replace import replacement_sql
from .spans import quoted, spans_sql

# Spans cut from one chunk of the text. substring counts characters from the left, so
# cutting every span from the whole text would rescan it once per span.
CHUNK_SPANS = 256


def splice_sql(text: str, spans: str, replacement: str) -> str:
    """SQL text of ``text`` with every span replaced.

    ``text`` and ``spans`` are variable names; ``replacement`` is SQL text over
    the span ``s``. Spans are sorted and disjoint.
    """
    piece = (
        f"concat(substring(chunk, if(i = 0, 1, grp[i - 1].end - chunk_at + 1), "
        f"s.start - if(i = 0, chunk_at, grp[i - 1].end)), {replacement})"
    )
    pieces = f"array_join(transform(grp, (s, i) -> {piece}), '')"
    chunk = f"substring({text}, chunk_at + 1, element_at(grp, -1).end - chunk_at)"
    start = f"if(g = 0, 0, {spans}[g * {CHUNK_SPANS} - 1].end)"
    group = let(
        "grp",
        f"slice({spans}, g * {CHUNK_SPANS} + 1, {CHUNK_SPANS})",
        let("chunk_at", start, let("chunk", chunk, pieces)),
    )
    body = f"array_join(transform(sequence(0, (size({spans}) - 1) div {CHUNK_SPANS}), g -> {group}), '')"
    tail = f"substring({text}, element_at({spans}, -1).end + 1)"
    return f"if(size({spans}) = 0, {text}, concat({body}, {tail}))"


def scrub_sql(text: str, types, method: str = "mask", salt: str = "", row_key: str | None = None) -> str:
    """SQL text that detects and replaces in one expression (pattern types)."""
    swap = swap_sql([t for t in types if t in PATTERN_TYPES], method, salt, row_key)
    body = let("found", spans_sql("src", types), splice_sql("src", "found", swap))
    return f"if({text} is null, cast(null as string), {let('src', text, body)})"


def swap_sql(types, method: str, salt: str, row_key: str | None) -> str:
    occurrence = f"concat_ws('|', cast({row_key} as string), cast(s.start as string))" if row_key else None
    return replacement_sql("s.pii_type", "s.value", types, method, salt, occurrence)


def scrub_text(column: str, types=None, method: str = "mask", salt: str = "", row_key: str | None = None) -> Column:
    """A string column with its pattern-type findings replaced.

    Stand-ins depend on the value alone; name a ``row_key`` column to make them
    depend on the occurrence (row and offset) as well.
    """
    key = quoted(row_key) if row_key else None
    return F.expr(scrub_sql(quoted(column), parse_types(types), method, salt, key)).alias(column)


def splice(
    column: str, spans: str, method: str = "mask", salt: str = "", row_key: str | None = None, types=ALL_TYPES
) -> Column:
    """A string column with the spans of another column replaced."""
    key = quoted(row_key) if row_key else None
    body = splice_sql("src", "found", swap_sql(types, method, salt, key))
    text, found = quoted(column), quoted(spans)
    known = f"coalesce({found}, cast(array() as array<struct<start:int,end:int,ord:int,pii_type:string,value:string>>))"
    body = let("src", text, let("found", known, body))
    return F.expr(f"if({text} is null, cast(null as string), {body})").alias(column)
