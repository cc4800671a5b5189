"""Finding, ordering and resolving spans, as one expression over a string.

A span is ``STRUCT<start, end, ord, pii_type, value>``: zero-based character
offsets (end exclusive), the position of its type in the requested list, the
type's display name and the matched text. One expression per column keeps
detection a narrow map: no shuffle, no Python, no second pass over the data.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .catalog import PATTERN_TYPES, display_name, parse_types
from .exprs import kept_greedily, let, running_scan, sql_str
from .patterns import CODE_MARK, DIGIT_MARK, EMAIL_MARK, GATE_OF, LONG_MARK, PAIR_MARK, PATTERNS, RUN_MARK
from .validators import VALID_SQL, valid_once

SPAN_TYPE = "struct<start:int,end:int,ord:int,pii_type:string,value:string>"
SPANS_TYPE = f"array<{SPAN_TYPE}>"
_RAW_TYPE = "struct<start:int,ord:int,end:int,value:string>"
_NO_RAW = f"cast(array() as array<{_RAW_TYPE}>)"
_NO_SPANS = f"cast(array() as {SPANS_TYPE})"


# Set around every hit so that a plain split yields gap, hit, gap, ..., gap after one
# scan with a cached pattern. A text that holds the mark itself takes the other way.
_MARK = "\\u0001"


def _hits(types: dict[str, int]) -> str:
    """The hits of all types, a type after the other; a type without any costs its scan and a look for the mark."""
    marked = ", ".join(
        f"if({GATE_OF[t]}, regexp_replace(txt, {sql_str(PATTERNS[t])}, '{_MARK}$0{_MARK}'), '')" for t in types
    )
    listed = f"array({', '.join(sql_str(PATTERNS[t]) for t in types)})"
    woven = (
        "if(size(hits) = 0, array(txt), concat(flatten(zip_with(slice(gaps, 1, size(hits)), hits, "
        "(gap, hit) -> array(gap, hit))), array(element_at(gaps, -1))))"
    )
    woven = let("hits", "regexp_extract_all(txt, pat, 0)", let("gaps", "split(txt, pat, -1)", woven))
    cut = f"if(holds_mark, {let('pat', f'{listed}[t]', woven)}, split(marked[t], '{_MARK}', -1))"
    found = let("cut", cut, f"if(size(cut) > 1, {_positions(f'array({_listed(types.values())})[t]')}, {_NO_RAW})")
    with_hits = f"filter(array({_listed(range(len(types)))}), t -> holds_mark or contains(marked[t], '{_MARK}'))"
    raw = let("marked", f"array({marked})", f"flatten(transform({with_hits}, t -> {found}))")
    return let("holds_mark", f"contains(txt, '{_MARK}')", raw)


def _listed(numbers) -> str:
    return ", ".join(map(str, numbers))


# Pieces whose places are added up anew for every hit; more are added up in one running sum.
FEW_PIECES = 15


def _positions(ord_: str) -> str:
    """Offsets of the hits in ``cut`` (gap, hit, gap, ..., gap): a piece starts after all earlier ones."""
    starts = running_scan("widths", state="0", next_state="acc.s + x", emit="acc.s")
    hits = "sequence(1, size(cut) - 2, 2)"
    hit = f"named_struct('start', {{at}}, 'ord', {ord_}, 'end', {{at}} + widths[k], 'value', cut[k])"
    one = (
        f"array(named_struct('start', length(cut[0]), 'ord', {ord_}, "
        "'end', length(cut[0]) + length(cut[1]), 'value', cut[1]))"
    )
    summed = let("start_at", "aggregate(slice(widths, 1, k), 0, (n, x) -> n + x)", hit.format(at="start_at"))
    few = f"transform({hits}, k -> {summed})"
    many = let("starts", starts, f"transform({hits}, k -> {hit.format(at='starts[k]')})")
    several = let("widths", "transform(cut, c -> length(c))", f"if(size(cut) <= {FEW_PIECES}, {few}, {many})")
    return f"if(size(cut) = 3, {one}, {several})"


def _validated(raw: str, order: dict[str, int]) -> str:
    checks = [f"when {order[t]} then {valid_once(t, 'c.value')}" for t in VALID_SQL if t in order]
    return f"filter({raw}, c -> case c.ord {' '.join(checks)} else true end)" if checks else raw


def _resolved(raw: str) -> str:
    """Greedy choice: sorted by start, then type order, a span stays if it
    starts at or after the end of the last kept one (earliest wins, not longest)."""
    return let("sorted", f"sort_array({raw})", kept_greedily("sorted"))


def _named(raw: str, names: list[str]) -> str:
    labels = "array(" + ", ".join(sql_str(n) for n in names) + ")"
    return (
        f"transform({raw}, r -> named_struct('start', r.start, 'end', r.end, 'ord', r.ord, "
        f"'pii_type', element_at({labels}, r.ord + 1), 'value', r.value))"
    )


def spans_sql(text: str, types, resolve: bool = True) -> str:
    """SQL text of the pattern spans of ``text`` (a column or SQL expression)."""
    order = {t: i for i, t in enumerate(types) if t in PATTERN_TYPES}
    if not order:
        return _NO_SPANS
    raw = _validated(_hits(order), order)
    done = let("raw", raw, f"if(size(raw) < 2, raw, {_resolved('raw')})") if resolve else f"sort_array({raw})"
    gates = dict.fromkeys(GATE_OF[t] for t in order)
    body = f"if({' or '.join(gates)}, {_named(done, [display_name(t) for t in types])}, {_NO_SPANS})"
    for gate, mark in (("has_long", LONG_MARK), ("has_code", CODE_MARK)):
        if gate in gates:
            body = let(gate, f"has_run and txt rlike {sql_str(mark)}", body)
    if "has_long" in gates or "has_code" in gates:
        body = let("has_run", f"has_digit and txt rlike {sql_str(RUN_MARK)}", body)
    if "has_pair" in gates:
        body = let("has_pair", f"has_digit and txt rlike {sql_str(PAIR_MARK)}", body)
    if gates.keys() - {"has_at"}:
        body = let("has_digit", f"txt rlike {sql_str(DIGIT_MARK)}", body)
    if "has_at" in gates:
        body = let("has_at", f"contains(txt, '{EMAIL_MARK}')", body)
    return let("txt", f"coalesce({text}, '')", body)


def free_name(taken, base: str) -> str:
    """``base``, lengthened until no column of ``taken`` has the name (in any case of letters)."""
    lowered = {c.lower() for c in taken}
    while base.lower() in lowered:
        base += "_"
    return base


def quoted(column: str) -> str:
    """A column name as SQL text."""
    return "`" + column.replace("`", "``") + "`"


def merge_spans_sql(first: str, second: str) -> str:
    """SQL text of two span arrays merged, sorted by start and resolved again."""
    ordered = (
        f"transform(array_sort(transform(concat({first}, {second}), r -> named_struct("
        "'start', r.start, 'ord', r.ord, 'r', r))), w -> w.r)"
    )
    return let("both", ordered, f"if(size(both) < 2, both, {kept_greedily('both')})")


def cells_spans_sql(columns, types) -> str:
    """SQL text of the spans of several columns: an array of span arrays.

    The span expression is stated once and mapped over the row's cells, so
    planning and generated code do not grow with the number of columns.
    """
    cells = ", ".join(quoted(c) for c in columns)
    return f"transform(array({cells}), cell -> {spans_sql('cell', types)})"


def find_spans(column: str, types=None) -> Column:
    """Resolved pattern spans of a string column, as an array of structs.

    The order of ``types`` decides ties between spans with the same start.
    NULL text has no spans.
    """
    return F.expr(spans_sql(quoted(column), parse_types(types))).alias(f"{column}_spans")


def candidate_spans(column: str, types=None) -> Column:
    """Every validated match, overlaps included, sorted by start and type order."""
    return F.expr(spans_sql(quoted(column), parse_types(types), resolve=False)).alias(f"{column}_spans")
