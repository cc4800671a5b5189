"""Scrubbing: rewriting the string columns of a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.catalog import PATTERN_TYPES, parse_types
from ..functions.exprs import let
from ..functions.spans import cells_spans_sql, free_name, merge_spans_sql, quoted, spans_sql
from ..functions.splice import scrub_sql, scrub_text, splice, splice_sql, swap_sql
from .detect import SEPARATE_COLUMNS, text_columns


def scrub(
    df: DataFrame, columns=None, types=None, method: str = "mask", salt: str = "", row_key: str | None = None
) -> DataFrame:
    """Same schema and rows, with findings replaced in the scanned columns.

    One projection: no shuffle, row order within partitions kept, columns that
    are not scanned pass through and stay prunable.
    """
    names = text_columns(df, columns)
    if len(names) <= SEPARATE_COLUMNS:
        return df.withColumns({c: scrub_text(c, types, method, salt, row_key) for c in names})
    cells = ", ".join(quoted(c) for c in names)
    key = quoted(row_key) if row_key else None
    each = scrub_sql("cell", parse_types(types), method, salt, key)
    done = free_name(df.columns, "_scrubbed")
    packed = df.withColumn(done, F.expr(f"transform(array({cells}), cell -> {each})"))
    at = {c: i for i, c in enumerate(names)}
    return packed.select(
        *[F.col(done)[at[c]].alias(c) if c in at else F.col(quoted(c)) for c in df.columns]
    )


def scrub_marked(
    df: DataFrame,
    columns=None,
    types=None,
    method: str = "mask",
    salt: str = "",
    row_key: str | None = None,
    mark: str = "pii",
) -> DataFrame:
    """:func:`scrub` plus a per-row mark column, detecting once for both.

    The mark is ``STRUCT<found INT, cells INT, by_type ARRAY<INT>>``: spans in
    the row, cells holding at least one, and spans per requested type. Statistics
    over the marks need no second detection pass (see ``operators.stats``).
    """
    names = text_columns(df, columns)
    chosen = parse_types(types)
    key = quoted(row_key) if row_key else None
    cells = ", ".join(quoted(c) for c in names)
    found = cells_spans_sql(names, chosen)
    done = free_name(df.columns, "_scrubbed")
    packed = df.withColumn(done, F.expr(_marked_sql(f"array({cells})", found, chosen, method, salt, key)))
    at = {c: i for i, c in enumerate(names)}
    return packed.select(
        *[F.col(done)["texts"][at[c]].alias(c) if c in at else F.col(quoted(c)) for c in df.columns],
        F.col(done)["mark"].alias(mark),
    )


def _marked_sql(texts: str, found: str, types, method: str, salt: str, row_key: str | None, model=False) -> str:
    """SQL text of ``STRUCT<texts, mark>`` for an array of texts and its array of span arrays."""
    swapped_types = [t for t in types if model or t in PATTERN_TYPES]
    spliced = let("src", "texts[n]", splice_sql("src", "hit", swap_sql(swapped_types, method, salt, row_key)))
    swapped = f"transform(found, (hit, n) -> if(texts[n] is null, cast(null as string), {spliced}))"
    # Model spans carry ords past the pattern types; they are folded back for counting.
    folded = f"transform(found, l -> transform(l, s -> named_struct('ord', s.ord % {len(types)})))"
    body = f"named_struct('texts', {swapped}, 'mark', {mark_sql(folded, len(types))})"
    return let("texts", texts, let("found", found, body))


def scrub_cells(
    df: DataFrame,
    cells: str = "cells",
    types=None,
    method: str = "mask",
    salt: str = "",
    model_spans: str | None = None,
    mark: str = "pii",
) -> DataFrame:
    """:func:`scrub_marked` for rows that hold their cells in one array column.

    ``model_spans`` names a column of per-cell span arrays to merge in.
    """
    chosen = parse_types(types)
    found = spans_sql("cell", chosen)
    if model_spans:
        found = merge_spans_sql(found, f"{quoted(model_spans)}[n]")
    listed = f"transform({quoted(cells)}, (cell, n) -> {found})"
    whole = _marked_sql(quoted(cells), listed, chosen, method, salt, None, model=model_spans is not None)
    done = free_name(df.columns, "_scrubbed")
    packed = df.withColumn(done, F.expr(whole))
    kept = [F.col(done)["texts"].alias(c) if c == cells else F.col(quoted(c)) for c in df.columns]
    return packed.select(*kept, F.col(done)["mark"].alias(mark))


def mark_sql(span_lists: str, n_types: int) -> str:
    """SQL text of a row's mark from an array of span arrays."""
    per_type = let(
        "ords",
        "flatten(transform(sp, c -> transform(c, s -> s.ord)))",
        f"if(size(ords) = 0, array_repeat(0, {n_types}), "
        f"transform(sequence(0, {n_types - 1}), k -> size(filter(ords, o -> o = k))))",
    )
    return let(
        "sp",
        span_lists,
        "named_struct('found', aggregate(sp, 0, (n, c) -> n + size(c)), "
        f"'cells', size(filter(sp, c -> size(c) > 0)), 'by_type', {per_type})",
    )


def scrub_detected(
    df: DataFrame,
    columns: list[str],
    types=None,
    method: str = "mask",
    salt: str = "",
    row_key: str | None = None,
    suffix: str = "_spans",
    mark: str = "pii",
) -> DataFrame:
    """Like :func:`scrub_marked` for spans that are columns already (``detect``, ``detect_with_model``)."""
    chosen = parse_types(types)
    lists = "array(" + ", ".join(quoted(f"{c}{suffix}") for c in columns) + ")"
    # Model spans carry ords past the pattern types; fold them back for counting.
    folded = f"transform({lists}, l -> transform(l, s -> named_struct('ord', s.ord % {len(chosen)})))"
    counts = {mark: F.expr(mark_sql(folded, len(chosen)))}
    texts = {c: splice(c, f"{c}{suffix}", method, salt, row_key) for c in columns}
    return df.withColumns(texts | counts).drop(*[f"{c}{suffix}" for c in columns])


def scrub_names(df: DataFrame, types=None, method: str = "mask", salt: str = "") -> tuple[DataFrame, int]:
    """Scrub personal data out of column names.

    Returns the renamed DataFrame and the number of findings in the names. Runs
    over one row per column, so its size is the width of the schema. Names that
    become equal get a numeric suffix.
    """
    spark = df.sparkSession
    names = spark.createDataFrame(list(enumerate(df.columns)), "pos int, name string")
    marked = scrub_marked(names, ["name"], types, method, salt).orderBy("pos").collect()
    seen: dict[str, int] = {}
    fresh = []
    for row in marked:
        seen[row.name] = seen.get(row.name, 0) + 1
        fresh.append(row.name if seen[row.name] == 1 else f"{row.name}_{seen[row.name]}")
    return df.toDF(*fresh), sum(row.pii.found for row in marked)
