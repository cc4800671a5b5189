"""Detection over the string columns of a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.catalog import parse_types
from ..functions.spans import cells_spans_sql, find_spans, free_name, quoted


SPAN_FIELDS = ("start", "end", "ord", "pii_type", "value")

# Up to this many columns, each gets an expression of its own.
SEPARATE_COLUMNS = 3


def text_columns(df: DataFrame, columns=None) -> list[str]:
    """The columns to scan: the named ones, or every string column."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if columns is None:
        return strings
    wrong = [c for c in columns if c not in strings]
    if wrong:
        raise ValueError(f"not string columns of the input: {wrong}")
    return list(columns)


def as_text(df: DataFrame, columns=None) -> DataFrame:
    """Cast columns (default: all) to string, NULL becoming the empty string."""
    chosen = set(df.columns if columns is None else columns)
    return df.select(
        *[
            F.coalesce(F.col(quoted(c)).cast("string"), F.lit("")).alias(c) if c in chosen else F.col(quoted(c))
            for c in df.columns
        ]
    )


def detect(df: DataFrame, columns=None, types=None, suffix: str = "_spans") -> DataFrame:
    """Add one array-of-spans column per scanned column.

    A narrow map: each row is scanned where it lies. Up to ``SEPARATE_COLUMNS``
    columns get an expression each and stay prunable; wider tables state it once.
    """
    names = text_columns(df, columns)
    if len(names) <= SEPARATE_COLUMNS:
        return df.withColumns({f"{c}{suffix}": find_spans(c, types) for c in names})
    cells = free_name(df.columns, "_cells")
    every = df.withColumn(cells, F.expr(cells_spans_sql(names, parse_types(types))))
    spans = [F.col(cells)[i].alias(f"{c}{suffix}") for i, c in enumerate(names)]
    return every.select(*[F.col(quoted(c)) for c in df.columns], *spans)


def explode_spans(df: DataFrame, spans: dict[str, str | Column], keys=()) -> DataFrame:
    """Spans as rows: ``keys``, column, start, end, ord, pii_type, value.

    ``spans`` maps a reported column name to its spans column. The outer
    explode keeps Spark from inferring a size filter, which would push the
    span expression below the projection and evaluate it a second time.
    """
    kept = [F.col(quoted(k)) for k in keys]
    columns = {c: s if isinstance(s, Column) else F.col(quoted(s)) for c, s in spans.items()}
    if len(columns) == 1:
        ((name, column),) = columns.items()
        rows = df.select(*kept, F.explode_outer(column).alias("_found"))
        found = [F.lit(name).alias("column"), *[F.col(f"_found.{x}") for x in SPAN_FIELDS]]
        return rows.where("_found.start is not null").select(*kept, *found)

    def tag(name: str, column: Column) -> Column:
        return F.transform(column, lambda x: F.struct(F.lit(name).alias("column"), *[x[f].alias(f) for f in SPAN_FIELDS]))

    tagged = F.concat(*[tag(c, s) for c, s in columns.items()])
    rows = df.select(*kept, F.explode_outer(tagged).alias("_found"))
    return rows.where("_found.start is not null").select(*kept, "_found.*")


def findings(df: DataFrame, columns=None, types=None, keys=()) -> DataFrame:
    """The audit table: every resolved span as a row, with the key columns."""
    names = text_columns(df, columns)
    if len(names) == 1:
        return explode_spans(df, {names[0]: find_spans(names[0], types)}, keys)
    kept = [F.col(quoted(k)) for k in keys]
    # Cells are told apart by their place, so spans go from the scan into rows as they are.
    at, cell = (free_name([*df.columns, *keys], x) for x in ("_at", "_cell"))
    cells = df.select(*kept, F.posexplode_outer(F.expr(cells_spans_sql(names, parse_types(types)))).alias(at, cell))
    rows = cells.select(*kept, at, F.explode_outer(cell).alias("_found")).where("_found.start is not null")
    name = F.array(*[F.lit(c) for c in names])[F.col(at)].alias("column")
    return rows.select(*kept, name, *[F.col(f"_found.{x}") for x in SPAN_FIELDS])
