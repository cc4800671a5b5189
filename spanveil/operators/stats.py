"""Counts over findings.

All counts come from per-row marks that Spark sums with map-side partial
aggregation, so a file or column holding a third of the data sends one partial
row per task through the shuffle, not its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.catalog import display_name, parse_types
from ..functions.exprs import let
from ..functions.spans import cells_spans_sql
from .detect import findings, text_columns
from .scrub import mark_sql


def mark_rows(df: DataFrame, columns=None, types=None, mark: str = "pii") -> DataFrame:
    """Add the per-row mark (found, cells, by_type) without scrubbing."""
    names = text_columns(df, columns)
    chosen = parse_types(types)
    return df.withColumn(mark, F.expr(mark_sql(cells_spans_sql(names, chosen), len(chosen))))


def totals_of_marks(df: DataFrame, by=(), mark: str = "pii", extra=()) -> DataFrame:
    """pii_found, rows_processed, rows_affected, cells_affected over marked rows.

    ``extra`` aggregates are computed in the same pass.
    """
    m = F.col(mark)
    return df.groupBy(*by).agg(
        *extra,
        F.coalesce(F.sum(m["found"]), F.lit(0)).alias("pii_found"),
        F.count(F.lit(1)).alias("rows_processed"),
        F.count_if(m["found"] > 0).alias("rows_affected"),
        F.coalesce(F.sum(m["cells"]), F.lit(0)).alias("cells_affected"),
    )


def totals_of_tables(df: DataFrame, head: str, by=(), mark: str = "pii", extra=()) -> DataFrame:
    """:func:`totals_of_marks` for tables whose header is a row, marked by the column ``head``.

    A header's findings count as found; it is no processed or affected row. A table of a header alone has a row too.
    """
    m, body = F.col(mark), ~F.col(head)
    return df.groupBy(*by).agg(
        *extra,
        F.coalesce(F.sum(m["found"]), F.lit(0)).alias("pii_found"),
        F.count_if(body).alias("rows_processed"),
        F.count_if(body & (m["found"] > 0)).alias("rows_affected"),
        F.coalesce(F.sum(F.when(body, m["cells"])), F.lit(0)).alias("cells_affected"),
    )


def types_of_marks(df: DataFrame, types=None, by=(), mark: str = "pii") -> DataFrame:
    """Spans per type over marked rows, in long form (``by``, pii_type, n > 0)."""
    chosen = parse_types(types)
    sums = [F.sum(F.col(mark)["by_type"][i]).alias(f"n{i}") for i in range(len(chosen))]
    wide = df.groupBy(*by).agg(*sums)
    pairs = F.array(
        *[
            F.struct(F.lit(display_name(t)).alias("pii_type"), F.coalesce(F.col(f"n{i}"), F.lit(0)).alias("n"))
            for i, t in enumerate(chosen)
        ]
    )
    return wide.select(*by, F.inline(F.filter(pairs, lambda p: p["n"] > 0)))


def stats(df: DataFrame, columns=None, types=None, by=()) -> DataFrame:
    """Totals per group (or one row): found, rows processed, rows and cells affected."""
    rows = df.select(*by, *_scanned(df, columns, by))
    # Totals need the spans' numbers alone, one for each cell.
    sizes = f"transform({cells_spans_sql(_names(df, columns, by), parse_types(types))}, c -> size(c))"
    mark = let("n", sizes, "named_struct('found', aggregate(n, 0, (a, x) -> a + x), 'cells', size(filter(n, x -> x > 0)))")
    return totals_of_marks(rows.withColumn("pii", F.expr(mark)), by)


def type_counts(df: DataFrame, columns=None, types=None, by=()) -> DataFrame:
    """Spans per type and group, in long form."""
    marked = mark_rows(df.select(*by, *_scanned(df, columns, by)), _names(df, columns, by), types)
    return types_of_marks(marked, types, by)


def _names(df: DataFrame, columns, by) -> list[str]:
    return [c for c in text_columns(df, columns) if columns is not None or c not in by]


def _scanned(df: DataFrame, columns, by) -> list[str]:
    return [c for c in _names(df, columns, by) if c not in by]


def profile(df: DataFrame, columns=None, types=None) -> DataFrame:
    """Which column holds what: spans and distinct values per column and type."""
    found = findings(df, columns, types)
    return found.groupBy("column", "pii_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("n_values")
    )


# Sketches of 2^12 counters: a relative standard error of about 1.6 %, at most some kilobytes for each column and type.
SKETCH_BITS = 12


def profile_sketches(df: DataFrame, columns=None, types=None, by=()) -> DataFrame:
    """:func:`profile` in a form that can be added up later: ``by``, column, pii_type, n and a sketch of the values.

    Unlike exact distinct counts, sketches are built in each task, so values are never shuffled.
    """
    found = findings(df, columns, types, keys=by)
    return found.groupBy(*by, "column", "pii_type").agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("value", SKETCH_BITS).alias("sketch")
    )


def merge_profiles(sketches: DataFrame, by=()) -> DataFrame:
    """``by``, column, pii_type, n and an estimate of n_values over everything that was sketched."""
    return sketches.groupBy(*by, "column", "pii_type").agg(
        F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_values")
    )


def save_profile(df: DataFrame, path: str, run: str, columns=None, types=None) -> None:
    """Keep the sketches of one run under its name; a run that is repeated replaces its own."""
    if not run or "/" in run or "=" in run:
        raise ValueError(f"no name for a run: {run!r}")
    profile_sketches(df, columns, types).write.mode("overwrite").parquet(f"{path}/run={run}")


def saved_profile(spark: SparkSession, path: str) -> DataFrame:
    """:func:`merge_profiles` of all saved runs; reads sketches, no data."""
    return merge_profiles(spark.read.option("basePath", path).parquet(f"{path}/run=*"))


def batch_totals(per_file: DataFrame, file: str = "file") -> DataFrame:
    """Per-file totals plus one grand-total row (file NULL)."""
    return per_file.rollup(file).agg(
        F.sum("pii_found").alias("pii_found"),
        F.sum("rows_affected").alias("rows_affected"),
        F.count_if(F.col("success")).alias("files_ok"),
        F.count(F.lit(1)).alias("files"),
    )
