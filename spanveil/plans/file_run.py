"""Files in, scrubbed files and a report out, in one call."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.catalog import TypeNotAllowed, parse_types
from ..functions.naming import base_name, file_kind, output_name, preview
from ..operators.limits import UNLIMITED, Quota, cell_error, row_error, validate_files
from ..operators.model import detect_with_model, model_cell_spans
from ..operators.scrub import scrub_cells, scrub_detected, scrub_marked
from ..operators.stats import totals_of_marks, totals_of_tables, types_of_marks
from ..sources.files import AT, FILE, list_files, read_csv_records, read_lines, read_texts
from ..sources.manifest import write_manifest
from ..sources.sinks import csv_array_record, preview_records, write_lines
from ..sources.workbook import read_workbooks
from ..sources.workspace import small_side, staged

# Column of a row's model failure on its way to the report.
MODEL_ERROR = "_model_error"


@dataclass
class FileScrub:
    """Scrubbed rows by shape, and one report row per file.

    ``tables`` and ``workbooks`` hold each record in ``cells``, headers included.
    """

    tables: DataFrame | None
    workbooks: DataFrame | None
    texts: DataFrame | None
    lines: DataFrame | None
    report: DataFrame
    type_report: DataFrame

    def save_successful(self, path: str) -> None:
        """Write the files that succeeded, one folder per output file; its parts, by name, are in file order.

        ``of`` tells files of equal names in different folders apart.
        """
        good = small_side(self.report.where("success").select(FILE))
        kept = lambda rows: rows.join(good, FILE, "left_semi").withColumn("of", _folder_tag(FILE))
        if self.tables is not None:
            rows = _in_order(kept(self.tables), AT).withColumn("line", csv_array_record("cells"))
            write_lines(rows, f"{path}/tables", partition_by=["of", "out_file"])
        if self.workbooks is not None:
            rows = _in_order(kept(self.workbooks), "row_idx").withColumn("line", csv_array_record("cells"))
            write_lines(rows, f"{path}/workbooks", partition_by=["of", "out_file"])
        if self.texts is not None:
            write_lines(kept(self.texts), f"{path}/texts", "text", partition_by=["of", "out_file"])
        if self.lines is not None:
            write_lines(_in_order(kept(self.lines), AT), f"{path}/lines", partition_by=["of", "out_file"])

    def save_with_manifest(self, path: str) -> None:
        """:meth:`save_successful`, then the manifest of what was written, which makes the output whole."""
        self.save_successful(path)
        shapes = {"tables": self.tables, "workbooks": self.workbooks, "texts": self.texts, "lines": self.lines}
        write_manifest(self.report.sparkSession, path, [k for k, rows in shapes.items() if rows is not None])


def _folder_tag(file: str) -> Column:
    return F.substring(F.sha2(F.regexp_replace(file, "[^/]*$", ""), 256), 1, 8)


def _in_order(rows: DataFrame, at: str) -> DataFrame:
    """Rows dealt out by ranges of file and position, and sorted, so that parts follow one another.

    No number of parts is given, so that adaptive execution joins small neighbours.
    """
    return rows.repartitionByRange("of", "out_file", at).sortWithinPartitions("of", "out_file", at)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def scrub_files(
    spark: SparkSession,
    paths: list[str],
    types=None,
    method: str = "mask",
    salt: str = "",
    quota: Quota = UNLIMITED,
    text_mode: str = "document",
    factory=None,
    model_errors: str = "fail",
    multiline: bool = True,
    check_cells: bool = False,
    stage: bool = True,
) -> FileScrub:
    """Scrub the CSV, XLSX, text and JSON files among ``paths``: files, folders at any depth, globs.

    The listing decides: each file found is read by its own kind (unknown kinds are text) and has one report row. All
    CSV files are one scan, whatever their headers; a header is scrubbed and counted like its file's other records, by
    the model too, and written first, so a file of a header alone is found and written. ``text_mode`` says whether text
    and JSON files are scrubbed whole (``document``) or line by line (``line``); it holds for every file of the run,
    whatever its size. A model that fails on a row of a file fails the file; with ``model_errors="warn"`` the file
    counts as successful and its ``warning`` says so. A file over a quota, of a kind that cannot be read (``xls``) or
    with records of another width than its header fails alone: its report row has the error, and ``save_successful``
    leaves it out. Scrubbed rows are written once to the shared folder, from which report and output are made;
    ``stage=False`` keeps everything lazy and scrubs again for each of them.
    """
    if text_mode not in ("document", "line"):
        raise ValueError("text_mode must be document or line")
    if model_errors not in ("fail", "warn"):
        raise ValueError("model_errors must be fail or warn")
    files = list_files(spark, paths)
    status = validate_files(files.drop("kind"), quota)
    unreadable = F.when(file_kind(FILE) == "xls", F.lit("Legacy XLS workbooks cannot be read; save the file as XLSX"))
    status = status.withColumn("error", F.coalesce("error", unreadable)).withColumn("success", F.col("error").isNull())
    try:
        chosen = parse_types(types, quota.allowed_types)
    except TypeNotAllowed as exc:
        status = status.withColumns({"success": F.lit(False), "error": F.coalesce("error", F.lit(str(exc)))})
        return _nothing(status)

    def scrubbed(df: DataFrame, columns: list[str]) -> DataFrame:
        if factory is None:
            done = scrub_marked(df, columns, chosen, method, salt).withColumn(MODEL_ERROR, F.lit(None).cast("string"))
        else:
            unit = "cell" if len(columns) == 1 else "row"
            found = detect_with_model(df, factory, columns, chosen, unit, error=MODEL_ERROR)
            done = scrub_detected(found, columns, chosen, method, salt)
        done = done.withColumn("out_file", output_name(FILE))
        return staged(done, "scrubbed") if stage else done

    if quota.max_files is not None and files.count() > quota.max_files:
        return _nothing(status)
    kinds = {r["kind"] for r in files.select("kind").distinct().collect()}  # five at most
    tables = books = texts = lines = None
    totals, type_parts = [], []
    no_preview = F.lit(None).cast("string")

    def account(per_file: DataFrame, rows: DataFrame, previews: DataFrame | None = None) -> None:
        totals.append(per_file if previews is None else per_file.drop("preview").join(previews, FILE, "left"))
        type_parts.append(types_of_marks(rows, chosen, [FILE]))

    def cells_scrubbed(rows: DataFrame) -> DataFrame:
        found = None
        if factory is not None:
            rows, found = model_cell_spans(rows, factory, "cells", chosen, error=MODEL_ERROR), "_model"
        else:
            rows = rows.withColumn(MODEL_ERROR, F.lit(None).cast("string"))
        done = scrub_cells(rows, "cells", chosen, method, salt, found).withColumn("out_file", output_name(FILE))
        return staged(done, "scrubbed") if stage else done

    def table_account(rows: DataFrame, at: str, ragged: bool) -> None:
        """Totals of tables whose first record is the header; the headers are one row for each file."""
        heads = rows.groupBy(FILE).agg(F.min(at).alias("_first"), F.min_by(F.size("cells"), at).alias("_width"))
        marked = rows.join(small_side(heads), FILE).withColumn("_head", F.col(at) == F.col("_first"))
        uneven = F.count_if(F.size("cells") != F.col("_width")) if ragged else F.lit(0)
        extra = [uneven.cast("int").alias("n_ragged"), F.min(MODEL_ERROR).alias("model_error"), F.max("_width").alias("_width")]
        per_file = totals_of_tables(marked, "_head", [FILE], extra=extra).withColumn("n_cells", F.col("rows_processed") * F.col("_width"))
        account(per_file.drop("_width").withColumn("preview", no_preview), rows, preview_records(rows, csv_array_record("cells"), at, FILE))

    if "csv" in kinds:
        tables = cells_scrubbed(read_csv_records(spark, paths, multiline, quota.max_file_bytes))
        table_account(tables, AT, ragged=True)
    if "xlsx" in kinds:
        book = read_workbooks(spark, paths)
        broken = book.where("error is not null").select(FILE, F.col("error").alias("book_error"))
        status = status.join(broken, FILE, "left")
        error = F.coalesce("error", "book_error")
        status = status.select(FILE, "size_bytes", error.isNull().alias("success"), error.alias("error"))
        books = cells_scrubbed(book.where("error is null").drop("error"))
        table_account(books, "row_idx", ragged=False)

    def text_totals(rows: DataFrame, shown=no_preview) -> DataFrame:
        extra = [F.lit(0).alias("n_ragged"), F.min(MODEL_ERROR).alias("model_error"), F.max(shown).alias("preview")]
        return totals_of_marks(rows, [FILE], extra=extra).withColumn("n_cells", F.col("rows_processed"))

    plain = sorted(kinds & {"txt", "json"})
    if plain and text_mode == "document":
        texts = scrubbed(read_texts(spark, paths, quota.max_file_bytes, plain), ["text"])
        account(text_totals(texts, preview("text")), texts)
    if plain and text_mode == "line":
        lines = scrubbed(read_lines(spark, paths, quota.max_file_bytes, plain), ["line"])
        account(text_totals(lines), lines, preview_records(lines, F.col("line"), AT, FILE))

    if not totals:
        return _nothing(status)
    per_file = _union(totals)
    joined = status.join(per_file, FILE, "left")
    checks = [
        F.col("error"),
        F.when(F.col("n_ragged") > 0, F.format_string("CSV error: %d records of unequal length", "n_ragged")),
        row_error(F.col("rows_processed"), quota),
    ]
    warning = F.format_string("The model failed: %s", "model_error")
    warning = F.when(F.col("model_error").isNotNull(), warning)
    if model_errors == "fail":
        checks.append(warning)
    if check_cells:
        checks.append(cell_error(F.col("n_cells"), quota))
    error = F.coalesce(*checks)
    counts = ["pii_found", "rows_processed", "rows_affected", "cells_affected"]
    report = joined.select(
        FILE,
        F.when(error.isNull(), output_name(FILE)).otherwise(base_name(FILE)).alias("out_file"),
        file_kind(FILE).alias("file_type"),
        error.isNull().alias("success"),
        error.alias("error"),
        warning.alias("warning"),
        F.when(error.isNull(), F.col("preview")).alias("preview"),
        *[F.when(error.isNull(), F.coalesce(c, F.lit(0))).otherwise(0).cast("bigint").alias(c) for c in counts],
    )
    good = report.where("success").select(FILE)
    by_type = _union(type_parts).join(good, FILE, "left_semi").groupBy(FILE, "pii_type").agg(F.sum("n").alias("n"))
    return FileScrub(tables, books, texts, lines, report, by_type)


def _nothing(status: DataFrame) -> FileScrub:
    zero = {c: F.lit(0).cast("bigint") for c in ("pii_found", "rows_processed", "rows_affected", "cells_affected")}
    report = status.select(
        FILE,
        base_name(FILE).alias("out_file"),
        file_kind(FILE).alias("file_type"),
        "success",
        "error",
        F.lit(None).cast("string").alias("warning"),
        F.lit(None).cast("string").alias("preview"),
        *[v.alias(k) for k, v in zero.items()],
    )
    empty = status.where("false").select(FILE, F.lit("").alias("pii_type"), F.lit(0).cast("bigint").alias("n"))
    return FileScrub(None, None, None, None, report, empty)
