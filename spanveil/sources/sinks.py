"""Writers: CSV, text, and the successful part of a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.naming import PREVIEW_CHARS
from ..functions.spans import quoted

# A record takes at least one character with its line end, so this many rows and one more fill a preview.
PREVIEW_ROWS = PREVIEW_CHARS + 1
# A file's rows are first picked in so many parts by hash, each up to PART_ROWS, which Spark limits before it
# shuffles (it does so up to 1000). The first PREVIEW_ROWS rows put about 30 in a part.
PREVIEW_PARTS, PART_ROWS = 64, 1000


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", partition_by=()) -> None:
    """Header plus rows, quoting only where needed, quotes doubled."""
    writer = df.write.mode(mode).partitionBy(*partition_by) if partition_by else df.write.mode(mode)
    writer.csv(path, header=True, quote='"', escape='"', emptyValue="")


def csv_record(columns) -> Column:
    """A row as one CSV record, quoted only where needed."""

    record = F.concat_ws(",", *[_csv_cell(F.coalesce(F.col(quoted(c)), F.lit(""))) for c in columns])
    return F.when(record == "", F.lit('""')).otherwise(record) if len(columns) == 1 else record


def csv_array_record(cells: str) -> Column:
    """An array of cells as one CSV record."""
    record = F.array_join(F.transform(F.col(quoted(cells)), _csv_cell), ",", "")
    return F.when(record == "", F.lit('""')).otherwise(record)


def _csv_cell(text: Column) -> Column:
    doubled = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(F.rlike(text, F.lit('[",\\r\\n]')), doubled).otherwise(text)


def csv_line(cells) -> str:
    """Driver-side form of :func:`csv_record`, for a header."""
    quote = ['"' + c.replace('"', '""') + '"' if any(x in c for x in '",\r\n') else c for c in cells]
    return ",".join(quote) if quote != [""] else '""'


def preview_records(rows: DataFrame, record: Column, at: str, file: str = "file", header: str | None = None) -> DataFrame:
    """Preview of files whose rows are spread over tasks: file, preview.

    The first rows of each file are picked by row number, by parts of the file and then
    among all its parts. Spark limits the first pick inside every task before it shuffles, so
    a large file sends a bounded number of cut records. The full length is a sum.
    """
    head = "" if header is None else header + "\n"
    lined = rows.select(file, F.col(at).alias("_at"), record.alias("_record"))
    total = lined.groupBy(file).agg(F.sum(F.length("_record") + 1).alias("_chars"))
    cut = lined.select(file, "_at", F.substring("_record", 1, PREVIEW_CHARS + 1).alias("_record"))
    cut = cut.withColumn("_part", F.pmod(F.xxhash64("_at"), F.lit(PREVIEW_PARTS)))
    few = cut.withColumn("_n", F.row_number().over(Window.partitionBy(file, "_part").orderBy("_at")))
    few = few.where(F.col("_n") <= PART_ROWS).drop("_part")
    first = few.withColumn("_n", F.row_number().over(Window.partitionBy(file).orderBy("_at")))
    first = first.where(F.col("_n") <= PREVIEW_ROWS)
    listed = first.groupBy(file).agg(F.array_sort(F.collect_list(F.struct("_n", "_record"))).alias("_records"))
    body = F.concat(F.lit(head), F.array_join(F.transform("_records", lambda r: r["_record"]), "\n"), F.lit("\n"))
    chars = F.col("_chars") + len(head)
    note = F.concat(
        F.substring(body, 1, PREVIEW_CHARS),
        F.lit("...\n\n[Truncated - "),
        chars.cast("string"),
        F.lit(" total characters]"),
    )
    shown = F.when(chars > PREVIEW_CHARS, note).otherwise(body)
    return listed.join(total, file).select(file, shown.alias("preview"))


def write_lines(df: DataFrame, path: str, column: str = "line", mode: str = "errorifexists", partition_by=()) -> None:
    """One line per row, each ended by a line feed."""
    out = df.select(*partition_by, F.col(column).alias("value"))
    writer = out.write.mode(mode).partitionBy(*partition_by) if partition_by else out.write.mode(mode)
    writer.text(path, lineSep="\n")


def write_texts(df: DataFrame, path: str, name: str = "out_file", text: str = "text", mode="errorifexists") -> None:
    """Whole texts, unchanged in shape, one folder per output name."""
    out = df.select(F.col(name), F.col(text).alias("value"))
    out.write.mode(mode).partitionBy(name).option("lineSep", "\n").text(path)


def successful(results: DataFrame) -> DataFrame:
    return results.where("success")


def failed(results: DataFrame) -> DataFrame:
    return results.where("not success")
