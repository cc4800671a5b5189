"""Micro-batches written under their number, so that a batch that is run again replaces itself.

Everything a batch leaves lies in folders named after it: scrubbed rows, dead letters, and how much it adds to each
file's totals. A stream that is killed and started again repeats its last batch under the same number, so reading
the three tables gives what one batch job over the same files gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..functions.catalog import display_name, parse_types
from ..operators.scrub import scrub_marked
from ..operators.stats import totals_of_marks
from ..sources.files import file_name, list_files
from .scrub import stream_table

FILE, ERROR = "file", "error"
ROWS, DEAD, TOTALS = "rows", "dead_letters", "totals"
_COUNTS = ("pii_found", "rows_processed", "rows_affected", "cells_affected")
_MARK = "_pii"


def stream_files(spark: SparkSession, path: str, schema, fmt: str = "csv", glob: str = "*", **options) -> DataFrame:
    """Rows of files as they arrive, with ``file`` and, where a record doesn't fit the schema, ``error``.

    CSV and JSON records that cannot be read keep their raw text in ``_corrupt`` and every other column is NULL.
    """
    fields = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    textual = fmt in ("csv", "json")
    if textual:
        fields = T.StructType([*fields.fields, T.StructField("_corrupt", T.StringType())])
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"} | options
    read = stream_table(spark, path, fields, fmt, glob, **options)
    broken = F.when(F.col("_corrupt").isNotNull(), F.lit("The record does not fit the schema")) if textual else F.lit(None).cast("string")
    return read.select("*", F.col("_metadata.file_path").alias(FILE), broken.alias(ERROR))


def scrub_batches(
    sdf: DataFrame, path: str, checkpoint: str, columns, types=None, method: str = "mask", salt: str = "", error: Column | None = None
) -> StreamingQuery:
    """Scrub a stream of :func:`stream_files` into ``path``: good rows, dead letters and totals by file, each by batch.

    ``error`` adds a reason to refuse a row (a string, NULL for good rows) to the stream's own. A refused row goes to
    the dead letters as it came, counts for nothing else, and never stops the stream. Each batch detects once: its rows
    are written with their marks, and its totals are sums over the marks, read back. Totals are the batch's last write.
    """
    chosen = parse_types(types)
    reason = F.col(ERROR) if error is None else F.coalesce(F.col(ERROR), error)

    def run(batch: DataFrame, batch_id: int) -> None:
        place = lambda kind: f"{path}/{kind}/batch={batch_id}"
        judged = batch.withColumn(ERROR, reason)
        judged.where(F.col(ERROR).isNotNull()).write.mode("overwrite").parquet(place(DEAD))
        good = judged.where(F.col(ERROR).isNull()).drop(ERROR, *[c for c in ("_corrupt",) if c in judged.columns])
        marked = scrub_marked(good, columns, chosen, method, salt, mark=_MARK)
        marked.write.mode("overwrite").parquet(place(ROWS))
        done = batch.sparkSession.read.schema(marked.schema).parquet(place(ROWS))
        by_type = [F.sum(F.col(_MARK)["by_type"][i]).alias(f"_n{i}") for i in range(len(chosen))]
        sums = totals_of_marks(done, [FILE], _MARK, extra=by_type)
        pairs = F.array(
            *[
                F.struct(F.lit(display_name(t)).alias("pii_type"), F.col(f"_n{i}").cast("long").alias("n"))
                for i, t in enumerate(chosen)
            ]
        )
        delta = sums.select(FILE, *[F.col(c).cast("long").alias(c) for c in _COUNTS], F.filter(pairs, lambda p: p["n"] > 0).alias("types"))
        delta.write.mode("overwrite").parquet(place(TOTALS))

    writer = sdf.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def _all_batches(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.option("basePath", f"{path}/{kind}").parquet(f"{path}/{kind}/batch=*")


def batch_rows(spark: SparkSession, path: str) -> DataFrame:
    """The scrubbed rows of all batches so far, with ``file`` and ``batch``."""
    return _all_batches(spark, path, ROWS).drop(_MARK)


def dead_letters(spark: SparkSession, path: str) -> DataFrame:
    """The refused rows of all batches so far, as they came, with ``file``, ``error`` and ``batch``."""
    return _all_batches(spark, path, DEAD)


def running_totals(spark: SparkSession, path: str) -> DataFrame:
    """Totals by file so far: what each batch added, summed. One row for each file that had a good row."""
    return _all_batches(spark, path, TOTALS).groupBy(FILE).agg(*[F.sum(c).alias(c) for c in _COUNTS])


def running_types(spark: SparkSession, path: str) -> DataFrame:
    """Spans by file and type so far: file, pii_type, n."""
    added = _all_batches(spark, path, TOTALS).select(FILE, F.inline("types"))
    return added.groupBy(FILE, "pii_type").agg(F.sum("n").alias("n"))


def _same_file(column: str | Column) -> Column:
    """A path as listings and streams both write it."""
    return F.regexp_replace(column, "^(\\w+):/+", "$1:/")


def batch_progress(spark: SparkSession, path: str, sources) -> DataFrame:
    """How far each batch brought the run: batch, phase, percent, and files, bytes, rows and findings so far.

    ``sources`` are the paths that the stream reads. A file counts as done with the first batch that has any row of it,
    good or refused: a batch takes whole files. Percent is bytes done of the bytes that are listed now, so it falls when files
    arrive; files without bytes count as done from the start. The running sums are over one row for each batch.
    """
    listed = list_files(spark, sources).select(_same_file(FILE).alias(FILE), "size_bytes")
    all_bytes, empty = listed.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)), F.count_if(F.col("size_bytes") == 0)).first()
    counts = _all_batches(spark, path, TOTALS).select("batch", FILE, "rows_processed", "pii_found")
    refused = dead_letters(spark, path).select("batch", FILE).distinct().select("batch", FILE, F.lit(0).alias("rows_processed"), F.lit(0).alias("pii_found"))
    per_file = (
        counts.unionByName(refused).groupBy(FILE)
        .agg(F.min("batch").alias("batch"), F.sum("rows_processed").alias("rows_processed"), F.sum("pii_found").alias("pii_found"))
        .withColumn(FILE, _same_file(file_name(F.col(FILE))))
    )
    per_batch = per_file.join(listed, FILE, "left").groupBy("batch").agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"),
        F.sum("rows_processed").alias("rows_processed"), F.sum("pii_found").alias("pii_found"),
    )
    so_far = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = per_batch.select("batch", *[F.sum(c).over(so_far).alias(c) for c in ("files", "bytes", "rows_processed", "pii_found")])
    percent = F.col("bytes") * 100.0 / all_bytes if all_bytes else F.lit(100.0)
    return sums.select(
        "batch", F.when(F.col("bytes") < all_bytes, "scanning").otherwise("complete").alias("phase"),
        percent.cast("double").alias("percent"), (F.col("files") + empty).alias("files"), "bytes", "rows_processed", "pii_found",
    )
