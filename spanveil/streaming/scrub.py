"""The same operators on Structured Streaming.

Scrubbing is a stateless projection, so the batch functions apply to a stream
unchanged; these helpers add sources with fixed schemas, sinks and counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.catalog import parse_types
from ..functions.spans import find_spans
from ..operators.detect import explode_spans, text_columns
from ..operators.scrub import scrub


def stream_lines(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Lines of text files as they arrive: ``value``."""
    return spark.readStream.option("pathGlobFilter", glob).text(path)


def stream_table(
    spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet", glob: str = "*", **options
) -> DataFrame:
    """Rows of CSV, JSON or parquet files as they arrive; the schema must be given."""
    reader = spark.readStream.schema(schema).format(fmt).option("pathGlobFilter", glob).options(**options)
    return reader.load(path)


def scrub_stream(sdf: DataFrame, columns=None, types=None, method: str = "mask", salt: str = "", row_key=None):
    """Scrub a streaming DataFrame (append output, no state)."""
    return scrub(sdf, columns, types, method, salt, row_key)


def running_type_counts(sdf: DataFrame, columns=None, types=None) -> DataFrame:
    """Spans per type so far; use complete or update output. State: one row per type."""
    chosen = parse_types(types)
    names = text_columns(sdf, columns)
    found = explode_spans(sdf, {c: find_spans(c, chosen) for c in names})
    return found.groupBy("pii_type").count().withColumnRenamed("count", "n")


def write_stream(sdf: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", **options) -> StreamingQuery:
    """Append to files, processing what is there now and then stopping; restartable from the checkpoint."""
    writer = sdf.writeStream.format(fmt).outputMode("append").options(**options)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
