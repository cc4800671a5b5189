"""A table of the parts of an output, written last: without it, the output is not whole.

A manifest has one row for each part file: shape (the folder below the output), of, out_file, part (the file's name),
place (from 0, in the order of the input), rows, bytes and digest, the sum of hashes of its lines. It is made by one
scan of what was written, aggregated inside tasks: nothing of the size of the data is shuffled or comes to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import AT, row_position
from .workspace import small_side

MANIFEST = "manifest"
_KEYS = ("shape", "of", "out_file", "part")


def _written(spark: SparkSession, path: str, shape: str) -> DataFrame:
    """The lines of one shape as they lie in the output."""
    lines = spark.read.schema("value string, of string, out_file string").text(f"{path}/{shape}", lineSep="\n")
    named = F.col("_metadata.file_name").alias("part"), F.col("_metadata.file_size").alias("bytes")
    return lines.select(F.lit(shape).alias("shape"), "of", "out_file", *named, row_position().alias(AT), F.col("value").alias("line"))


def _parts(spark: SparkSession, path: str, shapes) -> DataFrame:
    lines = reduce(DataFrame.unionByName, [_written(spark, path, s) for s in shapes])
    # Remainders of 2^31 keep the sum a long for any number of lines a file can hold.
    digest = F.sum(F.pmod(F.xxhash64("line"), F.lit(1 << 31)))
    return lines.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("rows"), F.max("bytes").alias("bytes"), digest.alias("digest"))


def write_manifest(spark: SparkSession, path: str, shapes) -> None:
    """Write the manifest of the output in ``path``, whose parts follow one another by name within an output file.

    An output of nothing has an empty manifest. An earlier manifest is an error, so an output is committed once.
    """
    if not shapes:
        empty = "shape string, of string, out_file string, part string, rows long, bytes long, digest long, place int"
        spark.createDataFrame([], empty).write.parquet(f"{path}/{MANIFEST}")
        return
    order = Window.partitionBy("shape", "of", "out_file").orderBy("part")
    placed = _parts(spark, path, shapes).withColumn("place", F.row_number().over(order) - 1)
    placed.write.parquet(f"{path}/{MANIFEST}")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of an output; an output that was not finished has none, which is an error."""
    return spark.read.parquet(f"{path}/{MANIFEST}")


def _shapes(manifest: DataFrame) -> list[str]:
    return sorted(r["shape"] for r in manifest.select("shape").distinct().collect())  # four at most


def read_by_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The lines of the parts a manifest lists: shape, of, out_file, part, line_no (from 0, as in the input) and line.

    Parts the manifest doesn't know are left out. Numbers are a line's place in its split, after the lines of the
    splits and parts before it; what is joined is one row for each split.
    """
    manifest = read_manifest(spark, path)
    listed = manifest.select(*_KEYS, "place")
    shapes = _shapes(manifest)
    if not shapes:
        return listed.select(*_KEYS, F.lit(0).cast("long").alias("line_no"), F.lit("").alias("line"))
    lines = reduce(DataFrame.unionByName, [_written(spark, path, s) for s in shapes])
    lines = lines.withColumns({"_split": F.col(AT)["split"], "_n": F.col(AT)["n"]}).drop(AT, "bytes")
    splits = lines.groupBy(*_KEYS, "_split").agg(F.min("_n").alias("_low"), F.count(F.lit(1)).alias("_lines"))
    earlier = Window.partitionBy("shape", "of", "out_file").orderBy("place", "_split").rowsBetween(Window.unboundedPreceding, -1)
    begins = splits.join(small_side(listed), list(_KEYS))
    begins = begins.select(*_KEYS, "_split", "_low", F.coalesce(F.sum("_lines").over(earlier), F.lit(0)).alias("_begin"))
    joined = lines.join(small_side(begins), [*_KEYS, "_split"])
    return joined.select(*_KEYS, (F.col("_begin") + F.col("_n") - F.col("_low")).alias("line_no"), "line")


def damaged_parts(spark: SparkSession, path: str) -> DataFrame:
    """The listed parts that are gone or not as they were written, with the manifest's columns."""
    manifest = read_manifest(spark, path)
    shapes = _shapes(manifest)
    return manifest.join(_parts(spark, path, shapes), [*_KEYS, "rows", "bytes", "digest"], "left_anti") if shapes else manifest
