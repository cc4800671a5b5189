"""Readers: CSV, whole texts, lines, JSON as text, and dispatch by file name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.naming import KINDS, file_kind
from ..functions.spans import free_name, quoted
from .workspace import small_side

FILE = "file"
RAGGED = "_ragged"
# Where a row lies in its file: start of its split, then a number rising within the split.
AT = "_at"


def row_position() -> Column:
    return F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("n"))


def _within(df: DataFrame, max_bytes: int | None, kinds=None) -> DataFrame:
    """Leave out files over a size or of other kinds; filters on file metadata prune them before reading."""
    if kinds is not None:
        df = df.where(file_kind("_metadata.file_name").isin(*kinds))
    return df if max_bytes is None else df.where(F.col("_metadata.file_size") <= max_bytes)


def list_files(spark: SparkSession, paths) -> DataFrame:
    """file, size_bytes and kind of every file under files, folders (at any depth) and globs. Reads no contents.

    Scans leave empty files out; the file index knows them, and they are listed with size 0.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    sized = found.select(file_name(F.col("path")).alias(FILE), F.col("length").alias("size_bytes"))
    known = spark.createDataFrame([(p,) for p in found.inputFiles()], "path string").select(file_name(F.col("path")).alias(FILE))
    # The index writes a local path with other slashes than a scan does.
    same = F.regexp_replace(FILE, "^(\\w+):/+", "$1:/")
    empty = known.withColumn("_same", same).join(sized.select(same.alias("_same")), "_same", "left_anti")
    listed = sized.unionByName(empty.select(FILE, F.lit(0).cast("long").alias("size_bytes")))
    return listed.withColumn("kind", file_kind(FILE))


_CSV = {"header": True, "quote": '"', "escape": '"', "multiLine": True, "emptyValue": "", "enforceSchema": False}


def file_name(path: str | Column = "_metadata.file_path") -> Column:
    """Decoded path of the file a row came from."""
    return F.url_decode(F.replace(F.col(path) if isinstance(path, str) else path, F.lit("+"), F.lit("%2B")))


def csv_header(spark: SparkSession, paths) -> list[str]:
    """Column names of the first record, as strings (reads one record)."""
    return spark.read.csv(paths, header=True, inferSchema=False, quote='"', escape='"', multiLine=True).columns


def string_schema(names) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_csv(spark: SparkSession, paths, header=None, multiline: bool = True, with_file: bool = False) -> DataFrame:
    """All cells as strings, blank cells as the empty string, header from the first record.

    The files of one call share a header; one that differs is an error, and so is a record of another width.
    ``multiline=False`` lets Spark split a single large file between tasks and
    is right whenever no quoted cell holds a line break.
    """
    names = header or csv_header(spark, paths)
    corrupt = free_name(names, "_corrupt_record")
    options = _CSV | {"multiLine": multiline, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}
    df = spark.read.options(**options).schema(string_schema([*names, corrupt])).csv(paths)
    # The width of a record is judged by the columns asked for, so the check has to need them all.
    every_cell = F.length(F.concat_ws("", *[F.col(quoted(c)) for c in names])) >= 0
    sound = F.assert_true(F.col(quoted(corrupt)).isNull() & every_cell, F.lit("a CSV record differs in width from the header"))
    extra = [file_name().alias(FILE)] if with_file else []
    return df.where(sound.isNull()).select(*extra, *[F.coalesce(F.col(quoted(c)), F.lit("")).alias(c) for c in names])


def read_csv_checked(
    spark: SparkSession,
    paths,
    header=None,
    multiline: bool = True,
    has_header: bool = True,
    max_bytes: int | None = None,
) -> DataFrame:
    """Like :func:`read_csv` with file name, row position, and a flag for records of the wrong width.

    The flag marks records with too few or too many cells: a strict writer cannot
    write them back, so a file that holds one fails as a whole.
    """
    names = header or csv_header(spark, paths)
    schema = string_schema([*names, "_corrupt_record"])
    options = _CSV | {
        "header": has_header,
        "multiLine": multiline,
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": "_corrupt_record",
        "enforceSchema": True,
    }
    df = _within(spark.read.options(**options).schema(schema).csv(paths), max_bytes)
    # The parser judges a record's width by the columns it is asked for, so the flag
    # has to need them all even when the caller drops the rest.
    every_cell = F.length(F.concat_ws("", *[F.col(quoted(c)) for c in names])) < 0
    return df.select(
        file_name().alias(FILE),
        *[F.coalesce(F.col(quoted(c)), F.lit("")).alias(c) for c in names],
        (F.col("_corrupt_record").isNotNull() | every_cell).alias(RAGGED),
        row_position().alias(AT),
    )


# Stands for a comma outside quotes while a record is cut; records that hold it are cut by pattern.
_CUT = "\x01,\x02"
_CELL = '(?:^|,)("[^"]*+(?:""[^"]*+)*+"[^,]*|[^,]*)'


def csv_cells(record: Column) -> Column:
    """The cells of one CSV record, as many as it has; doubled quotes in quoted cells are single ones."""
    def joined(parts: Column) -> Column:
        outside = F.transform(parts, lambda p, i: F.when(i % 2 == 0, F.replace(p, F.lit(","), F.lit(_CUT))).otherwise(p))
        return F.split(F.array_join(outside, '"'), _CUT, -1)

    quoted_cells = F.transform(F.array(F.split(record, '"', -1)), joined)[0]
    by_pattern = F.regexp_extract_all(record, F.lit(_CELL), 1)
    raw = F.when(F.contains(record, F.lit(_CUT)), by_pattern).when(F.contains(record, F.lit('"')), quoted_cells).otherwise(F.split(record, ",", -1))
    inner = lambda c: F.replace(F.substr(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
    return F.transform(raw, lambda c: F.when(F.startswith(c, F.lit('"')) & F.endswith(c, F.lit('"')) & (F.length(c) >= 2), inner(c)).otherwise(c))


def read_csv_records(spark: SparkSession, paths, multiline: bool = True, max_bytes: int | None = None) -> DataFrame:
    """Every record of every CSV file under ``paths``, headers included, in one scan: file, position, cells.

    Nothing has to be known about the headers: records keep their own width, names may repeat or be empty. The header of
    a file is its record with the smallest position. Blank lines are no records. ``multiline=False`` splits large files
    between tasks, for files without line breaks in quoted cells.
    """
    # Asked for one cell, the parser hands over every wider record as it stands, after it found the record's end.
    reader = spark.read.options(header=False, quote='"', escape='"', multiLine=multiline, mode="PERMISSIVE", columnNameOfCorruptRecord="record", emptyValue="", recursiveFileLookup=True)
    df = _within(reader.schema("cell string, record string").csv(paths), max_bytes, ["csv"])
    alone = F.array(F.coalesce("cell", F.lit("")))
    return df.select(file_name().alias(FILE), row_position().alias(AT), F.when(F.col("record").isNull(), alone).otherwise(csv_cells(F.col("record"))).alias("cells"))


def named_cells(records: DataFrame, names: list[str], at: str = AT) -> DataFrame:
    """Records below their headers as the columns ``names``, each cell taken from where its own file's header has it.

    A file without such a header cell has null there; of repeated header cells the first counts. ``records`` holds file,
    position and cells. The headers are one row for each file.
    """
    heads = records.groupBy(FILE).agg(F.min(at).alias("_first"), F.min_by("cells", at).alias("_header"))
    body = records.join(small_side(heads), FILE).where(F.col(at) > F.col("_first"))

    def cell(name: str) -> Column:
        place = F.array_position("_header", name).cast("int")
        return F.when(place > 0, F.try_element_at("cells", place))

    return body.select(FILE, *[cell(n).alias(n) for n in names])


def read_texts(spark: SparkSession, paths, max_bytes: int | None = None, kinds=None) -> DataFrame:
    """One row per file: file, size_bytes, text. JSON is read this way too, unparsed.

    ``kinds`` picks files of these kinds out of folders at any depth.
    """
    df = _within(spark.read.text(paths, wholetext=True, recursiveFileLookup=kinds is not None), max_bytes, kinds)
    return df.select(
        file_name().alias(FILE), F.col("_metadata.file_size").alias("size_bytes"), F.col("value").alias("text")
    )


def read_lines(spark: SparkSession, paths, max_bytes: int | None = None, kinds=None) -> DataFrame:
    """One row per line: file, size_bytes, line and its position. Files are split between tasks.

    Line ends are dropped; a carriage return before a line feed is part of the end. ``kinds`` picks files of these
    kinds out of folders at any depth.
    """
    df = _within(spark.read.text(paths, recursiveFileLookup=kinds is not None), max_bytes, kinds)
    return df.select(
        file_name().alias(FILE),
        F.col("_metadata.file_size").alias("size_bytes"),
        F.col("value").alias("line"),
        row_position().alias(AT),
    )


def read_numbered_lines(spark: SparkSession, paths, max_bytes: int | None = None) -> DataFrame:
    """One row per line: file, line_no from 0, line. Files are split between tasks, and numbers hold all the same.

    A first scan counts the lines of each split; running sums over a file's splits give where each begins. A line's
    number is that and its place in its split. What is joined is one row for each split.
    """
    rows = read_lines(spark, paths, max_bytes).select(FILE, AT, "line")
    splits = rows.groupBy(FILE, F.col(AT)["split"].alias("_split")).agg(F.min(F.col(AT)["n"]).alias("_low"), F.count(F.lit(1)).alias("_lines"))
    before = Window.partitionBy(FILE).orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    begins = splits.select(FILE, "_split", "_low", F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_begin"))
    placed = rows.select(FILE, F.col(AT)["split"].alias("_split"), F.col(AT)["n"].alias("_n"), "line")
    return placed.join(small_side(begins), [FILE, "_split"]).select(FILE, (F.col("_begin") + F.col("_n") - F.col("_low")).alias("line_no"), "line")


def lines_of(text: str | Column) -> Column:
    """A text's lines; a final line end opens no further line, an empty text has none."""
    t = F.col(quoted(text)) if isinstance(text, str) else text
    lines = F.split(F.regexp_replace(t, r"\r?\n\z", ""), r"\r?\n", -1)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(lines)


def number_lines(texts: DataFrame, text: str = "text", keys=(FILE,)) -> DataFrame:
    """Lines of whole texts with their zero-based number: keys, line_no, line."""
    return texts.select(*keys, F.posexplode(lines_of(text)).alias("line_no", "line"))


def route_units(texts: DataFrame, by_line: Column, text: str = "text", keys=(FILE,)) -> DataFrame:
    """Texts whole, or line by line where ``by_line`` says so, in one scan: keys, unit, line_no and the text.

    The caller says which texts are lines, by their kind for example. Size plays no part: a value across a line end
    would be found in a short text and missed in a long one.
    """
    lines = F.coalesce(by_line, F.lit(False))
    units = F.when(lines, lines_of(text)).otherwise(F.array(F.col(quoted(text))))
    return texts.select(
        *keys,
        F.when(lines, F.lit("line")).otherwise(F.lit("document")).alias("unit"),
        F.posexplode(units).alias("line_no", text),
    )


def kind_of(path: str) -> str:
    """Driver-side file kind of one path (``functions.naming.file_kind`` is the column form)."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    stem, dot, ext = name.rpartition(".")
    ext = ext.lower() if dot and stem else ""
    return ext if ext in KINDS else "txt"


def split_by_kind(paths) -> dict[str, list[str]]:
    """Paths grouped by file kind, one reader per group."""
    groups: dict[str, list[str]] = {}
    for p in paths:
        groups.setdefault(kind_of(p), []).append(p)
    return groups


def without_files(df: DataFrame, names, file: str = FILE) -> DataFrame:
    """Leave files out of a batch by base name."""
    return df.where(~F.element_at(F.split(F.col(file), "/", -1), -1).isin(*names)) if names else df
