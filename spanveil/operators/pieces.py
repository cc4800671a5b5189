"""One very long text, or one very large file, over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.catalog import parse_types
from ..functions.pieces import PIECE_CHARS, line_head, line_tail, pieces_sql
from ..functions.spans import find_spans, free_name, quoted
from ..functions.splice import scrub_text
from ..sources.files import AT, FILE, file_name, row_position
from ..sources.workspace import small_side, staged
from .detect import explode_spans, text_columns

_FIELDS = ("start", "end", "ord", "pii_type", "value")


def _long_and_short(df: DataFrame, column: str, piece_chars: int) -> tuple[DataFrame, DataFrame]:
    is_long = F.coalesce(F.length(quoted(column)) > piece_chars, F.lit(False))
    return df.where(is_long), df.where(~is_long)


def _dealt(long: DataFrame, column: str, kept: list[str], piece_chars: int) -> DataFrame:
    """The pieces of long texts, dealt out by key and place: ``kept``, _start, _piece."""
    cut = long.select(*[F.col(quoted(c)) for c in kept], F.inline(F.expr(pieces_sql(quoted(column), piece_chars))))
    cut = cut.withColumnsRenamed({"start": "_start", "piece": "_piece"})
    return cut.repartition(F.xxhash64(*[F.col(quoted(c)) for c in kept], F.col("_start")))


def findings_in_pieces(df: DataFrame, column: str, types=None, keys=(), piece_chars: int = PIECE_CHARS) -> DataFrame:
    """:func:`~spanveil.findings` of one column, long texts cut into pieces that many tasks scan.

    The rows are those of the whole text for any ``piece_chars``. Texts up to that length are scanned where they lie;
    only the pieces of longer ones are shuffled. The column is read once for each of the two.
    """
    text_columns(df, [column])
    kept = list(keys)
    long, short = _long_and_short(df, column, piece_chars)
    near = explode_spans(short, {column: find_spans(column, types)}, kept)
    pieces = _dealt(long, column, kept, piece_chars)
    far = explode_spans(pieces, {"_piece": find_spans("_piece", types)}, [*kept, "_start"])
    moved = [(F.col(f) + F.col("_start")).alias(f) if f in ("start", "end") else F.col(f) for f in _FIELDS]
    return near.union(far.select(*[F.col(quoted(c)) for c in kept], F.lit(column).alias("column"), *moved))


def scrub_in_pieces(
    df: DataFrame, column: str, keys, types=None, method: str = "mask", salt: str = "", piece_chars: int = PIECE_CHARS
) -> DataFrame:
    """:func:`~spanveil.scrub` of one column, long texts scrubbed piece by piece in many tasks and put together again.

    ``keys`` name the columns that tell rows apart; two long rows of one key are an error. Short texts and their rows
    stay where they lie, the other columns of a long text travel with its first piece.
    """
    text_columns(df, [column])
    kept, others = list(keys), [c for c in df.columns if c not in {column, *keys}]
    long, short = _long_and_short(df, column, piece_chars)
    packed = free_name(df.columns, "_others")
    carried = F.struct(*[F.col(quoted(c)) for c in others], F.lit(0).alias(free_name(df.columns, "_none")))
    long = long.select(*[F.col(quoted(c)) for c in (*kept, column)], carried.alias(packed))
    cut = long.withColumn("_cut", F.expr(pieces_sql(quoted(column), piece_chars))).drop(column)
    cut = cut.select(*[F.col(quoted(c)) for c in kept], packed, F.posexplode("_cut").alias("_n", "_cut"))
    cut = cut.withColumn(packed, F.when(F.col("_n") == 0, F.col(packed))).withColumn("_piece", F.col("_cut")["piece"])
    cut = cut.drop("_cut").repartition(F.xxhash64(*[F.col(quoted(c)) for c in kept], F.col("_n")))
    done = cut.withColumn("_piece", scrub_text("_piece", types, method, salt))
    ordered = F.array_sort(F.collect_list(F.struct("_n", "_piece")))
    whole = done.groupBy(*[F.col(quoted(c)) for c in kept]).agg(
        F.array_join(F.transform(ordered, lambda p: p["_piece"]), "").alias(column),
        F.max_by(packed, F.col(packed).isNotNull()).alias(packed),
        F.count_if(F.col("_n") == 0).alias("_rows"),
    )
    once = F.when(F.col("_rows") > 1, F.raise_error(F.lit("rows with long texts need keys that tell them apart")).cast("string"))
    text = F.coalesce(once, F.col(quoted(column))).alias(column)
    back = [text if c == column else F.col(packed)[c].alias(c) if c in others else F.col(quoted(c)) for c in df.columns]
    return short.withColumn(column, scrub_text(column, types, method, salt)).union(whole.select(*back))


def findings_in_files(spark: SparkSession, paths, types=None) -> DataFrame:
    """Findings over whole files that Spark splits between tasks: file, start, end, ord, pii_type, value.

    Offsets count the file's characters; the rows are those of the text read whole, whatever the split size, and no
    file is too large (one line must fit in a row). A file has one scan: each line's part between its first and last
    safe cut is searched in place. Only what lies around line ends, where both sides could belong to one match, is
    shuffled, with a number of characters for each line; running sums within splits, and one row for each split, turn
    those into offsets. Lines without a safe cut (digits, brackets and single spaces alone) are joined whole.
    """
    chosen = parse_types(types)
    read = spark.read.text(paths, lineSep="\n").select(file_name().alias(FILE), row_position().alias(AT), "value")
    edges = read.withColumns({"_head": line_head("value"), "_tail": line_tail("value")})
    size, head, tail = F.length("value"), F.length("_head"), F.length("_tail")
    # One column for each line: its searchable middle, or nothing where it has no safe cut.
    middle = F.substring("value", head + 1, size - head - tail)
    edges = edges.withColumn("_middle", F.coalesce(middle, F.lit("")))
    found = F.transform(find_spans("_middle", chosen), lambda s: F.struct(
        (s["start"] + F.length("_head")).alias("start"), (s["end"] + F.length("_head")).alias("end"), s["ord"].alias("ord"),
        s["pii_type"].alias("pii_type"), s["value"].alias("value")))
    narrow = edges.select(
        FILE,
        F.col(AT)["split"].alias("_split"),
        F.col(AT)["n"].alias("_n"),
        (size + 1).cast("long").alias("_chars"),
        F.col("_head").isNotNull().alias("_closed"),
        F.coalesce("_head", "value").alias("_head"),
        F.coalesce("_tail", F.lit("")).alias("_tail"),
        found.alias("_spans"),
    )
    lines = _with_offsets(staged(narrow, "lines"))
    inside = lines.select(FILE, "_at", F.explode("_spans").alias("s"))
    inside = inside.select(FILE, *_moved("_at"))
    across = _chained(_seams(lines))
    across = across.withColumn("_joined", F.array_join(F.transform("_parts", lambda p: p["_text"]), "\n"))
    across = across.select(FILE, "_key", F.explode_outer(find_spans("_joined", chosen)).alias("s")).where("s is not null")
    return inside.union(across.select(FILE, *_moved("_key")))


def _moved(by: str) -> list:
    return [(F.col("s")[f] + F.col(by)).alias(f) if f in ("start", "end") else F.col("s")[f].alias(f) for f in _FIELDS]


def _with_offsets(lines: DataFrame) -> DataFrame:
    """Lines with ``_at``, the characters of their file before them."""
    splits = lines.groupBy(FILE, "_split").agg(F.sum("_chars").alias("_chars"))
    earlier = Window.partitionBy(FILE).orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    begins = splits.select(FILE, "_split", F.coalesce(F.sum("_chars").over(earlier), F.lit(0)).alias("_begin"))
    before = Window.partitionBy(FILE, "_split").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    within = lines.withColumn("_at", F.coalesce(F.sum("_chars").over(before), F.lit(0)))
    joined = within.join(small_side(begins), [FILE, "_split"])
    return joined.withColumn("_at", F.col("_at") + F.col("_begin")).drop("_begin")


def _seams(lines: DataFrame) -> DataFrame:
    """What lies around line ends: file, _split, _pos, _text, whether it may go on after (_opens) or before it (_joins)."""

    def part(pos, text, opens, joins):
        return F.struct(pos.alias("_pos"), F.col(text).alias("_text"), opens.alias("_opens"), joins.alias("_joins"))

    end_at = F.col("_at") + F.col("_chars") - 1 - F.length("_tail")
    parts = F.array(
        part(F.col("_at"), "_head", ~F.col("_closed"), F.lit(True)), part(end_at, "_tail", F.lit(True), F.lit(False))
    )
    rows = lines.select(FILE, "_split", F.explode(F.filter(parts, lambda p: p["_text"] != "")).alias("p"))
    return rows.select(FILE, "_split", "p.*")


def _chained(seams: DataFrame) -> DataFrame:
    """Neighbouring parts put together: file, _key (the offset of the first), _parts in order.

    Neighbours are found within splits; one row for each split carries a chain over to the next one.
    """
    after = F.when(F.col("_opens"), F.col("_pos") + F.length("_text") + 1)
    inside = Window.partitionBy(FILE, "_split").orderBy("_pos")
    goes_on = F.col("_joins") & F.lag(after).over(inside).eqNullSafe(F.col("_pos"))
    keyed = seams.withColumn("_first", F.when(~goes_on, F.col("_pos")))
    keyed = keyed.withColumn("_key", F.last("_first", ignorenulls=True).over(inside)).drop("_first")
    splits = keyed.groupBy(FILE, "_split").agg(
        F.min("_key").alias("_low"),
        F.max("_key").alias("_high"),
        F.min_by("_joins", "_pos").alias("_joins"),
        F.max_by(after, "_pos").alias("_after"),
    )
    order = Window.partitionBy(FILE).orderBy("_split")
    carried = F.col("_joins") & F.lag("_after").over(order).eqNullSafe(F.col("_low"))
    splits = splits.withColumn("_carried", carried)
    own = F.when(~(F.col("_carried") & (F.col("_low") == F.col("_high"))), F.col("_high"))
    splits = splits.withColumn("_root", F.last(own, ignorenulls=True).over(order))
    splits = splits.withColumn("_root", F.lag("_root").over(order)).where("_carried")
    moved = keyed.join(small_side(splits.select(FILE, F.col("_low").alias("_key"), "_root")), [FILE, "_key"], "left")
    parts = F.array_sort(F.collect_list(F.struct("_pos", "_text"))).alias("_parts")
    return moved.withColumn("_key", F.coalesce("_root", "_key")).groupBy(FILE, "_key").agg(parts)
