"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

A line is a sequence of words; one edit inserts, drops or replaces one word. Two lines are within one edit if they
share a variant with one word deleted at the same place, or if one is the other's variant. The steps:

1. Equal lines are folded into their earliest occurrence (partial sums, so a line that fills a third of the table
   sends one row for each task).
2. Within one edit, the words before or the words after the middle stay equal. Lines that share neither half with
   another line have no partner and need no variants; this drops nothing that could match.
3. The others emit every one-word deletion as a hashed key: two sums (exclusive or) of position-dependent word hashes,
   made inside the row, so each variant costs the same whatever the length of the line.
4. Equal keys meet in a group, which names its earliest line; no pairs within a group are formed.
5. Each line's earliest partner is verified word by word, and the later line goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.sources.workspace import staged

# Lines of fewer words are repeats only if they are equal: the edit bound is 0 below so many words and 1 from there on.
MIN_WORDS = 8

_BLANKS = "[\\t\\x0B\\f\\r]"  # other blanks than a space
_GAPS = "[ \\t\\x0B\\f\\r]+"
_LINES = 1 << 31  # more than any text has lines
# The exclusive or of each prefix of an array, by doubling: a fold that appends would copy what it has at every step.
_PREFIXES = (
    "aggregate(transform(sequence(0, cast(ceil(log2(n)) as int)), k -> shiftleft(1, k)), {0}, "
    "(acc, g) -> transform(acc, (x, i) -> if(i >= g, x ^ acc[i - g], x)))"
)


def _words(line: Column) -> Column:
    """The words of a line; only one that holds other blanks than spaces takes the slower split."""
    return F.array_remove(F.when(line.rlike(_BLANKS), F.split(line, _GAPS)).otherwise(F.split(line, " ")), "")


def _place(doc: str, line: str) -> Column:
    """Document and line as one number in reading order, which aggregates keep in place."""
    return (F.col(doc).cast("decimal(20,0)") * F.lit(_LINES) + F.col(line)).cast("decimal(38,0)")


def _half_keys(words: Column, n: Column) -> Column:
    """Hashes of the halves that stay equal if the line is the shorter (n) or the longer (n - 1) of a pair."""
    keys = []
    for shorter in (n, n - 1):
        head = F.floor(shorter / 2).cast("int")
        tail = (shorter - head).cast("int")
        keys.append(F.xxhash64(F.lit("head"), shorter, F.slice(words, F.lit(1), head)))
        keys.append(F.xxhash64(F.lit("tail"), shorter, F.slice(words, (n - tail + 1).cast("int"), tail)))
    return F.array(*keys)


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, line, h1, h2, n, halves) for each line with words; halves are null below ``min_words``."""
    halves = F.when(F.col("n") >= min_words, _half_keys(F.col("words"), F.col("n")))
    return (
        docs.where("doc_id is not null")
        # split inside the generator: the filter below would split once more
        .select("doc_id", F.posexplode(F.transform(F.split("text", "\n", -1), _words)).alias("line", "words"))
        .where(F.size("words") > 0)
        .select("doc_id", "line", F.xxhash64("words").alias("h1"), F.xxhash64(F.lit(7), "words").alias("h2"), F.size("words").alias("n"), "words")
        .select("doc_id", "line", "h1", "h2", "n", halves.alias("halves"))
    )


def _distinct_lines(rows: DataFrame) -> DataFrame:
    """One row for each different line: its hashes, earliest place, size and half keys."""
    placed = rows.select("h1", "h2", "n", _place("doc_id", "line").alias("place"), "halves")
    parts = [F.first(F.col("halves")[i]).alias(f"half{i}") for i in range(4)]
    return placed.groupBy("h1", "h2").agg(F.min("place").alias("place"), F.count("*").alias("times"), F.first("n").alias("n"), *parts)


def _close_candidates(lines: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, line, place) of the lines that share a half with another line."""
    halves = lines.where(F.col("n") >= min_words).select("place", F.explode(F.array(*[f"half{i}" for i in range(4)])).alias("half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("lines")).where("lines > 1").select("half")
    line = F.pmod(F.col("place"), F.lit(_LINES).cast("decimal(38,0)"))
    return (
        halves.join(shared, "half", "left_semi").select("place").distinct()
        .select("place", line.cast("int").alias("line"), ((F.col("place") - line) / F.lit(_LINES)).cast("long").alias("doc_id"))
    )


def _with_words(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(place, words) of the given lines, cut out of their documents."""
    wanted = places.groupBy("doc_id").agg(F.collect_list(F.struct("line", "place")).alias("wanted"))

    def cut(lines: Column) -> Column:
        # inside the generator, so a text is split once and not once for each of its lines
        return F.transform("wanted", lambda w: F.struct(w["place"].alias("place"), lines[w["line"]].alias("line_text")))

    return (
        docs.join(wanted, "doc_id")
        .select(F.explode(F.transform(F.array(F.split("text", "\n", -1)), cut)[0]).alias("one"))
        .select(F.col("one.place").alias("place"), _words(F.col("one.line_text")).alias("words"))
    )


def _variants(lines: DataFrame) -> DataFrame:
    """(place, kind, n, at, a, b): every one-word deletion of each line, and the lines themselves.

    kind 0: the word at ``at`` deleted, for lines of equal length; kind 1: a word deleted, to meet a line of one
    word less; kind 2: a line as it is, to meet those. A key is the exclusive or of hashes of (word, position): with
    a word deleted, the words after it stand one place earlier, so the key of the next deletion differs by two hashes.
    """
    keys = lines.select("place", "words", F.size("words").cast("int").alias("n"))
    for name, seed in (("a", 1), ("b", 2)):
        here, back = (f"transform(words, (w, i) -> xxhash64({seed}, w, i - {shift}))" for shift in (0, 1))
        whole = "aggregate({0}, 0L, (s, x) -> s ^ x)"
        moves = f"transform({name}_back, (x, i) -> if(i = 0, x ^ {name}_moved, x ^ {name}_here[i - 1]))"
        keys = (
            keys.withColumns({f"{name}_here": F.expr(here), f"{name}_back": F.expr(back)})
            .withColumns({f"{name}_all": F.expr(whole.format(f"{name}_here")), f"{name}_moved": F.expr(whole.format(f"{name}_back"))})
            .withColumn(f"{name}_cut", F.expr(_PREFIXES.format(moves)))
        )
    key = "named_struct('kind', {0}, 'n', {1}, 'at', {2}, 'a', {3}, 'b', {4})"
    alike = "transform(a_here, (x, i) -> " + key.format(0, "n", "i", "a_all ^ x", "b_all ^ b_here[i]") + ")"
    longer = "transform(a_cut, (x, i) -> " + key.format(1, "n - 1", -1, "x", "b_cut[i]") + ")"
    whole_line = "array(" + key.format(2, "n", -1, "a_all", "b_all") + ")"
    return keys.select("place", F.expr(f"inline(concat({alike}, {longer}, {whole_line}))"))


def _partners(variants: DataFrame) -> DataFrame:
    """(place, partner): the earliest earlier line that shares a variant, for each line that has one."""
    keyed = variants.withColumn("whole", F.col("kind") == 2).withColumn("kind", F.least("kind", F.lit(1)))
    names = ["kind", "n", "at", "a", "b"]
    groups = (
        keyed.groupBy(*names)
        .agg(F.min("place").alias("first"), F.max("place").alias("last"), F.min(F.when(F.col("whole"), F.col("place"))).alias("full"),
             F.min(F.when(~F.col("whole"), F.col("place"))).alias("cut"))
        .where("first < last")
    )
    other = F.when(F.col("kind") == 0, F.col("first")).when(F.col("whole"), F.col("cut")).otherwise(F.col("full"))
    return (
        keyed.join(groups, names).withColumn("partner", other).where("partner < place")
        .groupBy("place").agg(F.min("partner").alias("partner"))
    )


def _one_edit(a: str, b: str) -> Column:
    """Whether two word arrays differ by one insertion, deletion or replacement at most."""
    return F.expr(
        f"""case when abs(size({a}) - size({b})) > 1 then false else element_at(transform(
            array(cast(coalesce(nullif(array_position(zip_with({a}, {b}, (x, y) -> x <=> y), false), 0), size({a}) + 1) as int)),
            p -> slice({a}, p + if(size({a}) >= size({b}), 1, 0), greatest(size({a}) - p + if(size({a}) >= size({b}), 0, 1), 0))
               = slice({b}, p + if(size({b}) >= size({a}), 1, 0), greatest(size({b}) - p + if(size({b}) >= size({a}), 0, 1), 0))), 1) end"""
    )


def near_repeats(docs: DataFrame, lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Places of different lines (of ``lines``) that are within one edit of an earlier one."""
    close = staged(_with_words(docs, _close_candidates(lines, min_words)), "close-lines")
    partners = _partners(staged(_variants(close), "variants"))
    texts = close.groupBy("place").agg(F.first("words").alias("words"))
    return (
        partners.join(texts.withColumnRenamed("words", "own"), "place")
        .join(texts.select(F.col("place").alias("partner"), F.col("words").alias("other")), "partner")
        .where(_one_edit("own", "other")).select("place")
    )


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, line_nos): the lines, counted from 0, of which an earlier one is equal or within one word.

    Earlier means a smaller document id or, in the same document, a smaller line number; both lines are judged
    as they are in the input. The word may differ if both lines have ``min_words`` words or more; shorter lines are
    repeats only if all their words are equal. Blank lines, null texts and rows without an id have no repeated lines. Rows that
    repeat a document id count as one document and lose the same lines.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = staged(_lines(slim, min_words), "all-lines")
    lines = staged(_distinct_lines(rows), "lines")
    near = staged(near_repeats(slim, lines, min_words), "near-lines").withColumn("near", F.lit(True))
    marks = (
        lines.join(near, "place", "left").where("times > 1 or near")
        .select("h1", "h2", F.col("place").alias("first"), F.coalesce("near", F.lit(False)).alias("near"))
    )
    return (
        rows.select("doc_id", "line", "h1", "h2").join(marks, ["h1", "h2"])
        .where(F.col("near") | (F.col("first") < _place("doc_id", "line")))
        .groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("line_nos"))
    )


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated lines taken out of the text, and columns n_lines and n_removed; all rows stay.

    A text all of whose lines go becomes empty; a null text stays null, with no lines. Columns of the input named
    n_lines or n_removed give way to the new ones.
    """
    gone = repeated_lines(docs, id_col, text_col, min_words).select(F.col("doc_id").alias("gone_id"), "line_nos")
    whole = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("gone_id"))
    text = F.col("row").getField(text_col)
    lines = F.split(text.cast("string"), "\n", -1)
    kept = F.concat_ws("\n", F.filter(lines, lambda _, i: ~F.array_contains("line_nos", i)))
    new = {text_col: F.when(F.col("line_nos").isNull(), text).otherwise(kept)}
    new["n_lines"] = F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long")
    new["n_removed"] = F.coalesce(F.size("line_nos"), F.lit(0)).cast("long")
    columns = [c for c in docs.columns if c not in new or c == text_col]
    return whole.join(gone, "gone_id", "left").select(
        *[new.get(c, F.col("row").getField(c)).alias(c) for c in columns], new["n_lines"].alias("n_lines"), new["n_removed"].alias("n_removed")
    )
