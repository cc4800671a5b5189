"""Quality rules by compression bands.

Base rules count words, symbols, repeated lines and words in repeated 8-word windows; too few words or too many
repeated ones fail a text. Then zstandard compresses the whole text and each of its fixed chunks. A ratio (bytes
before by bytes after) above its band means repetition, one below it means text that does not compress, such as
encoded data or noise. Short texts compress worse, so every band holds for texts of one length.

Counts and verdicts are Spark expressions over one row, without a shuffle. Spark has no zstandard function, so the
compressed sizes alone come from an Arrow function that hands back one small list for each text.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACES = "[\\x20\\x09-\\x0D]+"
_WORD = "[^\\x20\\x09-\\x0D]"
_SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rules:
    """Limits of the rules.

    ``bands``: (least bytes, lowest ratio, highest ratio), by rising length; a text or chunk takes the last band whose
    least bytes it has. A text fails if its own ratio leaves its band, or more than ``odd_share`` of its chunks do.
    """

    window: int = 8
    least_words: int = 20
    repeat_percent: int = 30
    chunk_bytes: int = 4096
    level: int = 3
    odd_share: float = 0.2
    bands: tuple[tuple[int, float, float], ...] = (
        (0, 0.70, 2.2),
        (128, 0.90, 2.4),
        (256, 1.10, 2.6),
        (1024, 1.30, 2.9),
        (4096, 1.40, 3.3),
        (16384, 1.45, 4.0),
    )


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once."""
    return F.transform(F.array(value), body)[0]


def _window_hashes(hashes: Column, have: int, window: int, body) -> Column:
    """``body`` of the hashes of every ``window`` words, from those of every ``have`` words, by doubling."""
    if have == window:
        return body(hashes)
    step = min(have, window - have)
    count = F.size(hashes) - step
    joined = F.zip_with(F.slice(hashes, F.lit(1), count), F.slice(hashes, F.lit(step + 1), count), lambda a, b: F.xxhash64(a, b))
    return _let(joined, lambda longer: _window_hashes(longer, have + step, window, body))


def repeated_words(words: Column, window: int) -> Column:
    """How many words lie in windows of ``window`` words that the array holds twice or more, first ones included.

    Hashes tell quickly that nothing is repeated; otherwise the windows themselves are sorted and compared. ``words``
    is used several times: bind it once.
    """
    def at(i: Column) -> Column:
        return F.slice(words, (i + 1).cast("int"), F.lit(window))

    def covered(ranked: Column) -> Column:
        def same(x: Column, other: Column) -> Column:
            return (x["h"] == other["h"]) & (x["k"] == other["k"])

        last = F.size(ranked) - 1
        twice = F.filter(ranked, lambda x, j: F.when((j > 0) & same(x, ranked[j - 1]), True).otherwise((j < last) & same(x, ranked[j + 1])))
        places = F.sort_array(F.transform(twice, lambda x: x["p"]))
        return _let(places, lambda p: F.aggregate(
            F.transform(p, lambda x, j: F.when(j < F.size(p) - 1, F.least(F.lit(window), p[j + 1] - x)).otherwise(window)), F.lit(0).cast("long"), lambda s, x: s + x))

    def from_hashes(hashes: Column) -> Column:
        keyed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), at(i).alias("k"), i.alias("p")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_let(F.sort_array(keyed), covered))

    each = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < window, F.lit(0).cast("long")).otherwise(_let(each, lambda a: _window_hashes(a, 1, window, from_hashes)))


def base_counts(text: Column, window: int = 8) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; text must not be null."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(_WORD))

    def counted(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.size(F.split(text, _SYMBOLS, -1)) - 1).cast("long").alias("n_symbols"),
            _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(w, window).alias("n_repeat_words"),
        )

    return _let(F.filter(F.split(text, _SPACES, -1), lambda x: x != ""), counted)


def compressed_sizes(text: Column, chunk_bytes: int, level: int) -> Column:
    """Array of zstandard sizes in bytes: the whole UTF-8 text, then each chunk of ``chunk_bytes``. Null text: null.

    What is left after the last whole chunk belongs to that one if it is shorter than half a chunk.
    """

    @F.arrow_udf("array<long>")
    def sizes(texts: pa.Array) -> pa.Array:
        from zstandard import ZstdCompressor

        squeeze = ZstdCompressor(level=level, write_content_size=False).compress

        def of(text: str | None) -> list[int] | None:
            if text is None:
                return None
            raw = text.encode("utf-8", "surrogatepass")
            edges = [*range(0, max(len(raw) - chunk_bytes // 2, min(1, len(raw))), chunk_bytes), len(raw)]
            whole = len(squeeze(raw))
            if len(edges) <= 2:
                return [whole] * len(edges)
            return [whole, *(len(squeeze(raw[a:b])) for a, b in zip(edges, edges[1:], strict=False))]

        return pa.array([of(t.as_py()) for t in texts], pa.list_(pa.int64()))

    return sizes(text)


def _side(n_bytes: Column, ratio: Column, rules: Rules) -> Column:
    """1 above the band of this length, -1 below it, 0 within."""
    low, high = F.lit(rules.bands[0][1]), F.lit(rules.bands[0][2])
    for least, lowest, highest in rules.bands[1:]:
        low, high = F.when(n_bytes >= least, lowest).otherwise(low), F.when(n_bytes >= least, highest).otherwise(high)
    return F.when(ratio > high, 1).when(ratio < low, -1).otherwise(0)


def judged(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, the counts of ``base_counts``, base_failed, ratio, n_chunks, n_odd_chunks,
    reason (null for kept ones: ``words``, ``repeated``, ``repetitive`` or ``incompressible``) and kept.

    Null and empty texts have no words, no chunks and a null ratio, and fail. Repeated rows and null ids are judged
    like any other; other columns are not read.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sized = slim.withColumn("sizes", compressed_sizes(F.col("text"), rules.chunk_bytes, rules.level))
    measured = sized.select("doc_id", "sizes", F.octet_length("text").cast("long").alias("n_bytes"), base_counts(F.col("text"), rules.window).alias("base"))

    def chunk_side(size: Column, i: Column) -> Column:
        rest = F.col("n_bytes") - i.cast("long") * rules.chunk_bytes
        length = F.when(i == F.size("sizes") - 2, rest).otherwise(rules.chunk_bytes)
        return _side(length, length / size, rules)

    sides = F.transform(F.slice("sizes", 2, F.greatest(F.size("sizes") - 1, F.lit(0))), chunk_side)
    counted = measured.select("doc_id", "n_bytes", "base.*", (F.col("n_bytes") / F.col("sizes")[0]).alias("ratio"), sides.alias("sides"))
    whole = _side(F.col("n_bytes"), F.col("ratio"), rules)
    up, down = F.size(F.filter("sides", lambda s: s == 1)), F.size(F.filter("sides", lambda s: s == -1))
    many = F.size("sides") * rules.odd_share
    few_words = F.col("n_words") < rules.least_words
    repeated = 100 * F.col("n_repeat_words") > rules.repeat_percent * F.col("n_words")
    reason = (
        F.when(few_words, "words").when(repeated, "repeated")
        .when((whole > 0) | (up > many), "repetitive").when((whole < 0) | (down > many), "incompressible")
    )
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (few_words | repeated).alias("base_failed"),
        F.when(F.col("n_bytes") > 0, F.col("ratio")).alias("ratio"), F.size("sides").cast("long").alias("n_chunks"), (up + down).cast("long").alias("n_odd_chunks"),
        reason.alias("reason"), reason.isNull().alias("kept"),
    )


def keep_good(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text fails, all columns as they are."""
    at = "".join(docs.columns) + "_row"  # longer than any column, so it clashes with none
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    marked = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias(at), text.alias("text"))
    return judged(marked, rules, at, "text").where("kept").select("doc_id.*")
