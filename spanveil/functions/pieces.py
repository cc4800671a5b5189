"""Cutting a text where no match can lie across the cut.

A cut is safe between white space and any neighbour but a decimal digit or a round bracket (no pattern takes two
white-space characters in a row, and none has another neighbour of white space), and on either side of a character
that no pattern takes and that is no word character. There, the characters a pattern looks back or ahead at make no
difference either, so spans found piece by piece, moved by the piece's place, are the spans of the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import let, running_scan, sql_str

# Characters of a piece, before the next safe cut is looked for.
PIECE_CHARS = 1 << 18

_JOINED = r"\p{Nd}()"  # may stand next to white space inside a match
_OUTSIDE = r"[^\w\s.%+\-@()/]"  # in no match, and no word character
SAFE_CUT = rf"(?:(?<=[^{_JOINED}])(?=\s)|(?<=\s)(?=[^{_JOINED}])|(?<={_OUTSIDE})|(?={_OUTSIDE}))"


def pieces_sql(text: str, piece_chars: int = PIECE_CHARS) -> str:
    """SQL text of ``ARRAY<STRUCT<start INT, piece STRING>>``: the text in pieces, each cut at the first safe place
    after ``piece_chars`` characters. A stretch without a safe place stays whole."""
    cutter = sql_str(rf"(?Us).{{{piece_chars}}}.*?{SAFE_CUT}|.+")
    starts = running_scan("transform(cut, c -> length(c))", state="0", next_state="acc.s + x", emit="acc.s")
    placed = let("starts", starts, "transform(cut, (c, i) -> named_struct('start', starts[i], 'piece', c))")
    cut = let("cut", f"regexp_extract_all(whole, {cutter}, 0)", placed)
    one = "array(named_struct('start', 0, 'piece', whole))"
    return let("whole", f"coalesce({text}, '')", f"if(length(whole) > {piece_chars}, {cut}, {one})")


def line_head(line: str) -> Column:
    """What of a line a match from the line before may take: up to its first safe cut; NULL if it has none."""
    return _edge(line, rf"(?Us)\A\n(.*?){SAFE_CUT}")


def line_tail(line: str) -> Column:
    """What of a line a match into the next line may take: from its last safe cut; NULL if it has none."""
    return _edge(line, rf"(?Us)\A.*{SAFE_CUT}(.*?)\n\z")


def _edge(line: str, pattern: str) -> Column:
    ended = F.concat(F.lit("\n"), F.col(line), F.lit("\n"))
    return F.get(F.regexp_extract_all(ended, F.lit(pattern), F.lit(1)), F.lit(0))
