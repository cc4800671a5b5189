"""File kinds, output names and previews, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Known file kinds, and the length of a preview.
KINDS = ("csv", "xlsx", "xls", "txt", "json")
PREVIEW_CHARS = 2000

_EXTENSION = r"[^/]\.([^./]*)$"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def base_name(path: str | Column) -> Column:
    """Last part of a path."""
    return F.element_at(F.split(_col(path), "/", -1), -1)


def extension(path: str | Column) -> Column:
    """Lower-case extension; the empty string when there is none (dot files have none)."""
    return F.lower(F.regexp_extract(base_name(path), _EXTENSION, 1))


def file_kind(path: str | Column) -> Column:
    """csv, xlsx, xls, txt or json; anything else is handled as txt."""
    ext = extension(path)
    return F.when(ext.isin(*KINDS), ext).otherwise(F.lit("txt"))


def reported_extension(path: str | Column) -> Column:
    """The extension as reported: ``txt`` when the name has none."""
    ext = F.regexp_extract(base_name(path), _EXTENSION, 1)
    has = F.rlike(base_name(path), F.lit(_EXTENSION))
    return F.when(has, F.lower(ext)).otherwise(F.lit("txt"))


def output_name(path: str | Column) -> Column:
    """``{stem}_scrubbed.{ext}``; workbooks become csv, a missing extension too."""
    name = base_name(path)
    has = F.rlike(name, F.lit(_EXTENSION))
    stem = F.when(has, F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    stem = F.when(stem == "", F.lit("output")).otherwise(stem)
    ext = F.when(has, extension(path)).otherwise(F.lit("csv"))
    ext = F.when(ext.isin("xlsx", "xls"), F.lit("csv")).otherwise(ext)
    return F.concat(stem, F.lit("_scrubbed."), ext)


def preview(text: str | Column) -> Column:
    """The text, or its first 2000 characters and a note of the full length."""
    t = _col(text)
    note = F.concat(
        F.substring(t, 1, PREVIEW_CHARS),
        F.lit("...\n\n[Truncated - "),
        F.length(t).cast("string"),
        F.lit(" total characters]"),
    )
    return F.when(F.length(t) > PREVIEW_CHARS, note).otherwise(t)
