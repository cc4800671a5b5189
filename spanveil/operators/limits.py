"""Quotas: file size, rows, files per batch, cells, and allowed types."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.workspace import small_side


@dataclass(frozen=True)
class Quota:
    """Upper bounds for a run; ``None`` means unlimited."""

    max_file_bytes: int | None = None
    max_rows_per_file: int | None = None
    max_files: int | None = None
    max_cells_per_file: int | None = None
    allowed_types: tuple[str, ...] | None = None


UNLIMITED = Quota()

# The limited tier.
LIMITED = Quota(5 * 1024 * 1024, 10_000, 3, 100_000, ("email", "phone", "ssn", "credit_card"))


class QuotaExceeded(ValueError):
    """A batch breaks a quota that concerns the batch as a whole."""


def _error(value: Column, limit: int | None, text: Column) -> Column:
    return F.when(value > limit, text) if limit is not None else F.lit(None).cast("string")


def size_error(size_bytes: Column, quota: Quota) -> Column:
    """Message for a file over the size quota, otherwise NULL."""
    mb = 1048576.0
    text = F.format_string(
        "File size (%.2f MB) exceeds the limit (%.2f MB)", size_bytes / mb, F.lit((quota.max_file_bytes or 0) / mb)
    )
    return _error(size_bytes, quota.max_file_bytes, text)


def row_error(rows: Column, quota: Quota) -> Column:
    """Message for a file over the row quota: the whole file fails, it is not cut."""
    text = F.format_string("Row count (%d) exceeds the limit (%d)", rows, F.lit(quota.max_rows_per_file or 0))
    return _error(rows, quota.max_rows_per_file, text)


def cell_error(cells: Column, quota: Quota) -> Column:
    """Message for a file over the cell quota. Off unless called for."""
    text = F.format_string("Cell count (%d) exceeds the limit (%d)", cells, F.lit(quota.max_cells_per_file or 0))
    return _error(cells, quota.max_cells_per_file, text)


def batch_error(files: Column, quota: Quota) -> Column:
    """Message for a batch with too many files, otherwise NULL."""
    text = F.format_string("Batch size (%d files) exceeds the limit (%d files)", files, F.lit(quota.max_files or 0))
    return _error(files, quota.max_files, text)


def validate_files(files: DataFrame, quota: Quota) -> DataFrame:
    """Status of a file list ``(file, size_bytes)``: batch quota first, then sizes.

    The list is counted only when there is a batch quota; the count is one number.
    """
    n_files = files.count() if quota.max_files is not None else 0
    error = F.coalesce(batch_error(F.lit(n_files), quota), size_error(F.col("size_bytes"), quota))
    return files.select("file", "size_bytes", error.isNull().alias("success"), error.alias("error"))


def stop_at_quota(rows: DataFrame, quota: Quota, at: list[str], file: str = "file") -> DataFrame:
    """The first rows of each file by ``at``, at most one more than the row quota: enough to judge and to fail a file.

    Each task drops what exceeds the quota before anything is sent, so costly work that follows is done for no more than
    the quota's rows of a file. A task sends at most quota + 1 rows of a file, however large the file is.
    """
    if quota.max_rows_per_file is None:
        return rows
    place = F.row_number().over(Window.partitionBy(file).orderBy(*at))
    return rows.withColumn("_place", place).where(F.col("_place") <= quota.max_rows_per_file + 1).drop("_place")


def stopped_error(rows: Column, quota: Quota) -> Column:
    """Message for a file that :func:`stop_at_quota` stopped: its rows were not all read, so it names no count."""
    text = F.format_string("Row count exceeds the limit (%d)", F.lit(quota.max_rows_per_file or 0))
    return _error(rows, quota.max_rows_per_file, text)


def type_error(requested: Column, quota: Quota) -> Column:
    """Message for a canonical type id outside the allowed list, otherwise NULL."""
    if quota.allowed_types is None:
        return F.lit(None).cast("string")
    text = F.format_string("PII type '%s' is not among the allowed types", requested)
    return F.when(~requested.isin(*quota.allowed_types), text)


def split_by_status(rows: DataFrame, status: DataFrame, file: str = "file") -> tuple[DataFrame, DataFrame]:
    """Rows of files that passed, and the failing files.

    An anti join on the failing side only: files with no status row stay in.
    """
    failed = status.where("not success").select(file, "error")
    return rows.join(small_side(failed.select(file)), file, "left_anti"), failed
