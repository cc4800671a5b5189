"""Progress: rows and findings so far, for batch jobs and streams."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def progress_metrics(mark: str = "pii"):
    """Metrics over marked rows: rows processed, rows affected, findings, cells."""
    m = F.col(mark)
    return [
        F.count(F.lit(1)).alias("rows_processed"),
        F.count_if(m["found"] > 0).alias("rows_affected"),
        F.coalesce(F.sum(m["found"]), F.lit(0)).alias("pii_found"),
        F.coalesce(F.sum(m["cells"]), F.lit(0)).alias("cells_affected"),
    ]


def observe_batch(marked: DataFrame, name: str = "progress", mark: str = "pii") -> tuple[DataFrame, Observation]:
    """Totals gathered while the job itself runs: no second pass over the data."""
    seen = Observation(name)
    return marked.observe(seen, *progress_metrics(mark)), seen


def observe_stream(marked: DataFrame, name: str = "progress", mark: str = "pii") -> DataFrame:
    return marked.observe(name, *progress_metrics(mark))


@dataclass
class Progress:
    phase: str = "preparing"
    batches: int = 0
    rows_processed: int = 0
    rows_affected: int = 0
    pii_found: int = 0
    cells_affected: int = 0
    history: list = field(default_factory=list)


class ProgressListener(StreamingQueryListener):
    """Adds up the observed metrics of one stream's micro-batches."""

    def __init__(self, name: str = "progress", on_change=None):
        self.name = name
        self.progress = Progress()
        self.on_change = on_change

    def onQueryStarted(self, event):
        self.progress.phase = "scanning"

    def onQueryProgress(self, event):
        row = event.progress.observedMetrics.get(self.name)
        if row is None:
            return
        p = self.progress
        p.batches += 1
        for key in ("rows_processed", "rows_affected", "pii_found", "cells_affected"):
            setattr(p, key, getattr(p, key) + (row[key] or 0))
        p.history.append((event.progress.batchId, p.rows_processed, p.pii_found))
        if self.on_change:
            self.on_change(p)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.progress.phase = "failed" if event.exception else "complete"
