"""Token totals by source, language and tokenizer version, kept up to date by signed batches.

A batch inserts documents, deletes them, or revises their counts. It is turned into signed differences, old count
off and new count on, and only those touch the totals, which are sums of differences. A batch writes its document
rows and differences first and its commit marker last; readers see committed batches only. A batch that broke off is
written again from the start, and one that is committed already changes nothing, so every batch counts once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INSERT, DELETE, REVISE = "insert", "delete", "revise"

_DOCUMENT = "doc_id long, version string, source string, lang string, n_tokens long, live boolean, batch_no long"
_DELTA = "source string, lang string, version string, n_docs long, n_tokens long"

_LOADED: dict[str, tiktoken.Encoding] = {}


def _encoding(path: str, pattern: str) -> tiktoken.Encoding:
    if path not in _LOADED:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _LOADED[path] = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def count_tokens(docs: DataFrame, path: str, pattern: str, version: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, source, lang, version, n_tokens of every whole text; null and empty texts count 0."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), "source", "lang", F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path, pattern)
        for batch in batches:
            counts = [len(encoding.encode_ordinary(t.as_py() or "")) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("source"), batch.column("lang"), pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())],
                names=["doc_id", "source", "lang", "version", "n_tokens"],
            )

    return slim.mapInArrow(run, "doc_id long, source string, lang string, version string, n_tokens long")


class TokenRollup:
    """Totals in a folder that all executors share. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self._folder)
        self._files = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._spark._jvm.org.apache.hadoop.fs.Path(f"{self._folder}/{name}")

    def batches(self) -> dict[str, int]:
        """Committed batches and their numbers; one small marker each."""
        if not self._files.exists(self._path("commits")):
            return {}
        names = [s.getPath().getName() for s in self._files.listStatus(self._path("commits"))]
        return {name.split("-", 1)[1]: int(name.split("-", 1)[0]) for name in names}

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply ``changes`` (doc_id, version, action, source, lang, n_tokens, optional seq) once.

        False if the batch is committed already. A document and version has one current row: an insert or a revision
        replaces it, a delete of what is not there does nothing. Of several changes to one, that with the largest seq counts
        (without seq, or on a tie, a delete counts last, then the larger count). Rows without an id or version are left
        out, since nothing could revise them; a null count is 0; null source and language are groups of their own.
        """
        if "/" in batch_id or not batch_id:
            raise ValueError(f"no name for a batch: {batch_id!r}")
        done = self.batches()
        if batch_id in done:
            return False
        number = max(done.values(), default=0) + 1
        seq = F.col("seq").cast("long") if "seq" in changes.columns else F.lit(0).cast("long")
        wanted = changes.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("version").cast("string").alias("version"),
            F.struct(
                seq.alias("seq"), (F.lower("action") == DELETE).alias("gone"), F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens"),
                F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
            ).alias("change"),
        ).where("doc_id is not null and version is not null")
        last = wanted.groupBy("doc_id", "version").agg(F.max("change").alias("new"))
        both = last.join(self.documents(), ["doc_id", "version"], "left")
        rows = both.select(
            "doc_id", "version", F.col("new.source").alias("source"), F.col("new.lang").alias("lang"), F.col("new.n_tokens").alias("n_tokens"),
            (~F.col("new.gone")).alias("live"), F.lit(number).cast("long").alias("batch_no"),
            F.col("source").alias("old_source"), F.col("lang").alias("old_lang"), F.col("n_tokens").alias("old_tokens"),
        )
        part = f"{self._folder}/batches/{number}"
        rows.write.mode("overwrite").parquet(f"{part}/changes")
        written = self._spark.read.parquet(f"{part}/changes")
        on = written.where("live").select("source", "lang", "version", F.lit(1).alias("n_docs"), "n_tokens")
        off = written.where("old_tokens is not null").select(
            F.col("old_source").alias("source"), F.col("old_lang").alias("lang"), "version", F.lit(-1).alias("n_docs"), (-F.col("old_tokens")).alias("n_tokens")
        )
        deltas = on.union(off).groupBy("source", "lang", "version").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        deltas.coalesce(1).write.mode("overwrite").parquet(f"{part}/deltas")
        if not self._files.createNewFile(self._path(f"commits/{number:09d}-{batch_id}")):
            raise RuntimeError(f"batch number {number} was committed by another writer")
        return True

    def documents(self) -> DataFrame:
        """The current rows: doc_id, version, source, lang, n_tokens."""
        numbers = sorted(self.batches().values())
        if not numbers:
            return self._spark.createDataFrame([], _DOCUMENT).select("doc_id", "version", "source", "lang", "n_tokens")
        paths = [f"{self._folder}/batches/{n}/changes" for n in numbers]
        rows = self._spark.read.schema(_DOCUMENT).parquet(*paths)
        newest = rows.groupBy("doc_id", "version").agg(F.max(F.struct("batch_no", "live", "source", "lang", "n_tokens")).alias("now"))
        return newest.where("now.live").select("doc_id", "version", "now.source", "now.lang", "now.n_tokens")

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens: sums of committed differences, groups without documents left out."""
        numbers = sorted(self.batches().values())
        if not numbers:
            return self._spark.createDataFrame([], _DELTA)
        deltas = self._spark.read.schema(_DELTA).parquet(*[f"{self._folder}/batches/{n}/deltas" for n in numbers])
        sums = deltas.groupBy("source", "lang", "version").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0")


def rollup_totals(totals: DataFrame) -> DataFrame:
    """Totals with subtotals: level 0 is a group, 1 sums versions, 3 sums languages too, 7 is everything."""
    return (
        totals.rollup("source", "lang", "version")
        .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.grouping_id().cast("int").alias("level"))
    )
