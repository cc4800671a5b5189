"""Exact top-k by inner product with a three-phase uniform threshold.

The components are split into ``LISTS`` parts; each part gives every candidate a partial score, which is one list.

1. Each block of candidates names the best entries of each list. Their exact scores bound the k-th best from below.
2. That bound, divided by the number of lists, is the cutoff, which goes to every block. A candidate below it in every
   list cannot reach the bound, so each block gathers just the candidates with an entry at or above the cutoff.
3. The scores of those are resolved exactly where their other parts lie, in their block; it sends the ones that reach
   the bound.

Equal vectors are folded first, with their k + 1 smallest ids, each as often as it can enter an answer. Queries meet
candidates in blocks; what a task holds is bounded by the block sizes. Products are taken in doubles while those are
exact, and in whole numbers of any size otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanveil.sources.workspace import staged

LISTS = 4
BLOCK = 8192
QUERY_BLOCK = 1024
SALTS = 16
_LARGEST = 1.7976931348623157e308
_ENDS = -(1 << 63), (1 << 63) - 1  # of a long


def quantised(vectors: DataFrame, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, q): floor(scale * x) of each component, for rows with an id and only finite components.

    The whole numbers are doubles, which hold them exactly. Empty vectors count as valid and score 0. Components that
    no double holds once scaled count as the largest double.
    """
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # Beyond 2**53 a double is whole already; floor goes through a long and would not hold it.
    scaled = F.transform("v", lambda x: F.greatest(F.lit(-_LARGEST), F.least(F.lit(_LARGEST), x * scale)))
    whole = F.transform(scaled, lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x) + F.lit(0.0))
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite)
        .select("vec_id", whole.alias("q"))
    )


def _folded(rows: DataFrame, k: int) -> DataFrame:
    """(q, ids): different vectors with their k + 1 smallest ids, each up to k times; rows are dealt over salts first."""
    each = rows.groupBy("q", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("times"))
    salted = each.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    first = Window.partitionBy("q", "salt").orderBy("vec_id")
    few = salted.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1)
    listed = F.slice(F.array_sort(F.collect_list(F.struct("vec_id", "times"))), 1, k + 1)
    return few.groupBy("q").agg(F.flatten(F.transform(listed, lambda x: F.array_repeat(x["vec_id"], x["times"]))).alias("ids"))


def _matrix(values: pa.ListArray) -> np.ndarray:
    """Vectors of one block; shorter ones are filled up with zeros."""
    sizes = np.diff(values.offsets.to_numpy())
    flat = values.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == sizes[0]).all():
        return flat.reshape(len(sizes), sizes[0])
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    at = 0
    for i, n in enumerate(sizes):
        out[i, :n] = flat[at : at + n]
        at += n
    return out


def _blocks(df: DataFrame, size: int, name: str, *columns: str) -> DataFrame:
    """Rows gathered into blocks of about ``size``: (name, items). Returns the blocks, numbered from 0."""
    many = max(1, -(-df.count() // size))
    return (
        df.withColumn(name, F.pmod(F.xxhash64("rep"), F.lit(many)).cast("int"))
        .groupBy(name).agg(F.collect_list(F.struct("rep", "q", *columns)).alias(f"{name}_items"))
    )


def _meet(queries: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every query block with every candidate block."""
    names = [r["qb"] for r in queries.select("qb").collect()]  # block numbers
    dealt = blocks.select("cb_items", F.explode(F.array(*[F.lit(n) for n in names]).cast("array<int>")).alias("qb"))
    return dealt.join(queries.hint("shuffle_merge"), "qb").select("qb_items", "cb_items")


def _parts(width: int) -> list[slice]:
    edges = [width * i // LISTS for i in range(LISTS + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(query reps, query items, candidate reps, parts of partial scores) a few queries at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            q, c = batch.column("qb_items")[i].values, batch.column("cb_items")[i].values
            qm, cm = _matrix(q.field("q")), _matrix(c.field("q"))
            width = max(qm.shape[1], cm.shape[1])
            qm, cm = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (qm, cm))
            reps, parts = c.field("rep").to_numpy(zero_copy_only=False), _parts(width)
            qm, cm = _exact_kind(qm, cm)
            for at in range(0, len(qm), 128):
                some = q.slice(at, 128)
                scores = [qm[at : at + 128, p] @ cm[:, p].T for p in parts]
                yield some, reps, scores


def _exact_kind(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices as doubles, longs or Python integers: the fastest whose products and sums are exact."""
    width = max(a.shape[-1], 1)
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * width
    if most < 1 << 53:
        return a, b
    if most < 1 << 63:
        return a.astype(np.int64), b.astype(np.int64)
    return tuple(np.array([int(x) for x in m.ravel().tolist()], dtype=object).reshape(m.shape) for m in (a, b))


def _longs(values: np.ndarray) -> pa.Array:
    """Whole numbers as longs; what no long holds counts as its nearest end."""
    if values.dtype == object:
        return pa.array([min(max(int(x), _ENDS[0]), _ENDS[1]) for x in values.tolist()], pa.int64())
    return pa.array(values.astype(np.int64))


def _partitioned(few: int):
    return lambda scores, axis: np.argpartition(scores, few - 1, axis=axis)


def _local_best(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, reps, scores in _pairs(batches):
            queries = some.field("rep").to_numpy(zero_copy_only=False)
            few = min(k, len(reps))
            for part, s in enumerate(scores):
                best = (np.argsort if s.dtype == object else _partitioned(few))(-s, axis=1)[:, :few]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(queries, few)), pa.array(np.full(best.size, part, np.int32)), pa.array(reps[best.ravel()]),
                     _longs(np.take_along_axis(s, best, axis=1).ravel())],
                    names=["query", "part", "rep", "partial"],
                )

    return run


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates with an entry at or above the cutoff, resolved, if they reach the bound (all, if there is none)."""
    for some, reps, scores in _pairs(batches):
        queries = some.field("rep").to_numpy(zero_copy_only=False)
        bounds = some.field("bound")
        bound = bounds.fill_null(_ENDS[0]).to_numpy(zero_copy_only=False)[:, None]
        unbound = bound == _ENDS[0]
        cutoff = bound // LISTS + (bound % LISTS > 0)
        row, col = np.nonzero(unbound | np.any([(s >= cutoff).astype(bool) for s in scores], axis=0))
        total = _longs(sum(s[row, col] for s in scores)).to_numpy()
        reach = unbound[row, 0] | (total >= bound[row, 0])
        yield pa.RecordBatch.from_arrays([pa.array(queries[row[reach]]), pa.array(reps[col[reach]]), pa.array(total[reach])], names=["query", "rep", "score"])


def _whole_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = _matrix(batch.column("query_q")), _matrix(batch.column("q"))
        width = max(x.shape[1], y.shape[1]) if batch.num_rows else 0
        x, y = _exact_kind(*(np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, y)))
        yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("rep"), _longs((x * y).sum(axis=1))], names=["query", "rep", "score"])


def _exact(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """(query, rep, score) with whole inner products."""
    own = reps.select(F.col("rep").alias("query"), F.col("q").alias("query_q"))
    both = pairs.join(own, "query").join(reps.select("rep", "q"), "rep").select("query", "rep", "query_q", "q")
    return both.mapInArrow(_whole_products, "query long, rep long, score long")


def top_k(vectors: DataFrame, k: int, every: int, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of each row whose id is divisible by ``every``.

    Ties go to the smaller id; a query has fewer rows if there are fewer others. Rows without an id or with a null
    vector, a null or a non-finite component take no part. A repeated row is a candidate as often as it is there; a
    repeated query has its candidates as often as it is there. An id with several different vectors counts as several
    rows, of which none answers another. A score that no long holds counts as the nearest end of a long.
    """
    rows = staged(quantised(vectors, scale, id_col, vec_col), "quantised")
    most = k + 1  # a query's own vector may be among the best
    reps = staged(_folded(rows, k).select(F.col("ids")[0].alias("rep"), "q", "ids", F.xxhash64("q").alias("h")), "reps")
    asked = staged(
        rows.where(F.col("vec_id") % every == 0).groupBy("vec_id", "q").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("times"))
        .withColumn("h", F.xxhash64("q")).join(reps.select("h", "q", "rep"), ["h", "q"])
        .select(F.col("vec_id").alias("query_id"), F.col("rep").alias("query"), "times"),
        "asked",
    )
    queries = asked.select(F.col("query").alias("rep")).distinct().join(reps.select("rep", "q"), "rep")
    blocks = staged(_blocks(reps.select("rep", "q"), BLOCK, "cb"), "blocks")

    best = _meet(staged(_blocks(queries, QUERY_BLOCK, "qb"), "queries"), blocks).mapInArrow(_local_best(most), "query long, part int, rep long, partial long")
    leading = Window.partitionBy("query", "part").orderBy(F.desc("partial"), "rep")
    heads = best.withColumn("nth", F.row_number().over(leading)).where(F.col("nth") <= most).select("query", "rep").distinct()
    known = _exact(heads, reps)
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    bounds = known.withColumn("nth", F.row_number().over(by_score)).where(F.col("nth") == most).select(F.col("query").alias("rep"), F.col("score").alias("bound"))

    cut = staged(_blocks(queries.join(bounds, "rep", "left"), QUERY_BLOCK, "qb", "bound"), "bounds")
    scored = _meet(cut, blocks).mapInArrow(_resolved, "query long, rep long, score long")
    answers = scored.join(reps.select("rep", "ids"), "rep").select("query", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    shortlist = answers.withColumn("nth", F.dense_rank().over(order)).where(F.col("nth") <= most).select("query", "score", "vec_id")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        asked.select("query_id", "query", F.explode(F.array_repeat(F.lit(1), F.col("times"))).alias("time"))
        .join(shortlist, "query").where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
