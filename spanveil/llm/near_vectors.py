"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

A rotation of the principal axes is learnt on a bounded sample for each length of vector, so that the signs of the
rotated components make balanced codes that keep angles. A code is cut into ``TABLES`` parts. Codes that differ in at most
``2 * TABLES - 1`` bits agree in one part up to one bit, so each vector probes every table with its part and
all its one-bit changes. What is found is reranked with the original vectors in double precision.

Equal vectors of a label are folded before, and counted, so a vector that fills a third of the table is one entry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanveil.llm.components import connected_components
from spanveil.sources.workspace import staged

COSINE = 0.93
BITS = 64
TABLES = 6
# Vectors that fit the rotations: all lengths share FIT_ROWS, each has at least LEAST_FIT_ROWS if there are as many.
FIT_ROWS = 20_000
LEAST_FIT_ROWS = 256
LEAST_PER_BIT = 4
ROUNDS = 50


class Rotation:
    """Centre and projection whose signs are the code.

    Fewer than ``LEAST_PER_BIT`` vectors for each bit say nothing about the others: then the rotation is a random one
    about the origin, whose signs keep angles too.
    """

    def __init__(self, sample: np.ndarray, bits: int = BITS, rounds: int = ROUNDS, seed: int = 11):
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        size = sample.shape[1]
        if len(sample) < LEAST_PER_BIT * min(bits, size):
            self.centre = np.zeros(size)
            self.projection = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))[0][:, : min(bits, size)]
            return
        self.centre = unit.mean(axis=0)
        moved = unit - self.centre
        _, vectors = np.linalg.eigh(moved.T @ moved)
        axes = vectors[:, ::-1][:, : min(bits, sample.shape[1])]
        low = moved @ axes
        turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((axes.shape[1], axes.shape[1])))[0]
        for _ in range(rounds):
            left, _, right = np.linalg.svd(np.where(low @ turn >= 0, 1.0, -1.0).T @ low)
            turn = (left @ right).T
        self.projection = axes @ turn

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        signs = (unit - self.centre) @ self.projection >= 0
        weights = np.left_shift(np.uint64(1), np.arange(signs.shape[1], dtype=np.uint64))
        return (signs * weights).sum(axis=1, dtype=np.uint64).view(np.int64)


def _valid(label: str, vec: str) -> Column:
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(label).isNotNull() & F.col(vec).isNotNull() & finite & F.exists(vec, lambda x: x != 0)


def _parts(bits: int) -> list[tuple[int, int]]:
    """First bit and width of each table's part."""
    edges = [bits * t // TABLES for t in range(TABLES + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _probes(coded: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """(label, width, table, part) rows of the index, and of the probes: the part and its one-bit changes."""
    def part(start: int, width: int) -> Column:
        return F.shiftrightunsigned("code", start).bitwiseAND(F.lit((1 << width) - 1))

    exact = F.array(*[F.struct(F.lit(t).alias("table"), part(s, w).alias("part")) for t, (s, w) in enumerate(_parts(bits))])
    near = F.array(
        *[
            F.struct(F.lit(t).alias("table"), part(s, w).bitwiseXOR(F.lit(flip)).alias("part"))
            for t, (s, w) in enumerate(_parts(bits))
            for flip in [0, *(1 << i for i in range(w))]
        ]
    )
    rows = [coded.withColumn("at", F.explode(keys)).select("label", "width", "at.table", "at.part", "rep", "code") for keys in (exact, near)]
    return rows[0], rows[1]


def candidate_pairs(coded: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b), a < b: codes of one label and length that some table brings together and that differ in few enough bits."""
    index, probes = _probes(coded, bits)
    met = probes.withColumnsRenamed({"rep": "a", "code": "code_a"}).join(index.withColumnsRenamed({"rep": "b", "code": "code_b"}), ["label", "width", "table", "part"])
    near = met.where("a < b").where(F.bit_count(F.col("code_a").bitwiseXOR(F.col("code_b"))) <= 2 * TABLES - 1)
    return near.select("a", "b").distinct()


def _cosine(a: str, b: str) -> Column:
    def dot(x: str, y: str) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def near_vectors(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for each row: links join rows of one label with cosine >= ``cosine``.

    Rows without an id, label or vector, with a zero vector, or with a null or non-finite component link with
    nothing and stay. Vectors of different length don't link. Repeated rows are rows of their own, and link.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = staged(rows.withColumn("ok", F.coalesce(_valid("label", "v") & F.col("vec_id").isNotNull(), F.lit(False))), "vectors")
    valid = rows.where("ok").withColumn("h", F.xxhash64("label", "v"))
    reps = staged(valid.groupBy("h", "label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("rows")), "vector-reps")
    links = _links(reps, cosine)
    if links is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = staged(links, "vector-links")
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    beside = both.join(reps.select(F.col("rep").alias("b"), "rows"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("rows").alias("beside"))
    labels = connected_components(links).select(F.col("id").alias("rep"), "component")
    facts = (
        reps.join(beside, "rep", "left").join(labels, "rep", "left")
        .select("h", F.col("v").alias("rep_v"), F.col("label").alias("rep_label"),
                (F.coalesce("beside", F.lit(0)) + F.col("rows") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    same = (F.col("rep_v") == F.col("v")) & (F.col("rep_label") == F.col("label"))
    found = valid.join(facts, "h").where(same).select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def rotations(reps: DataFrame) -> dict[int, Rotation]:
    """A rotation for each length of vector, fitted on the vectors of that length with the smallest hashes."""
    widths = reps.select(F.size("v").alias("width")).distinct().count()
    each = max(LEAST_FIT_ROWS, FIT_ROWS // max(1, widths))
    by_hash = Window.partitionBy("width").orderBy("h", "rep")
    sample = reps.select(F.size("v").alias("width"), "h", "rep", "v").withColumn("nth", F.row_number().over(by_hash)).where(F.col("nth") <= each)
    rows: dict[int, list] = {}
    for r in sample.select("width", "v").collect():  # at most FIT_ROWS, or LEAST_FIT_ROWS of each length
        rows.setdefault(r["width"], []).append(r["v"])
    return {width: Rotation(np.array(some)) for width, some in rows.items()}


def _links(reps: DataFrame, cosine: float) -> DataFrame | None:
    """(a, b) of different vectors of one label and length with the cosine, found through the tables."""
    turned = rotations(reps)
    if not turned:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = np.diff(batch.column("v").offsets.to_numpy())
            for width in np.unique(widths).tolist():
                some = batch.filter(pa.array(widths == width))
                v = some.column("v").flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, width)
                columns = [some.column("rep"), some.column("label"), pa.array(np.full(some.num_rows, width, np.int32)), pa.array(turned[width].codes(v))]
                yield pa.RecordBatch.from_arrays(columns, names=["rep", "label", "width", "code"])

    coded = staged(reps.select("rep", "label", "v").mapInArrow(run, "rep long, label string, width int, code long"), "codes")
    sizes: dict[int, list[int]] = {}
    for width, rotation in turned.items():
        sizes.setdefault(rotation.projection.shape[1], []).append(width)
    pairs = None
    for bits, widths in sorted(sizes.items()):  # lengths of BITS and more are one case, shorter ones a case each
        found = candidate_pairs(coded.where(F.col("width").isin(widths)), bits)
        pairs = found if pairs is None else pairs.union(found)
    whole = reps.select("rep", "v")
    return (
        pairs.join(whole.select(F.col("rep").alias("a"), F.col("v").alias("va")), "a")
        .join(whole.select(F.col("rep").alias("b"), F.col("v").alias("vb")), "b")
        .where(_cosine("va", "vb") >= cosine).select("a", "b")
    )
