"""SimHash near-duplicates through a Gray-order hierarchical index.

Distinct fingerprints are cut into nodes by their leading bits, which are also the leading bits of their Gray
rank. Only nodes whose leading bits differ in at most ``bits`` places meet. A node is sorted by Gray rank, so
neighbours share many bits; each upper level keeps the bits that all members of a group agree on and the level
above did not fix yet. A search adds up the differences on the way down and leaves a whole group at the first
level where they exceed the bound. Matches are folded into one star for each group before they leave the task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm.components import connected_components
from spanveil.sources.workspace import staged

SHINGLE = 3
MAX_BITS = 3
SEED = 42
# Fingerprints aimed at in one node, and the most in one block of a node.
NODE_SIZE = 8192
BLOCK_SIZE = 16_384
# Entries of a group on each level, and queries searched together.
FAN = 8
QUERIES = 256
# Shingles hashed at a time, so that very long texts take bounded memory.
HASHES = 1 << 16


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles; zero without words or for a null text."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    hash_of = xxhash.xxh64_intdigest
    size = min(words, len(parts))
    total, ones = len(parts) - size + 1, np.zeros(64, np.int64)
    for at in range(0, total, HASHES):
        some = parts[at : min(at + HASHES, total) + size - 1]
        if size == 3:
            hashes = [hash_of(a + b" " + b + b" " + c, SEED) for a, b, c in zip(some, some[1:], some[2:], strict=False)]
        else:
            hashes = [hash_of(b" ".join(some[i : i + size]), SEED) for i in range(len(some) - size + 1)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, fp) for each row of ``docs``; fp holds the 64 bits as a signed long."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), words) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return slim.mapInArrow(run, "doc_id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the binary reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """A hierarchical index over distinct fingerprints in Gray order."""

    def __init__(self, codes: np.ndarray):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        leaves = codes[self.order]
        # From the leaves up: bits that are one in all members, and in any of them.
        levels = [(leaves, leaves)]
        while len(levels[-1][0]) > FAN:
            every, some = levels[-1]
            at = np.arange(0, len(every), FAN)
            levels.append((np.bitwise_and.reduceat(every, at), np.bitwise_or.reduceat(some, at)))
        # From the top down: the bits each entry adds to those fixed above it, and their values.
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        above = None
        for every, some in reversed(levels):
            agreed = ~(every ^ some)
            added = agreed if above is None else agreed & ~above[np.arange(len(every)) // FAN]
            self.levels.append((every, added))
            above = agreed

    def search(self, queries: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, code) of places in the given arrays that differ in at most ``bits`` bits."""
        top = len(self.levels[0][0])
        query = np.repeat(np.arange(len(queries), dtype=np.int32), top)
        node = np.tile(np.arange(top, dtype=np.int32), len(queries))
        apart = np.zeros(len(query), np.uint8)
        for depth, (value, mask) in enumerate(self.levels):
            if depth:
                node = (node[:, None] * FAN + np.arange(FAN, dtype=np.int32)).ravel()
                query, apart = np.repeat(query, FAN), np.repeat(apart, FAN)
                real = node < len(value)
                if not real.all():
                    node, query, apart = node[real], query[real], apart[real]
            apart = apart + np.bitwise_count((queries[query] ^ value[node]) & mask[node])
            near = apart <= bits
            node, query, apart = node[near], query[near], apart[near]
        return query, self.order[node]


def _fold(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest label of each place once a[i] and b[i] are joined for all i."""
    while True:
        low = np.minimum(labels[a], labels[b])
        before = labels.copy()
        for ends in (a, b):
            np.minimum.at(labels, labels[ends], low)
            np.minimum.at(labels, ends, low)
        labels = labels[labels]
        if np.array_equal(labels, before):
            return labels


def block_links(left: np.ndarray, right: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links between two arrays of fingerprints, as stars: places in left followed by right, each with a smaller one."""
    index = GrayIndex(right)
    labels = np.arange(len(left) + len(right))
    for at in range(0, len(left), QUERIES):
        query, code = index.search(left[at : at + QUERIES], bits)
        if len(query):
            labels = _fold(labels, query.astype(np.int64) + at, code + len(left))
    moved = np.flatnonzero(labels != np.arange(len(labels)))
    return list(zip(moved.tolist(), labels[moved].tolist(), strict=True))


def near_links(codes: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) that join all of ``codes`` (distinct fp) at most ``bits`` bits apart, transitively."""
    spark = codes.sparkSession
    total = codes.count()
    lead = min(24, max(0, round(math.log2(max(1, total) / NODE_SIZE))))
    keyed = codes.select("fp").withColumn("node", F.shiftrightunsigned("fp", 64 - lead) if lead else F.lit(0).cast("long"))
    sizes = keyed.groupBy("node").agg(F.ceil(F.count("*") / BLOCK_SIZE).alias("blocks"))
    blocks = staged(
        keyed.join(sizes, "node")
        .withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")))
        .groupBy("node", "block").agg(F.collect_list("fp").alias("members")),
        "gray-blocks",
    )
    # Every node meets the nodes whose leading bits differ in at most ``bits`` places, each two once.
    masks = [sum(1 << i for i in flip) for k in range(bits + 1) for flip in combinations(range(lead), k)]
    left = (
        blocks.select("node", "block", F.col("members").alias("left"))
        .withColumn("flip", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])))
        .withColumn("other", F.col("node").bitwiseXOR(F.col("flip")))
        .where("other >= node")
    )
    right = blocks.select(F.col("node").alias("other"), F.col("block").alias("other_block"), F.col("members").alias("right"))
    met = left.join(right.hint("shuffle_merge"), "other").where("other > node or other_block >= block").select("left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in range(batch.num_rows):
                left, right = (
                    batch.column(c)[pair].values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in ("left", "right")
                )
                both = np.concatenate([left, right]).view(np.int64)
                stars = [(both[a], both[b]) for a, b in block_links(left, right, bits) if both[a] != both[b]]
                yield pa.RecordBatch.from_arrays([pa.array([s[k] for s in stars], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = SHINGLE, bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (signed long) and component_id: the smallest doc_id linked, directly or not, at ``bits`` bits or fewer.

    Null texts count as empty; texts without words all have fingerprint zero and link with one another. A row
    without an id takes the component of its fingerprint and names none. Repeated rows come out repeated.
    """
    rows = staged(fingerprints(docs, words, id_col, text_col), "fingerprints")
    codes = staged(rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id")), "codes")
    roots = codes.join(
        connected_components(near_links(codes, bits)).select(F.col("id").alias("fp"), F.col("component").alias("root")), "fp", "left"
    ).withColumn("root", F.coalesce("root", "fp"))
    lowest = roots.groupBy("root").agg(F.min("id").alias("component_id"))
    classes = roots.join(lowest, "root").select("fp", "component_id")
    return rows.join(classes, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, words: int = SHINGLE, bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that have a smaller id in their component. Rows without an id stay."""
    found = near_duplicates(docs, words, bits, id_col, text_col)
    gone = found.where("component_id < doc_id").select(F.col("doc_id").alias("_gone_id")).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == gone["_gone_id"], "left_anti")
