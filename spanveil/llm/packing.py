"""Best-fit packing of token pieces into sequences by the linear grouping scheme.

Only the number of pieces of each length, at most ``capacity`` figures, reaches the driver:

1. large lengths are sorted and cut into groups of equal cardinality, each rounded up to its largest length;
2. configurations of the few rounded sizes are chosen, each the fullest sequence that still holds the largest
   size left, and used as often as the pieces allow;
3. actual pieces take the places of the rounded ones, which frees the room that rounding added;
4. small pieces go, longest first, to the sequence with the least room that still holds them (best fit).

The plan says for each length which ranks go to which sequences and offsets. Spark ranks the pieces of each
length (in salted parts, as a third of all pieces can have one length) and looks their places up.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanveil.llm.bpe import encoder
from spanveil.sources.workspace import staged

CAPACITY = 2048
GROUPS = 1024
# Lengths up to this part of the capacity are small.
SMALL_PART = 16
# Pieces of one length are ranked in parts of about so many rows.
PART_ROWS = 1_000_000
LEAST_PARTS = 64


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise whole texts, end each with ``end_id``, and cut those longer than ``capacity``.

    Rows: doc_id, piece, start, length, ids_crc32. A null or empty text is the one piece that holds ``end_id``.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            out: list[tuple] = []
            for doc, raw in zip(batch.column("doc_id").to_pylist(), enc.encode_many(batch.column("text").to_pylist()), strict=True):
                raw += end
                for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    out.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return slim.mapInArrow(run, "doc_id long, piece long, start long, length long, ids_crc32 long")


class _Plan:
    def __init__(self, capacity: int):
        self.capacity = capacity
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = 0
        self.room: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def place(self, length: int, rank: int, n: int, first: int, per: int, offset: int) -> None:
        """Ranks from ``rank`` on: ``per`` in each sequence from ``first`` on, from ``offset``."""
        self.rows.append((length, rank, rank + n, first, per, offset))


def _groups(large: list[tuple[int, int]], most: int) -> list[tuple[int, list[list[int]]]]:
    """Equal-cardinality groups of (length, count), longest first: rounded size, [length, next rank, left]."""
    total = sum(n for _, n in large)
    share = max(1, -(-total // most))
    made, parts, left = [], [], share
    for length, n in sorted(large, reverse=True):
        rank = 0
        while rank < n:
            take = min(left, n - rank)
            parts.append([length, rank, take])
            rank, left = rank + take, left - take
            if not left:
                made.append((parts[0][0], parts))
                parts, left = [], share
    if parts:
        made.append((parts[0][0], parts))
    return made


def _fullest(sizes: list[int], counts: list[int], room: int) -> list[tuple[int, int]]:
    """Group and number of each, so that the sizes fill ``room`` as far as they can."""
    reach, steps, everything = 1, [], (1 << (room + 1)) - 1
    for k, (size, count) in enumerate(zip(sizes, counts, strict=True)):
        for _ in range(min(count, room // size)):
            wider = (reach | reach << size) & everything
            if wider == reach:
                break
            steps.append((k, reach))
            reach = wider
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, defaultdict(int)
    for k, before in reversed(steps):
        if not before >> at & 1:
            used[k] += 1
            at -= sizes[k]
    return sorted(used.items())


def _fill(plan: _Plan, slots: list[list[list[int]]], times: int) -> None:
    """Put actual pieces into ``times`` sequences of one configuration and note the room each leaves."""
    while times:
        n = min([times, *(slot[0][2] for slot in slots)])
        offset = 0
        for slot in slots:
            length, rank, left = slot[0]
            plan.place(length, rank, n, plan.sequences, 1, offset)
            offset += length
            if left == n:
                del slot[0]
            else:
                slot[0] = [length, rank + n, left - n]
        plan.room[plan.capacity - offset].append((plan.sequences, n))
        plan.sequences += n
        times -= n


def _take(parts: list[list[int]], n: int) -> list[list[int]]:
    taken = []
    while n:
        length, rank, left = parts[0]
        m = min(n, left)
        taken.append([length, rank, m])
        if m == left:
            del parts[0]
        else:
            parts[0] = [length, rank + m, left - m]
        n -= m
    return taken


def _place_small(plan: _Plan, length: int, n: int) -> None:
    rank = 0
    while n:
        fits = [r for r, runs in plan.room.items() if r >= length and runs]
        room = min(fits) if fits else plan.capacity
        if fits:
            first, bins = plan.room[room].pop()
        else:
            bins = -(-n // (room // length))
            first, plan.sequences = plan.sequences, plan.sequences + bins
        per = room // length
        full = min(bins, n // per)
        if full:
            plan.place(length, rank, full * per, first, per, plan.capacity - room)
            plan.room[room - per * length].append((first, full))
            rank, n = rank + full * per, n - full * per
        if full < bins:
            rest = min(n, per - 1) if n < per else 0
            if rest:
                plan.place(length, rank, rest, first + full, per, plan.capacity - room)
                plan.room[room - rest * length].append((first + full, 1))
                n, full = n - rest, full + 1
            if full < bins:
                plan.room[room].append((first + full, bins - full))


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Rows (length, rank_from, rank_to, first_sequence, per_sequence, offset), and the number of sequences."""
    plan = _Plan(capacity)
    small = capacity // SMALL_PART
    grouped = _groups([(x, n) for x, n in counts.items() if x > small], groups)
    left = [sum(p[2] for p in parts) for _, parts in grouped]
    sizes = [size for size, _ in grouped]
    for k in range(len(grouped)):
        while left[k]:
            left[k] -= 1
            use = _fullest(sizes[k:], left[k:], capacity - sizes[k])
            left[k] += 1
            number = {k: 1}
            for j, m in use:
                number[k + j] = number.get(k + j, 0) + m
            times = min(left[j] // m for j, m in number.items())
            slots = [_take(grouped[j][1], times) for j, m in number.items() for _ in range(m)]
            for j, m in number.items():
                left[j] -= times * m
            _fill(plan, slots, times)
    for length in sorted((x for x in counts if x <= small), reverse=True):
        _place_small(plan, length, counts[length])
    return plan.rows, plan.sequences


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    Repeated rows are pieces of their own. No pieces give no rows.
    """
    spark = pieces.sparkSession
    sums = pieces.groupBy("length").count().collect()  # at most ``capacity`` rows
    counts = {r["length"]: r["count"] for r in sums}
    rows, _ = plan_packing(counts, capacity, groups)
    parts = max(LEAST_PARTS, -(-max(counts.values(), default=0) // PART_ROWS))
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    before = (
        dealt.groupBy("length", "part").count()
        .withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count"))
        .select("length", "part", "before")
    )
    order = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        dealt.withColumn("nth", F.row_number().over(order))
        .join(before, ["length", "part"])
        .withColumn("rank", F.col("before") + F.col("nth") - 1)
    )
    schema = "length long, rank_from long, rank_to long, first long, per long, at long"
    # The plan's size depends on the capacity and the number of groups, not on the number of pieces.
    places = (
        spark.createDataFrame(rows, schema).groupBy("length")
        .agg(F.collect_list(F.struct("rank_from", "rank_to", "first", "per", "at")).alias("places"))
    )
    nth = F.col("rank") - F.col("place.rank_from")
    return (
        ranked.join(F.broadcast(places), "length")
        .withColumn("place", F.filter("places", lambda p: (p["rank_from"] <= F.col("rank")) & (F.col("rank") < p["rank_to"]))[0])
        .select(
            "doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32",
            (F.col("place.first") + F.expr("(rank - place.rank_from) div place.per")).alias("sequence_id"),
            (F.col("place.at") + nth % F.col("place.per") * F.col("length")).alias("offset"),
        )
    )


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, groups: int = GROUPS, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where each piece of each document goes: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return place_pieces(staged(cut_pieces(docs, path, capacity, end_id, id_col, text_col), "pieces"), capacity, groups)
