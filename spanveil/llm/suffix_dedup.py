"""Repeated substrings of whole texts by distributed prefix doubling.

A position's rank at length h names the h bytes from it; the ranks at h of a position and of the one h bytes on give
its rank at 2h. Ranks up to 20 bytes are made from neighbours inside a document, without a shuffle. Then Spark
sorts (rank, document) pairs, twice, at growing lengths:

1. Positions are thinned first: of each 50-byte string only the smallest 20-byte rank in it, which depends on the string
   alone, so equal strings name equal ones. A name stands for a run of strings; the bytes from the first to the last of
   them get a longer rank. Spark sorts (name, longer rank, document). A name met once is unique and is left out. A
   run whose longer rank is in an earlier document is repeated as a whole.
2. A run that is the first with its longer rank, while its name goes on in other ways elsewhere, is ranked position by
   position: (rank at 25 of p, rank at 25 of p + 25), which is past the threshold. Spark sorts these pairs, and
   a position whose pair is in an earlier document is repeated.

Sorted rows stream through a task with a state of a few values, so a name that a third of all documents hold
needs no memory; rows of one task that repeat each other are folded before they are sent. Rows of a task for the same
partition are sent as packed columns and unpacked before the sort: random ranks fill the disk, so they travel without
row headers and with sorted ranks as differences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.sources.workspace import staged

LENGTH = 50
NAME = 20
WINDOWS = LENGTH - NAME + 1
# Bytes of text whose runs are folded and sent together.
FOLD_BYTES = 6 << 20
# Bytes ranked together; positions in a block must fit 24 bits, so longer documents are ranked in overlapping parts.
BLOCK_BYTES = 1 << 20

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BYTE_RANKS = np.random.default_rng(5).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.uint64(0xFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= _B
    x ^= x >> np.uint64(29)
    return x


def _joined(left: np.ndarray, right: np.ndarray, offset: int) -> np.ndarray:
    """Ranks of the bytes that ``left`` at p and ``right`` at p + offset name together."""
    return _mix(left[: len(right) - offset] * _A + right[offset:])


def _ranks(data: np.ndarray, longest: int = 32) -> dict[int, np.ndarray]:
    """Ranks at growing lengths by doubling; at the end of the data there are fewer."""
    made, h = {1: _BYTE_RANKS[data]}, 1
    while h < longest:
        made[2 * h] = _joined(made[h], made[h], h)
        h *= 2
    return made


def _smallest(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    have, low = 1, keys
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    return np.minimum(low[: len(keys) - width + 1], low[width - have :][: len(keys) - width + 1])


def _blocks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts end to end in blocks: bytes, and for each part its text, its start there and its start in the block."""
    parts, held = [], 0
    for i, text in enumerate(texts):
        step = BLOCK_BYTES - LENGTH + 1
        for at in range(0, max(1, len(text) - LENGTH + 1), step):
            part = text[at : at + BLOCK_BYTES]
            if len(part) < LENGTH:
                continue
            if held + len(part) > BLOCK_BYTES and parts:
                yield _block(parts)
                parts, held = [], 0
            parts.append((i, at, part))
            held += len(part)
    if parts:
        yield _block(parts)


def _block(parts: list[tuple[int, int, bytes]]):
    sizes = np.array([len(p) for _, _, p in parts])
    return (np.frombuffer(b"".join(p for _, _, p in parts), np.uint8), np.array([i for i, _, _ in parts]), np.array([a for _, a, _ in parts]), np.r_[0, np.cumsum(sizes)])


def named_runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Runs of 50-byte strings with the same smallest name: name, longer rank, text, first string, number of strings."""
    found: list[tuple[np.ndarray, ...]] = []
    for data, owner, offset, edges in _blocks(texts):
        ranks = _ranks(data)
        name = _joined(ranks[16], ranks[4], 16)
        keys = (name & ~_PLACE) | np.arange(len(name), dtype=np.uint64)
        at = (_smallest(keys, WINDOWS) & _PLACE).astype(np.int64)
        whole = np.ones(len(at), bool)  # strings that end in the part they start in
        for end in edges[1:-1]:
            whole[end - LENGTH + 1 : end] = False
        change = np.r_[True, (at[1:] != at[:-1]) | (whole[1:] != whole[:-1])]
        first = np.flatnonzero(change)
        count = np.diff(np.r_[first, len(at)])
        first, count = first[whole[first]], count[whole[first]]
        last = first + count + LENGTH - 1  # end of the bytes that the run's strings cover
        r32 = ranks[32]
        longer = _mix(r32[first] * _A + r32[first + (LENGTH - 32)])
        longer = _mix(longer * _A + r32[np.minimum(first + 24, last - 32)])
        longer = _mix(longer * _A + r32[last - 32])
        longer = _mix(longer * _A + (at[first] - first).astype(np.uint64) * np.uint64(64) + count.astype(np.uint64))
        part = np.searchsorted(edges, first, "right") - 1
        found.append((name[at[first]], longer, owner[part], first - edges[part] + offset[part], count))
    if not found:
        return tuple(np.zeros(0, np.uint64 if i < 2 else np.int64) for i in range(5))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


# A sent run is four longs: (name, number of strings, tag of the text), (top of the longer rank, first string), document,
# rest of the longer rank.
_TAG_BITS, _COUNT_BITS, _FIRST_BITS = 10, 6, 31


def _bytes(column: pa.Array) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most FOLD_BYTES of text, or of one text."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0), np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + FOLD_BYTES, "right")))
            yield batch.slice(at, end - at)
            at = end


_PACKED = "bucket int, n int, packed binary"


def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=1)


def _packed(bucket: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """One row for each bucket: its rows sorted by the first column, which is sent as differences, byte by byte."""
    order = np.lexsort((columns[0], bucket))
    bucket, columns = bucket[order], [c[order] for c in columns]
    edges = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)] if len(bucket) else np.zeros(1, int)
    codec, chunks = _codec(), []
    for start, end in zip(edges[:-1], edges[1:], strict=True):
        sent = np.stack([c[start:end] for c in columns])
        sent[0, 1:] -= columns[0][start : end - 1]
        chunks.append(codec.compress(sent.view(np.uint8).reshape(len(columns), end - start, 8).transpose(0, 2, 1).tobytes(), asbytes=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[edges[:-1]].astype(np.int32)), pa.array(np.diff(edges).astype(np.int32)), pa.array(chunks, pa.binary())], names=["bucket", "n", "packed"]
    )


def _sorted(sent: DataFrame, parts: int, columns: list[str], order: list) -> DataFrame:
    """Packed rows dealt out by bucket, unpacked into long columns, sorted within each partition."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec()
        for batch in batches:
            for n, packed in zip(batch.column("n").to_pylist(), batch.column("packed"), strict=True):
                raw = np.frombuffer(codec.decompress(packed.as_buffer(), n * 8 * len(columns), asbytes=True), np.uint8)
                rows = raw.reshape(len(columns), 8, n).transpose(0, 2, 1).copy().view(np.uint64)[:, :, 0]
                rows[0] = np.cumsum(rows[0])
                yield pa.RecordBatch.from_arrays([pa.array(r.view(np.int64)) for r in rows], names=columns)

    return sent.repartitionById(parts, F.col("bucket")).mapInArrow(unpack, ", ".join(f"{c} long" for c in columns)).sortWithinPartitions(*order)


def _runs(docs: DataFrame, parts: int) -> DataFrame:
    """(head, rest, doc_id, more) of every run in every text, packed; runs that a task finds again are sent once, from the
    smallest id, and the others come with the name 0 as already known to be repeated, dealt out by what else they have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            ids, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "tag"))
            name, longer, text, first, count = named_runs(_bytes(batch.column("text")))
            doc = ids[text]
            order = np.lexsort((doc, longer, name))
            name, longer, text, first, count, doc = (x[order] for x in (name, longer, text, first, count, doc))
            new = np.r_[True, (name[1:] != name[:-1]) | (longer[1:] != longer[:-1])] if len(name) else np.zeros(0, bool)
            low = doc[np.flatnonzero(new)][np.cumsum(new) - 1] if len(name) else doc
            top = name >> np.uint64(64 - 48)
            top = np.where(doc > low, np.uint64(0), np.maximum(top, np.uint64(1)))
            head = top << np.uint64(16) | count.astype(np.uint64) << np.uint64(_TAG_BITS) | tags[text].astype(np.uint64)
            dealt = _mix(np.where(top == 0, longer, top) * _A) % np.uint64(parts)
            longer = np.where(top == 0, np.uint64(0), longer)  # known runs need none, and zeros take no room
            rest = (longer >> np.uint64(31)) << np.uint64(_FIRST_BITS) | first.astype(np.uint64)
            yield _packed(dealt, [head, rest, doc.astype(np.int64).view(np.uint64), longer & np.uint64((1 << 31) - 1)])

    return docs.mapInArrow(run, _PACKED)


_OUT = "doc_id long, tag int, first int, n int, known boolean"


def _out(head: np.ndarray, rest: np.ndarray, doc: np.ndarray, known: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(doc), pa.array((head & ((1 << _TAG_BITS) - 1)).astype(np.int32)), pa.array((rest & ((1 << _FIRST_BITS) - 1)).astype(np.int32)),
            pa.array((head >> _TAG_BITS & ((1 << _COUNT_BITS) - 1)).astype(np.int32)), pa.array(np.full(len(doc), known)),
        ],
        names=["doc_id", "tag", "first", "n", "known"],
    )


def _judge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk runs sorted by name, longer rank, document. Gives repeated runs (known), and those to rank by position."""
    last = None  # name, longer rank and its first document, whether the name had another longer rank
    waiting = tuple(np.zeros(0, np.int64) for _ in range(3))  # first runs of a name with one longer rank so far
    for batch in batches:
        if not batch.num_rows:
            continue
        head, rest, doc = (batch.column(c).to_numpy() for c in ("head", "rest", "doc_id"))
        name, longer = head >> 16, (rest >> _FIRST_BITS << _FIRST_BITS) | batch.column("more").to_numpy()
        new_name = np.r_[last is None or last[0] != name[0], name[1:] != name[:-1]]
        new_rank = new_name | np.r_[last is None or last[1] != longer[0], longer[1:] != longer[:-1]]
        starts = np.flatnonzero(new_rank)
        first_docs = doc[starts] if new_rank[0] else np.r_[last[2], doc[starts]]
        which = np.cumsum(new_rank) - (1 if new_rank[0] else 0)
        low = first_docs[which]
        group = np.cumsum(new_name) - (1 if new_name[0] else 0)
        several = np.bincount(group, new_rank & ~new_name, minlength=group[-1] + 1) > 0
        if not new_name[0]:
            several[0] |= last[3]
        zero = name == 0
        found = (doc > low) | zero
        yield _out(head[found], rest[found], doc[found], True)
        if len(waiting[0]):
            if not new_name[0] and several[0]:
                yield _out(*waiting, False)
                waiting = tuple(x[:0] for x in waiting)
            elif new_name[0] or group[-1] > 0:
                waiting = tuple(x[:0] for x in waiting)
        ask = ~found & several[group]
        yield _out(head[ask], rest[ask], doc[ask], False)
        if not several[-1]:
            tail = (group == group[-1]) & ~found
            waiting = tuple(np.concatenate([w, x[tail]]) for w, x in zip(waiting, (head, rest, doc), strict=True))
        last = (name[-1], longer[-1], low[-1], bool(several[-1]))


def _with_texts(docs: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    lists = rows.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("first", "n")).alias(name))
    return docs.join(lists, ["doc_id", "tag"], "left")


# Positions folded and sent together, and runs ranked together (none has more than 63 positions).
_PAIRS, _RUNS = 1 << 20, 1 << 12


def _laid(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each range of n, end to end."""
    stops = np.cumsum(n)
    return np.repeat(first - (stops - n), n) + np.arange(stops[-1])


def _asked_ranks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b, doc_id, place) of the positions asked for, some at a time: ranks at 25 there and 25 bytes on.

    The bytes under each run are laid end to end and ranked once for all its positions.
    """
    half = LENGTH // 2
    for i in range(batch.num_rows):
        if not batch.column("asked")[i].is_valid:
            continue
        asked = batch.column("asked")[i].values
        data = np.frombuffer(_bytes(batch.column("text").slice(i, 1))[0], np.uint8)
        doc, tag = batch.column("doc_id")[i].as_py(), batch.column("tag")[i].as_py()
        first, n = (asked.field(c).to_numpy().astype(np.int64) for c in ("first", "n"))
        for at in range(0, len(first), _RUNS):
            some, strings = first[at : at + _RUNS], n[at : at + _RUNS]
            byte, own = _laid(some, strings + LENGTH - 1), _laid(np.r_[0, np.cumsum(strings + LENGTH - 1)[:-1]], strings)
            r16 = _ranks(data[byte], 16)[16]
            r25 = _joined(r16, r16, half - 16)
            yield r25[own], r25[own + half], np.full(len(own), doc, np.int64), byte[own].astype(np.uint64) << np.uint64(_TAG_BITS) | np.uint64(tag)


def _folded_pairs(pieces: list[tuple[np.ndarray, ...]], parts: int) -> pa.RecordBatch:
    """Pairs packed for the shuffle; a pair met again in a later document is known to be repeated and comes as 0, 0."""
    a, b, doc, place = (np.concatenate(x) for x in zip(*pieces, strict=True))
    order = np.lexsort((doc, b, a))
    a, b, doc, place = a[order], b[order], doc[order], place[order]
    a, b = np.maximum(a, np.uint64(1)), b >> np.uint64(24)  # 0, 0 is for pairs known to be repeated; 104 bits tell pairs apart
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    again = doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    a[again] = b[again] = np.uint64(0)
    dealt = _mix(np.where(again, doc.view(np.uint64) * _B + place, a + b * _B) * _A) % np.uint64(parts)
    return _packed(dealt, [a, b, doc.view(np.uint64), place])


def _pairs(docs: DataFrame, parts: int) -> DataFrame:
    """(a, b, doc_id, place) of every position asked for, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, held = [], 0
        for batch in batches:
            for piece in _asked_ranks(batch):
                pieces.append(piece)
                held += len(piece[0])
                if held >= _PAIRS:
                    yield _folded_pairs(pieces, parts)
                    pieces, held = [], 0
        if pieces:
            yield _folded_pairs(pieces, parts)

    return docs.mapInArrow(run, _PACKED)


def _judge_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk positions sorted by rank pair and document: those whose pair is in an earlier document."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, doc, place = (batch.column(c).to_numpy() for c in ("a", "b", "doc_id", "place"))
        new = np.r_[last is None or last[:2] != (a[0], b[0]), (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        low = doc[np.flatnonzero(new)] if new[0] else np.r_[last[2], doc[np.flatnonzero(new)]]
        low = low[np.cumsum(new) - (1 if new[0] else 0)]
        last = (a[-1], b[-1], low[-1])
        found = (doc > low) | (a == 0)
        doc, place = doc[found], place[found]
        tag, first = (place & ((1 << _TAG_BITS) - 1)).astype(np.int32), (place >> _TAG_BITS).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(tag), pa.array(first), pa.array(np.ones(len(doc), np.int32))], names=["doc_id", "tag", "first", "n"])


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).bitwiseAND(F.lit((1 << _TAG_BITS) - 1)).cast("int").alias("tag"))


def _parts_of(docs: DataFrame) -> int:
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def repeated_strings(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, first, n): runs of n strings from byte ``first`` that start in an earlier document too."""
    parts = _parts_of(docs)
    sent = _runs(docs.where("doc_id is not null"), parts)
    runs = _sorted(sent, parts, ["head", "rest", "doc_id", "more"], [F.shiftright("head", 16), F.shiftright("rest", _FIRST_BITS), "more", "doc_id"])
    judged = staged(runs.mapInArrow(_judge_runs, _OUT), "repeated-runs")
    # Outer, and rows without anything asked skipped in the task, so that this shuffle of the texts is the final one's too.
    asked = _with_texts(docs, judged.where("not known"), "asked")
    pairs = _sorted(_pairs(asked, parts), parts, ["a", "b", "doc_id", "place"], ["a", "b", "doc_id"])
    more = pairs.mapInArrow(_judge_pairs, "doc_id long, tag int, first int, n int")
    return judged.where("known").select("doc_id", "tag", "first", "n").union(more)


def _spans(length: int, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the bytes covered by the strings, joined where they touch."""
    step = np.zeros(length + 1, np.int32)
    np.add.at(step, first, 1)
    np.add.at(step, np.minimum(first + n + LENGTH - 1, length), -1)
    covered = np.r_[False, np.cumsum(step[:-1]) > 0, False]
    change = np.flatnonzero(covered[1:] != covered[:-1])
    return change[::2], change[1::2]


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, starts, ends, kept_sha256 for each row of ``docs``.

    A byte of the UTF-8 text is removed if a string of 50 bytes over it also starts in a document with a smaller id;
    all strings are judged on the input, overlaps count, and matches never cross documents. starts and ends are byte
    offsets of the removed runs. Null and empty texts have no bytes. A row without an id has no earlier
    documents and is none. Rows that repeat an id are one document: they don't match one another.
    """
    slim = _slim(docs, id_col, text_col)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "starts", "ends", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            for raw, runs in zip(_bytes(batch.column("text")), batch.column("runs"), strict=True):
                first, n = (runs.values.field(c).to_numpy().astype(np.int64) for c in ("first", "n")) if runs.is_valid else (np.zeros(0, np.int64),) * 2
                starts, ends = _spans(len(raw), first, n) if len(first) else (np.zeros(0, np.int64),) * 2
                digest, at = hashlib.sha256(), 0
                for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
                    digest.update(raw[at:start])
                    at = end
                digest.update(raw[at:])
                for column, value in zip(rows, (len(raw), int((ends - starts).sum()), len(starts), starts.tolist(), ends.tolist(), digest.hexdigest()), strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(rows, kinds, strict=True))], names=names)

    found = _with_texts(slim, repeated_strings(slim), "runs")
    return found.select("doc_id", "text", "runs").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, starts array<long>, ends array<long>, kept_sha256 string"
    )
