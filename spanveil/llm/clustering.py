"""Centroid clustering with geometric drift tightening, exact over whole numbers.

Every vector keeps its cluster, an upper bound of the distance to its own centroid and a lower bound of the distance
to every other one. When centroids move, the usual lower bound falls by the whole drift of a centroid. Here the
sphere round each cluster (its centroid, and the largest upper bound in it) is held against each moved centroid in the
plane that the sphere's centre and the drift span: no vector of the sphere sees the centroid come nearer by more than
the drift times the cosine of the smallest angle between the drift and a line of sight into the sphere. The lower bound
falls by that. A vector whose upper bound stays below its lower bound keeps its cluster unread; all others are
ambiguous, and are scanned exactly.

Vectors are packed into blocks and written once, bucketed by block; a round joins them with the blocks' small state
where they lie, and writes only the new state. Sums change by what moved between clusters. What reaches the driver is
one row for each cluster and component.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.sources.workspace import fresh_path, staged

# Vectors in a block, and bytes of vectors meant for one bucket.
BLOCK = 4096
BUCKET_BYTES = 64 << 20
MOST_BUCKETS = 100_000  # Spark's own limit
# Below this magnitude 64 products and their sums are exact in doubles; beyond it, whole numbers of any size are used.
SMALL = 1 << 22
# Pieces into which a drift is cut to bound its angles.
PIECES = 4
# Room for rounding in bounds, relative.
SLACK = 1e-9

_LIMB = 40  # sums travel as numbers of so many bits, so they never overflow


def kept_vectors(vectors: DataFrame, width: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows whose vector has ``width`` components, none null or non-finite."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    cast = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    return cast.where(v.isNotNull() & (F.size(v) == width) & finite)


def whole_numbers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles: doubles while they are exact, else Python integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * scale)
    if np.abs(scaled).max(initial=0) < SMALL:
        return scaled
    # A double of 2**53 or more is a whole number itself; scaling it as one never overflows.
    of = [int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale) for x in values.ravel().tolist()]
    return np.array(of, dtype=object).reshape(values.shape)


def _pack(width: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                values = some.column("v").flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, width)
                small = (np.abs(values) < SMALL / scale).all(axis=1)
                for which, is_small in ((small, True), (~small, False)):
                    if not which.any():
                        continue
                    whole = whole_numbers(values[which], scale)
                    data = whole.astype("<i4").tobytes() if is_small else ",".join(map(str, whole.ravel().tolist())).encode()
                    ids = pa.array([some.column("vec_id").filter(pa.array(which)).to_pylist()], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array([made]), ids, pa.array([is_small]), pa.array([data], pa.binary())], names=["block", "ids", "small", "data"])
                    made += 1

    return run


def _unpacked(data: bytes, small: bool, width: int) -> np.ndarray:
    if small:
        return np.frombuffer(data, "<i4").reshape(-1, width).astype(np.float64)
    return np.array([int(x) for x in data.split(b",")], dtype=object).reshape(-1, width)


def _as_float(x) -> float:
    try:
        return float(x)
    except OverflowError:
        return math.inf


def _roots(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(np.array([_as_float(x) for x in squares.ravel().tolist()]).reshape(squares.shape))


@dataclass
class Centroids:
    """Centroids of one round, and how far the bounds have to be loosened since the round before."""

    points: list[list[int]]
    drift: np.ndarray = field(default_factory=lambda: np.zeros(0))
    fall: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def squares(self, vectors: np.ndarray) -> np.ndarray:
        """Exact squared distance of each vector to each centroid."""
        flat = [x for p in self.points for x in p]
        if vectors.dtype != object and max(map(abs, flat), default=0) < SMALL:
            c = np.array(self.points, np.float64)
            return (vectors * vectors).sum(axis=1)[:, None] - 2.0 * (vectors @ c.T) + (c * c).sum(axis=1)[None, :]
        v = vectors if vectors.dtype == object else np.array([int(x) for x in vectors.ravel().tolist()], dtype=object).reshape(vectors.shape)
        return np.stack([((v - np.array(p, dtype=object)) ** 2).sum(axis=1) for p in self.points], axis=1)

    def own(self, vectors: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        """Exact squared distance of each vector to the centroid of its cluster."""
        out = np.zeros(len(vectors), dtype=object)
        for c in np.unique(cluster).tolist():
            at = np.flatnonzero(cluster == c)
            out[at] = Centroids([self.points[c]]).squares(vectors[at])[:, 0].astype(object)
        return out


def nearer_by(sphere: list[int], radius: float, old: list[int], new: list[int]) -> float:
    """How much nearer a centroid moved from ``old`` to ``new`` comes to any vector of a sphere, at most.

    Each piece of the drift counts with the cosine of the smallest angle between it and a line from it into the
    sphere; the angle's least value follows from the piece's start and its least distance to the centre.
    """
    way = np.array([_as_float(b - a) for a, b in zip(old, new, strict=True)])
    sight = np.array([_as_float(b - a) for a, b in zip(old, sphere, strict=True)])
    with np.errstate(all="ignore"):
        drift = float(np.sqrt((way * way).sum()))
        if drift == 0.0:
            return 0.0
        along = float((sight * way).sum() / drift)
        side = float(np.sqrt(max(0.0, float((sight * sight).sum()) - along * along)))
    if not (math.isfinite(drift) and math.isfinite(along) and math.isfinite(side) and math.isfinite(radius)):
        return drift
    total, step = 0.0, drift / PIECES
    for i in range(PIECES):
        start, end = along - i * step, along - (i + 1) * step  # the centre, as seen along the drift
        least = math.hypot(side, 0.0 if end <= 0.0 <= start else min(abs(start), abs(end)))
        if radius >= least * (1.0 - SLACK):
            total += step
            continue
        angle = math.atan2(side, start) - math.asin(min(1.0, radius / least))
        total += step * min(1.0, math.cos(max(0.0, angle)) + 1e-6)
    return total


def moved(old: list[list[int]], new: list[list[int]], radii: list[float]) -> Centroids:
    """The new centroids with the drift of each and the fall of each cluster's lower bounds."""
    k = len(old)
    drift = np.array([math.sqrt(_as_float(sum((b - a) ** 2 for a, b in zip(p, q, strict=True)))) for p, q in zip(old, new, strict=True)])
    fall = np.zeros(k)
    for i in range(k):
        if radii[i] >= 0:
            fall[i] = max((min(float(drift[j]), nearer_by(old[i], radii[i], old[j], new[j])) for j in range(k) if j != i), default=0.0)
    return Centroids(new, drift, fall)


def _assign(centres: Centroids, vectors: np.ndarray, cluster: np.ndarray | None, upper: np.ndarray, lower: np.ndarray):
    """Cluster, upper and lower bound of each vector; without clusters, all are scanned."""
    if cluster is None:
        ask, cluster = np.arange(len(vectors)), np.zeros(len(vectors), np.uint8)
    else:
        upper, lower = upper + centres.drift[cluster], lower - centres.fall[cluster]
        ask = np.flatnonzero(~(upper * (1 + SLACK) < lower * (1 - SLACK)))
        if len(ask):
            upper[ask] = _roots(centres.own(vectors[ask], cluster[ask])) * (1 + SLACK)
            ask = ask[~(upper[ask] * (1 + SLACK) < lower[ask] * (1 - SLACK))]
    if len(ask):
        squares = centres.squares(vectors[ask])
        best = np.array(np.argmin(squares, axis=1), np.int64)
        rows = np.arange(len(ask))
        upper[ask] = _roots(squares[rows, best]) * (1 + SLACK)
        rest = _roots(squares)
        rest[rows, best] = np.inf
        lower[ask] = rest.min(axis=1) * (1 - SLACK)
        cluster[ask] = best
    return cluster, upper, lower


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    sign, value, n = (-1 if value < 0 else 1), abs(value), 0
    while value:
        yield n, sign * (value & ((1 << _LIMB) - 1))
        value >>= _LIMB
        n += 1


_CHANGE = pa.list_(pa.struct([("cluster", pa.int32()), ("dim", pa.int32()), ("limb", pa.int32()), ("value", pa.int64()), ("far", pa.float64())]))
_STATE = "block long, cluster binary, upper binary, lower binary, change array<struct<cluster: int, dim: int, limb: int, value: long, far: double>>"
_COUNT, _FAR = -1, -2  # dims of the count and the radius


def _changes(k: int, vectors: np.ndarray, before: np.ndarray | None, after: np.ndarray, upper: np.ndarray) -> list[dict]:
    """What the block adds to the sums and counts of clusters, and the largest upper bound in each."""
    out = []
    turned = np.ones(len(after), bool) if before is None else before != after
    for c in range(k):
        come, gone = turned & (after == c), (turned & (before == c)) if before is not None else np.zeros(len(after), bool)
        if come.any() or gone.any():
            sums = vectors[come].sum(axis=0) - vectors[gone].sum(axis=0)
            for dim, value in [(_COUNT, int(come.sum()) - int(gone.sum())), *enumerate(int(x) for x in sums)]:
                out += [{"cluster": c, "dim": dim, "limb": n, "value": v, "far": None} for n, v in _limbs(value)]
        if (after == c).any():
            out.append({"cluster": c, "dim": _FAR, "limb": 0, "value": 0, "far": float(upper[after == c].max())})
    return out


def _round(centres: Centroids, width: int):
    k = len(centres.points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                vectors = _unpacked(row["data"], row["small"], width)
                n = len(vectors)
                before = None if row.get("cluster") is None else np.frombuffer(row["cluster"], "<i2").astype(np.int64)
                bounds = [np.zeros(n) if before is None else np.frombuffer(row[c], np.float64).copy() for c in ("upper", "lower")]
                after, upper, lower = _assign(centres, vectors, None if before is None else before.copy(), *bounds)
                change = _changes(k, vectors, before, after, upper)
                columns = [pa.array([row["block"]]), pa.array([after.astype("<i2").tobytes()], pa.binary()), pa.array([upper.tobytes()], pa.binary()),
                           pa.array([lower.tobytes()], pa.binary()), pa.array([change], _CHANGE)]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "cluster", "upper", "lower", "change"])

    return run


def _last(centres: Centroids, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                vectors = _unpacked(row["data"], row["small"], width)
                before = None if row.get("cluster") is None else np.frombuffer(row["cluster"], "<i2").astype(np.int64)
                bounds = [np.zeros(len(vectors)) if before is None else np.frombuffer(row[c], np.float64).copy() for c in ("upper", "lower")]
                cluster, _, _ = _assign(centres, vectors, before, *bounds)
                far = [int(x) for x in centres.own(vectors, cluster)]
                columns = [pa.array(row["ids"], pa.int64()), pa.array(cluster.astype(np.int32)), pa.array([x if x < 1 << 63 else None for x in far], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])

    return run


def _new_centroids(state: DataFrame, sums: dict, points: list[list[int]]) -> tuple[list[list[int]], list[float]]:
    """Centroids after a round, and each cluster's radius. ``sums`` holds sums and counts and is brought up to date."""
    change = state.select(F.explode("change").alias("c")).groupBy("c.cluster", "c.dim", "c.limb").agg(F.sum("c.value").alias("value"), F.max("c.far").alias("far"))
    radii = [-1.0] * len(points)
    for r in change.collect():  # one row for each cluster, component and limb
        if r["dim"] == _FAR:
            radii[r["cluster"]] = r["far"]
        else:
            key = (r["cluster"], r["dim"])
            sums[key] = sums.get(key, 0) + (r["value"] << (_LIMB * r["limb"]))
    out = []
    for c, point in enumerate(points):
        n = sums.get((c, _COUNT), 0)
        out.append([sums.get((c, dim), 0) // n for dim in range(len(point))] if n else point)
    return out, radii


def first_centroids(kept: DataFrame, k: int, seed: str, scale: int) -> list[list[int]]:
    """The k kept vectors whose ids have the smallest hashes; equal ids in the order of their components."""
    hashed = kept.where("vec_id is not null").withColumn("h", F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256))
    rows = hashed.orderBy("h", "v").limit(k).select("v").collect()
    return [[int(x) for x in whole_numbers(np.array([r["v"]]), scale)[0]] for r in rows]


def cluster_vectors(
    vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, width: int = 64, seed: str = "3:", id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each kept vector.

    Components count as floor(scale * x). Vectors of another width, null ones and ones with null or non-finite
    components are left out; a row without an id is clustered but starts no centroid; repeated rows are rows of their
    own. With fewer than k different rows there are fewer centroids, with none no rows. A squared distance or a sum
    that no long can hold is null. Other columns are not read.
    """
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, width, id_col, vec_col)
    points = first_centroids(kept, k, seed, scale)
    if not points:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    name = f"spanveil_blocks_{uuid.uuid4().hex}"
    buckets = min(MOST_BUCKETS, max(spark.sparkContext.defaultParallelism, -(-kept.count() * width * 4 // BUCKET_BYTES)))
    packed = kept.mapInArrow(_pack(width, scale), "block long, ids array<long>, small boolean, data binary")
    (packed.repartition(buckets, "block").sortWithinPartitions("block").write.format("parquet")
     .bucketBy(buckets, "block").sortBy("block").option("path", fresh_path(spark, "vector-blocks")).saveAsTable(name))
    try:
        blocks = spark.table(name)
        centres, state, sums = Centroids(points), None, {}
        for _ in range(rounds):
            state = staged(_joined(blocks, state).mapInArrow(_round(centres, width), _STATE), "cluster-state")
            fresh, radii = _new_centroids(state, sums, centres.points)
            centres = moved(centres.points, fresh, radii)
        ends = staged(_joined(blocks, state).mapInArrow(_last(centres, width), "vec_id long, cluster int, distance long"), "clusters")
    finally:
        spark.sql(f"drop table if exists {name}")
    return _with_inertia(ends, centres.points)


def _joined(blocks: DataFrame, state: DataFrame | None) -> DataFrame:
    """Blocks with their state; both are dealt by block, so the vectors stay where they are."""
    return blocks if state is None else blocks.join(state.select("block", "cluster", "upper", "lower").hint("merge"), "block")


def _with_inertia(ends: DataFrame, points: list[list[int]]) -> DataFrame:
    spark = ends.sparkSession
    by_cluster = ends.groupBy("cluster").agg(F.count("*").alias("n"), F.count("distance").alias("known"), F.sum(F.col("distance").cast("decimal(20,0)")).alias("total"))
    facts = by_cluster.select(
        "cluster", F.when(F.col("known") == F.col("n"), F.col("total")).alias("cluster_total"), "n", "known", "total"
    ).collect()  # one row for each cluster
    whole = all(r["known"] == r["n"] for r in facts)
    everything = sum(int(r["total"]) for r in facts) if whole else None

    def fits(x) -> int | None:
        return int(x) if x is not None and int(x) < 1 << 63 else None

    rows = [
        (r["cluster"], fits(r["cluster_total"]), fits(everything), hashlib.sha256(",".join(map(str, points[r["cluster"]])).encode()).hexdigest())
        for r in facts
    ]
    named = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return ends.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
