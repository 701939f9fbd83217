"""Centroid clustering with kd-tree filtering, in whole numbers.

Each partition's vectors are cut into blocks, and each block becomes a kd-tree: its vectors in tree order, and for every node the smallest box
around its vectors and their sum. The trees are written to the shared folder once; a round reads them, sends the centroids down each tree and
returns counts and sums of at most k centroids a partition. On the way down a centroid is pruned where another is nearer to every point of a
node's box; a node with one centroid left is assigned as a whole by its count and sum; leaves are resolved vector by vector.

Defined results: vectors of another length, or with a null, NaN or infinite component, are left out, as are those with a component of 2^27 or
more after scaling, whose distances a long may not hold. Repeated rows are vectors of their own. Rows without an id are assigned but never
start a centroid. Fewer vectors than centroids give as many centroids as vectors; no vectors give no rows. On equal distances the smaller
number wins; centroids that get no vectors stay where they are. Other columns of the table are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .spark_io import drop_table, materialize

CENTROIDS, ROUNDS, DIMENSIONS, SCALE = 16, 3, 64, 64
#: Vectors of a block and, at most, of a leaf; components stay below MOST.
BLOCK, LEAF, MOST = 4096, 32, 1 << 27
TREES = "ids array<bigint>, n int, points binary, boxes binary, sums binary"
_TREES = pa.schema([("ids", pa.list_(pa.int64())), ("n", pa.int32()), ("points", pa.binary()), ("boxes", pa.binary()), ("sums", pa.binary())])
_SUMS = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
_ASSIGNED = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])


def whole_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id, q of the usable rows of vectors (vec_id, embedding): q is floor(scale * x) of each component."""
    scaled = F.transform("embedding", lambda x: x.cast("double") * scale)
    usable = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < MOST))
    rows = vectors.where(F.size("embedding") == dimensions).where(usable)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(scaled, lambda x: F.floor(x)).alias("q"))


def first_centroids(whole: DataFrame, k: int = CENTROIDS) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes, in that order."""
    rows = whole.where("vec_id is not null").select(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("h"), "q").orderBy("h", "q").limit(k).collect()
    return np.array([r.q for r in rows], np.int64)


@functools.lru_cache(64)
def node_bounds(n: int) -> list[np.ndarray]:
    """For each level of a block's tree, from its root, where its nodes begin and end: halves of halves down to LEAF vectors."""
    levels = [np.array([0, n])]
    while -(-n // (len(levels[-1]) - 1)) > LEAF:
        halved = np.empty(2 * len(levels[-1]) - 1, np.int64)
        halved[::2], halved[1::2] = levels[-1], (levels[-1][:-1] + levels[-1][1:]) // 2
        levels.append(halved)
    return levels


def tree_of(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, boxes, sums) of a block: the vectors in tree order; (low, high) and the sum of each node, level by level from the root."""
    levels, order = node_bounds(len(points)), np.arange(len(points))
    for bounds in levels[:-1]:
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            mine = points[order[a:b]]
            widest = int(np.argmax(mine.max(0) - mine.min(0)))
            order[a:b] = order[a:b][np.argpartition(mine[:, widest], (b - a) // 2)]
    placed = points[order]
    boxes = [np.stack([np.minimum.reduceat(placed, b[:-1]), np.maximum.reduceat(placed, b[:-1])], 1) for b in levels]
    return order, np.concatenate(boxes), np.concatenate([np.add.reduceat(placed, b[:-1]) for b in levels])


def _row(ids: list, points: np.ndarray) -> pa.RecordBatch:
    order, boxes, sums = tree_of(points)
    columns = [[[ids[i] for i in order]], [len(ids)], [points[order].astype(np.int32).tobytes()], [boxes.astype(np.int32).tobytes()], [sums.tobytes()]]
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _TREES, strict=True)], schema=_TREES)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, held = [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids += batch.column("vec_id").to_pylist()
        held.append(batch.column("q").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
        if len(ids) >= BLOCK:
            points, full = np.concatenate(held), len(ids) // BLOCK * BLOCK
            for a in range(0, full, BLOCK):
                yield _row(ids[a : a + BLOCK], points[a : a + BLOCK])
            ids, held = ids[full:], [points[full:]]
    if ids:
        yield _row(ids, np.concatenate(held))


def descend(points: np.ndarray, boxes: np.ndarray, centroids: np.ndarray) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """How a tree's vectors are shared out: (level, nodes, cluster of each) of whole nodes, then places and clusters of vectors in leaves."""
    levels, norms, whole = node_bounds(len(points)), (centroids**2).sum(1), []
    nodes, left, at = np.array([0]), np.ones((1, len(centroids)), bool), 0
    for level, bounds in enumerate(levels):
        low, high = boxes[at + nodes, 0].astype(np.int64), boxes[at + nodes, 1].astype(np.int64)
        at += len(bounds) - 1
        # distances to twice the middle, so that they stay whole
        near = np.where(left, ((2 * centroids - (low + high)[:, None]) ** 2).sum(2), np.iinfo(np.int64).max).argmin(1)
        away = centroids - centroids[near][:, None]
        # how far a centroid is behind the near one at the point of the box that favours it most
        behind = norms - norms[near][:, None] - 2 * np.maximum(away * low[:, None], away * high[:, None]).sum(2)
        left &= behind <= 0
        alone = left.sum(1) == 1
        whole.append((level, nodes[alone], left[alone].argmax(1)))
        nodes, left = nodes[~alone], left[~alone]
        if level < len(levels) - 1:
            nodes, left = np.stack([2 * nodes, 2 * nodes + 1], 1).ravel(), np.repeat(left, 2, axis=0)
    sizes = np.diff(levels[-1])[nodes]
    places = np.repeat(levels[-1][nodes] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    mine = points[places]
    # products in doubles are exact below 2^53, and much faster
    small = 4 * points.shape[1] * max(int(np.abs(mine).max(initial=0)), int(np.abs(centroids).max())) ** 2 < 1 << 53
    kind = np.float64 if small else np.int64
    gap = norms.astype(kind) - 2 * (mine.astype(kind) @ centroids.T.astype(kind))
    gap[~np.repeat(left, sizes, axis=0)] = np.inf if small else np.iinfo(np.int64).max
    return whole, places, gap.argmin(1)


def _trees(batch: pa.RecordBatch, dimensions: int) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    for k in range(batch.num_rows):
        ids, n, points, boxes, sums = (batch.column(c)[k] for c in range(5))
        read = lambda x, kind, *shape: np.frombuffer(x.as_buffer(), kind).reshape(*shape, dimensions)
        yield ids, read(points, np.int32, n.as_py()).astype(np.int64), read(boxes, np.int32, -1, 2), read(sums, np.int64, -1)


def _sum_up(centroids: np.ndarray):
    k, dimensions = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64)
        for batch in batches:
            for _, points, boxes, sums in _trees(batch, dimensions):
                whole, places, clusters = descend(points, boxes, centroids)
                at = 0
                for (_, nodes, owners), bounds in zip(whole, node_bounds(len(points)), strict=True):
                    np.add.at(counts, owners, np.diff(bounds)[nodes])
                    np.add.at(totals, owners, sums[at + nodes])
                    at += len(bounds) - 1
                np.add.at(counts, clusters, 1)
                np.add.at(totals, clusters, points[places])
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some]), pa.array(totals[some].tolist(), _SUMS.field("sums").type)], schema=_SUMS)

    return run


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, points, boxes, _ in _trees(batch, centroids.shape[1]):
                whole, places, clusters = descend(points, boxes, centroids)
                owner = np.empty(len(points), np.int64)
                owner[places] = clusters
                for (_, nodes, owners), bounds in zip(whole, node_bounds(len(points)), strict=True):
                    for node, cluster in zip(nodes, owners, strict=True):
                        owner[bounds[node] : bounds[node + 1]] = cluster
                distance = ((points - centroids[owner]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(owner, pa.int32()), pa.array(distance)], schema=_ASSIGNED)

    return run


def moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after a round: floor(sum / count) of their vectors."""
    sums = trees.mapInArrow(_sum_up(centroids), "cluster int, n long, sums array<bigint>")
    rows = sums.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(d))) for d in range(centroids.shape[1])]).alias("sums")).collect()
    out = centroids.copy()
    for r in rows:
        out[r.cluster] = [s // r.n for s in r.sums]
    return out


def cluster_vectors(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of the usable rows of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    whole = whole_vectors(vectors, dimensions, scale)
    centroids = first_centroids(whole, k)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    trees = materialize(whole.mapInArrow(_build, TREES), compression="none")
    for _ in range(rounds):
        centroids = moved(trees, centroids)
    assigned = materialize(trees.mapInArrow(_assign(centroids), "vec_id long, cluster int, distance long"))
    drop_table(trees)
    inertia = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    told = spark.createDataFrame([(c, s, sum(inertia.values()), digest(c)) for c, s in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
