"""Centroid clustering by the filtering algorithm: kd-trees of each partition's blocks decide whole boxes at once.

Vectors become integers, floor(64 x). A partition's vectors are taken in blocks of BLOCK, each made into a kd-tree once: a
node holds its box, the number of its vectors and their sum, all integers. A round walks each tree with the centroids that
may be nearest to some vector of the node. A centroid is dropped where the one nearest to the box's middle is strictly nearer
to every point of the box; with one centroid left the whole node is assigned by its count and sum; in leaves, and in boxes of
one point, distances decide, ties by the smaller number. So assignments are those of comparing all, and all sums are exact.
A round hands the driver the sums of each centroid, at most ``k`` times DIMENSIONS numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.llm import common

DIMENSIONS = 64
SCALE = 64
BLOCK = 4096
LEAF = 32
LIMIT = 2**27  #: integers beyond it in size would give squared distances beyond a long

TREES = "ids array<long>, points binary, boxes binary, sums binary, spans binary"


def grid(vectors: DataFrame) -> DataFrame:
    """(vec_id, point) of the vectors that are kept: DIMENSIONS components, none null or non-finite, as integers floor(SCALE x).

    Vectors with an integer beyond LIMIT in size are left out like non-finite ones, as a long can't hold their distances.
    """
    x = F.col("embedding")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double") * SCALE) <= LIMIT))
    point = F.transform(x, lambda v: F.floor(v.cast("double") * SCALE).cast("int"))
    return vectors.where((F.size(x) == DIMENSIONS) & F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), point.alias("point"))


def tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, boxes, sums, spans) of a kd-tree: the order of points, and each node's low and high corner, sum, and
    (first point, end, number of its left child, of its right child), -1 for a leaf."""
    order = np.arange(len(points))
    boxes, sums, spans = [], [], []
    todo = [(0, len(points), -1, 0)]
    while todo:
        first, end, up, side = todo.pop()
        part = points[order[first:end]]
        low, high = part.min(0), part.max(0)
        i = len(spans)
        if up >= 0:
            spans[up][2 + side] = i
        boxes.append(np.stack([low, high]))
        sums.append(part.sum(0, dtype=np.int64))
        spans.append([first, end, -1, -1])
        wide = high - low
        axis = int(wide.argmax())
        if end - first > LEAF and wide[axis] > 0:
            middle = (end - first) // 2
            order[first:end] = order[first:end][np.argpartition(part[:, axis], middle)]
            todo += [(first + middle, end, i, 1), (first, first + middle, i, 0)]
    return order, np.array(boxes, np.int32), np.array(sums, np.int64), np.array(spans, np.int32)


def walk(points: np.ndarray, boxes: np.ndarray, sums: np.ndarray, spans: np.ndarray, centroids: np.ndarray, whole: Callable, leaf: Callable) -> None:
    """Assigns every point: ``whole(node, centroid)`` for nodes with one centroid left, ``leaf(first, end, nearest)`` for others."""
    todo = [(0, np.arange(len(centroids)))]
    while todo:
        i, left = todo.pop()
        low, high = boxes[i].astype(np.int64)
        if len(left) > 1:
            them = centroids[left]
            best = them[((2.0 * them - (low + high)) ** 2).sum(1).argmin()]
            corner = np.where(them > best, high, low)  # the box's point that favours each most against the best
            left = left[((them - corner) ** 2).sum(1) <= ((best - corner) ** 2).sum(1)]
        if len(left) == 1:
            whole(i, int(left[0]))
        elif spans[i, 2] >= 0:
            todo += [(spans[i, 3], left), (spans[i, 2], left)]
        else:
            first, end = int(spans[i, 0]), int(spans[i, 1])
            part = points[first : first + 1] if (low == high).all() else points[first:end]
            nearest = left[((part[:, None, :].astype(np.int64) - centroids[left][None]) ** 2).sum(2).argmin(1)]
            leaf(first, end, np.broadcast_to(nearest, end - first) if len(part) == 1 else nearest)


def _grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trees of a partition's vectors, BLOCK at a time."""

    def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids = pa.concat_arrays([b["vec_id"] for b in held])
        points = np.concatenate([b["point"].flatten().to_numpy(zero_copy_only=False) for b in held]).reshape(-1, DIMENSIONS).astype(np.int32)
        order, boxes, sums, spans = tree(points)
        raw = [pa.array([x.tobytes()], pa.binary()) for x in (points[order], boxes, sums, spans)]
        return pa.RecordBatch.from_arrays([pa.array([ids.take(pa.array(order)).to_pylist()], pa.list_(pa.int64())), *raw], names=["ids", "points", "boxes", "sums", "spans"])

    held, n = [], 0
    for batch in common.slices(batches, BLOCK):
        while batch.num_rows:
            part = batch.slice(0, BLOCK - n)
            batch = batch.slice(part.num_rows)
            held.append(part)
            n += part.num_rows
            if n == BLOCK:
                yield made(held)
                held, n = [], 0
    if n:
        yield made(held)


def grown(points: DataFrame) -> DataFrame:
    """Trees of all vectors, written to the shared folder: every round reads them again."""
    return common.staged(points.mapInArrow(_grown, TREES), "trees")


def _arrays(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    get = lambda name, kind, *shape: np.frombuffer(batch[name][i].as_py(), kind).reshape(*shape)
    return get("points", np.int32, -1, DIMENSIONS), get("boxes", np.int32, -1, 2, DIMENSIONS), get("sums", np.int64, -1, DIMENSIONS), get("spans", np.int32, -1, 4)


def sums(trees: DataFrame, centroids: list[list[int]]) -> dict[int, tuple[int, list[int]]]:
    """The number and sum of the vectors of each centroid that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.array(centroids, np.int64)
        counts, totals = np.zeros(len(at), np.int64), np.zeros(at.shape, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                points, boxes, added, spans = _arrays(batch, i)

                def whole(node: int, c: int, added: np.ndarray = added, spans: np.ndarray = spans) -> None:
                    counts[c] += spans[node, 1] - spans[node, 0]
                    totals[c] += added[node]

                def leaf(first: int, end: int, nearest: np.ndarray, points: np.ndarray = points) -> None:
                    np.add.at(counts, nearest, 1)
                    np.add.at(totals, nearest, points[first:end])

                walk(points, boxes, added, spans, at, whole, leaf)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some]), pa.array(totals[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    each = trees.mapInArrow(run, "cluster int, n long, total array<long>")
    parts = each.select("cluster", "n", F.posexplode("total").alias("place", "part"))
    found: dict[int, tuple[int, list[int]]] = {}
    for r in parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).orderBy("cluster", "place").collect():
        found.setdefault(r["cluster"], (r["n"], []))[1].append(int(r["total"]))
    return found


def assign(trees: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(vec_id, cluster, distance) of every vector: its nearest centroid and the squared distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.array(centroids, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                points, boxes, added, spans = _arrays(batch, i)
                cluster = np.zeros(len(points), np.int32)

                def whole(node: int, c: int, cluster: np.ndarray = cluster, spans: np.ndarray = spans) -> None:
                    cluster[spans[node, 0] : spans[node, 1]] = c

                def leaf(first: int, end: int, nearest: np.ndarray, cluster: np.ndarray = cluster) -> None:
                    cluster[first:end] = nearest

                walk(points, boxes, added, spans, at, whole, leaf)
                distance = ((points.astype(np.int64) - at[cluster]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([batch["ids"][i].values, pa.array(cluster), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return trees.mapInArrow(run, "vec_id long, cluster int, distance long")


def initial(points: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The ``k`` vectors with the smallest sha256 of ``salt:<vec_id>``, in its order; repeated ids by their components."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    return [list(r["point"]) for r in points.where("vec_id is not null").select(key.alias("key"), "point").orderBy("key", "point").limit(k).collect()]


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, salt: str = "1") -> DataFrame:
    """One row for each kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Centroids start as ``initial`` says; each of ``rounds`` rounds assigns all vectors and replaces every centroid that has
    any by floor(sum / count) of each component; all are then assigned once more. A vector without id is assigned, and counts,
    but is never a first centroid. Repeated rows count as often as they stand there. With fewer than ``k`` kept vectors there
    are as many centroids; with none that has an id, and for an empty table, the result is empty. Other columns are not read.
    """
    points = grid(vectors)
    centroids = initial(points, k, salt)
    if not centroids:
        none = points.where(F.lit(False))
        return none.select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
    trees = grown(points)
    for _ in range(rounds):
        for c, (n, total) in sums(trees, centroids).items():
            centroids[c] = [t // n for t in total]
    found = assign(trees, centroids)
    inertia = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of = lambda values: F.element_at(F.lit(values), F.col("cluster") + 1)
    return found.select(
        "vec_id", "cluster", "distance", of([inertia.get(i, 0) for i in range(len(centroids))]).cast("long").alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), of(digests).alias("centroid_sha256")
    )
