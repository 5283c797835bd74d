"""Centroid clustering of integer vectors, filtered by ball trees.

Every task builds metric trees over blocks of its own vectors; a node holds its ball's radius, its count and the integer
sum of its vectors. The trees are written once. A round sends the centroids down them: a centroid that is farther from a
ball's centre than the nearest one by more than twice the radius can win no vector of the ball, so a ball with one
centroid left adds its count and sum to it without a look at its vectors; others go on to their halves, and in a leaf the
squared distances are integers, compared exactly. What comes back from a round is one row a task and centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import cut

DIMENSIONS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Vectors of a tree at the most, and of a leaf unless they are all equal.
BLOCK, LEAF = 4096, 32
#: Largest size of a component: with it no squared distance of 64 components leaves a long.
LARGEST = 1 << 27
TREE = "n int, ids array<long>, vectors binary, nodes binary, radii binary, sums binary"


def kept(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v) of the vectors with exactly so many finite components, as integers floor(scale * x) within LARGEST."""
    e = F.col("embedding")
    fit = (F.size(e) == dimensions) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = lambda x: F.floor(x.cast("double") * scale).cast("long")
    v = F.transform(e, lambda x: F.least(F.greatest(whole(x), F.lit(-LARGEST)), F.lit(LARGEST)).cast("int"))
    return vectors.where(F.coalesce(fit, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def seeds(rows: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    """The vectors with the least hashes of seed and id, in their order; equal hashes by vector, null ids last."""
    hashed = rows.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "v")
    return [list(r["v"]) for r in hashed.orderBy(F.asc_nulls_last("h"), "v").limit(clusters).collect()]


def build(v: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, nodes, radii, sums) of a ball tree over the rows of v.

    nodes: (from, to, left, right) in places of order, children -1 in a leaf. Halves are split at the median of the line
    through the vector farthest from the centre and the one farthest from that.
    """
    order = np.arange(len(v))
    nodes, radii, sums = [[0, len(v), -1, -1]], [], []
    at = 0
    while at < len(nodes):
        a, b = nodes[at][:2]
        own = v[order[a:b]].astype(np.float64)
        sums.append(v[order[a:b]].sum(0, dtype=np.int64))
        off = ((own - sums[-1] / (b - a)) ** 2).sum(1)
        # rounded up, so that rounding never leaves a vector outside its ball
        radii.append(np.sqrt(off.max()) * (1 + 1e-9) + 1e-6)
        one = own[off.argmax()]
        other = own[((own - one) ** 2).sum(1).argmax()]
        if b - a > leaf and (one != other).any():
            order[a:b] = order[a:b][np.argsort(own @ (other - one), kind="stable")]
            mid = (a + b) // 2
            nodes[at][2:] = [len(nodes), len(nodes) + 1]
            nodes += [[a, mid, -1, -1], [mid, b, -1, -1]]
        at += 1
    return order, np.array(nodes, np.int32), np.array(radii), np.array(sums)


def plant(batches: Iterator[pa.RecordBatch], block: int, leaf: int) -> Iterator[pa.RecordBatch]:
    """Trees over blocks of rows (vec_id, v)."""

    def tree(rows: pa.Table) -> pa.RecordBatch:
        flat = rows.column("v").combine_chunks()
        v = flat.flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(len(flat), -1)
        order, nodes, radii, sums = build(v, leaf)
        ids = rows.column("vec_id").combine_chunks().take(pa.array(order))
        held = [v[order].tobytes(), nodes.tobytes(), radii.tobytes(), sums.tobytes()]
        return pa.RecordBatch.from_arrays(
            [pa.array([len(order)], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), ids), *[pa.array([x], pa.binary()) for x in held]],
            ["n", "ids", "vectors", "nodes", "radii", "sums"],
        )

    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            part = batch.slice(start, block - sum(x.num_rows for x in waiting))
            waiting.append(part)
            start += part.num_rows
            if sum(x.num_rows for x in waiting) == block:
                yield tree(pa.Table.from_batches(waiting))
                waiting = []
    if waiting:
        yield tree(pa.Table.from_batches(waiting))


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    v = np.frombuffer(row["vectors"], np.int32).reshape(row["n"], -1)
    return v, np.frombuffer(row["nodes"], np.int32).reshape(-1, 4), np.frombuffer(row["radii"]), np.frombuffer(row["sums"], np.int64).reshape(-1, v.shape[1])


def nearest(v: np.ndarray, nodes: np.ndarray, radii: np.ndarray, sums: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster of each vector of the tree, counts, sums): the nearest centroid, of equally near ones the first."""
    found = np.empty(len(v), np.int32)
    counts, totals = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
    todo = [(0, np.arange(len(centroids)))]
    while todo:
        at, left = todo.pop()
        a, b, one, two = nodes[at]
        far = np.sqrt(((centroids[left] - sums[at] / (b - a)) ** 2).sum(1))
        # more than what rounding can change
        slack = 1e-9 * (far + far.min() + radii[at]) + 1e-6
        left = left[far - far.min() <= 2 * radii[at] + slack]
        if len(left) == 1:
            found[a:b] = left[0]
            counts[left[0]] += b - a
            totals[left[0]] += sums[at]
        elif one < 0:
            # equal vectors may make a leaf larger than LEAF; parts of it keep the working array small
            for x in range(a, b, 4096):
                own = v[x : min(b, x + 4096)].astype(np.int64)
                near = left[np.stack([((own - centroids[c]) ** 2).sum(1) for c in left], 1).argmin(1)]
                found[x : x + len(own)] = near
                counts += np.bincount(near, minlength=len(centroids))
                np.add.at(totals, near, own)
        else:
            todo += [(one, left), (two, left)]
    return found, counts, totals


def one_round(trees: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after a round: the floored means of what each won, an empty one as before."""
    held = np.array(centroids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = np.zeros(len(held), np.int64), np.zeros(held.shape, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                _, n, s = nearest(*unpack(row), held)
                counts, totals = counts + n, totals + s
        won = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(won, pa.int32()), pa.array(counts[won]), pa.array(list(totals[won]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    part = trees.select("n", "vectors", "nodes", "radii", "sums").mapInArrow(run, "cluster int, n long, sums array<long>")
    total = lambda i: F.sum(F.get("sums", i).cast("decimal(20,0)")).alias(f"s{i}")
    out = [list(c) for c in centroids]
    # as many rows as centroids
    for r in part.groupBy("cluster").agg(F.sum("n").alias("n"), *[total(i) for i in range(held.shape[1])]).collect():
        out[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(held.shape[1])]
    return out


def assigned(trees: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    held = np.array(centroids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            for i, row in enumerate(batch.drop_columns(["ids"]).to_pylist()):
                v, *rest = unpack(row)
                found = nearest(v, *rest, held)[0]
                away = ((v - held[found]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column(at).slice(i, 1).flatten(), pa.array(found), pa.array(away)], ["vec_id", "cluster", "distance"])

    return trees.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS, scale: int = SCALE, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept() vector.

    Distances are squared; a sum of them beyond a long is null. Vectors that kept() leaves out (null, of another length,
    with a null or non-finite component) have no row. Repeated rows are vectors of their own, also as first centroids; with
    fewer vectors than clusters there are fewer clusters, without any no rows. A null id is carried along.
    """
    rows = kept(vectors, dimensions, scale)
    centroids = seeds(rows, clusters, seed)
    if not centroids:
        return rows.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    trees = cut(rows.mapInArrow(lambda batches: plant(batches, block, leaf), TREE))
    for _ in range(rounds):
        centroids = one_round(trees, centroids)
    last = cut(assigned(trees, centroids))
    # one row a centroid
    sums = {r["cluster"]: r["d"] for r in last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d")).collect()}
    fits = lambda d: int(d) if d < 1 << 63 else None
    inertia = fits(sum(sums.values()))
    names = [(i, fits(d), inertia, hashlib.sha256(",".join(map(str, centroids[i])).encode()).hexdigest()) for i, d in sums.items()]
    told = last.join(F.broadcast(rows.sparkSession.createDataFrame(names, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster")
    return told.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
