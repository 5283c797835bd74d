"""Clustering by ball trees against all distances, with ties, repeated rows, odd vectors and clashing columns."""

import hashlib
import math
import random

import numpy as np
import pytest

from logweave.llm import ball_tree


def brute(rows, clusters, rounds, seed, dimensions, scale):
    fit = [(i, [math.floor(scale * x) for x in e]) for i, e in rows if e is not None and len(e) == dimensions and all(x is not None and math.isfinite(x) for x in e)]
    hashed = sorted(fit, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in hashed[:clusters]]
    away = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    best = lambda v: min((away(v, c), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        won = [best(v)[1] for _, v in fit]
        for c in range(len(centroids)):
            if own := [v for (_, v), w in zip(fit, won, strict=True) if w == c]:
                centroids[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    last = [best(v) for _, v in fit]
    inertia = {c: sum(d for d, w in last if w == c) for c in range(len(centroids))}
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), name[c]) for (i, _), (d, c) in zip(fit, last, strict=True)), key=repr)


def vectors(n, d, rng, kind):
    if kind == "blobs":
        middles = [[rng.uniform(-1, 1) for _ in range(d)] for _ in range(5)]
        return [[m + rng.gauss(0, 0.05) for m in rng.choice(middles)] for _ in range(n)]
    if kind == "grid":  # many equal distances
        return [[rng.randint(-1, 1) / 2 for _ in range(d)] for _ in range(n)]
    return [[0.25] * d if rng.random() < 0.5 else [rng.uniform(-1e6, 1e6) for _ in range(d)] for _ in range(n)]


@pytest.mark.parametrize(("kind", "d", "clusters", "rounds", "block", "leaf"), [("blobs", 64, 16, 3, 4096, 32), ("grid", 3, 7, 3, 50, 4), ("grid", 2, 16, 2, 64, 1), ("hot", 8, 4, 3, 40, 8), ("blobs", 4, 3, 0, 30, 2)])
def test_cluster(spark, kind, d, clusters, rounds, block, leaf):
    rng = random.Random(f"{kind}{d}")
    f32 = lambda v: [float(np.float32(x)) for x in v]
    rows = [(i, f32(v)) for i, v in enumerate(vectors(200, d, rng, kind))]
    rows += [(3, rows[3][1]), (3, rows[3][1]), (None, rows[9][1]), (500, None), (501, []), (502, [0.5] * (d + 1)), (503, [None] + [0.0] * (d - 1)), (504, [math.nan] * d), (505, [0.1] * (d - 1) + [math.inf])]
    df = spark.createDataFrame([(i, e, 1, "x", "y") for i, e in rows], "vec_id long, embedding array<float>, cluster int, v string, n string").repartition(3)
    got = ball_tree.cluster(df, clusters, rounds, 1, d, 64, block, leaf)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, clusters, rounds, 1, d, 64)


def test_few_and_none(spark):
    kind = "vec_id long, embedding array<float>"
    few = [(1, [1.0, 0.0]), (2, [0.0, 1.0])]
    assert sorted(map(tuple, ball_tree.cluster(spark.createDataFrame(few, kind), dimensions=2).collect())) == brute(few, 16, 3, 1, 2, 64)
    for rows in ([], [(1, None), (2, [1.0])]):
        assert ball_tree.cluster(spark.createDataFrame(rows, kind), dimensions=2).collect() == []


def test_balls_hold_their_vectors_and_spare_distances():
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(m, 2, (300, 8)) for m in (-500, 0, 500)]).astype(np.int32)
    order, nodes, radii, sums = ball_tree.build(v, 16)
    assert sorted(order) == list(range(len(v)))
    for (a, b, one, two), r, s in zip(nodes, radii, sums, strict=True):
        own = v[order[a:b]]
        assert (own.sum(0) == s).all() and np.sqrt(((own - s / (b - a)) ** 2).sum(1)).max() <= r
        assert one < 0 or (nodes[one][0], nodes[one][1], nodes[two][0], nodes[two][1]) == (a, nodes[two][0], nodes[one][1], b)
    looked_at = []

    class Watched(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, slice):
                looked_at.append(at.stop - at.start)
            return super().__getitem__(at)

    centroids = np.array([[-500] * 8, [0] * 8, [500] * 8])
    found, counts, totals = ball_tree.nearest(v[order].view(Watched), nodes, radii, sums, centroids)
    assert counts.tolist() == [300, 300, 300] and (totals.sum(0) == v.sum(0)).all() and len(found) == 900
    # whole balls are assigned from their sums: only a leaf astride two clouds is looked into
    assert sum(looked_at) <= 32
