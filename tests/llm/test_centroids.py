"""Operator 12 against a version that measures every distance."""

import hashlib
import math

import numpy as np

from tagweave.llm import centroids
from tests.llm.cases import CLASHING


def by_hand(rows, k, rounds, dim, scale):
    kept = [(i, [math.floor(x * scale) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centers = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centers))

    for _ in range(rounds):
        of = {}
        for _, v in kept:
            of.setdefault(nearest(v)[1], []).append(v)
        for n, members in of.items():
            centers[n] = [sum(column) // len(members) for column in zip(*members)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = {}
    for _, d, n in found:
        inertia[n] = inertia.get(n, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted((str(i), n, d, inertia[n], sum(inertia.values()), digest[n]) for i, d, n in found)


def compare(spark, rows, **setting):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for name, kind in (CLASHING | {"v": "string", "cluster": "string", "distance": "double", "total": "int"}).items():
        df = df.withColumn(name, F.lit(None).cast(kind))
    got = centroids.cluster_vectors(df, **setting)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == by_hand(rows, **setting)


def test_clusters_of_drawn_vectors(spark):
    draw = np.random.default_rng(2)
    rows = [(i, (draw.normal(size=6) * (1 + i % 3)).tolist()) for i in range(400)]
    rows += rows[:30]  # repeated rows count as often as they stand there
    rows += [(None, [0.5] * 6), (900, None), (901, []), (902, [1.0] * 5), (903, [1.0] * 7), (904, [1.0, None] * 3),
             (905, [math.nan] * 6), (906, [math.inf] + [0.0] * 5), (907, [-0.0] * 6), (908, [-1e-9] * 6)]
    compare(spark, rows, k=7, rounds=3, dim=6, scale=64)


def test_ties_go_to_the_smaller_number(spark):
    draw = np.random.default_rng(3)
    rows = [(i, draw.integers(-1, 2, 4).astype(float).tolist()) for i in range(300)]
    compare(spark, rows, k=16, rounds=3, dim=4, scale=1)


def test_fewer_vectors_than_centroids_and_none_at_all(spark):
    compare(spark, [(1, [1.0, 2.0]), (2, [3.0, 4.0])], k=16, rounds=2, dim=2, scale=64)
    compare(spark, [(1, [1.0]), (2, None)], k=16, rounds=2, dim=2, scale=64)
    compare(spark, [], k=16, rounds=2, dim=2, scale=64)


def test_the_search_finds_what_measuring_all_finds():
    draw = np.random.default_rng(4)
    for spread, high in ((1, 30), (40, 3), (1 << 20, 1 << 24)):
        centers = draw.integers(-high, high, (50, 64)) + draw.integers(-spread, spread, (50, 1))
        centers = np.clip(centers, -(1 << 24), 1 << 24)
        centers[7] = centers[3]  # equal centroids: the smaller number answers
        v = np.clip(draw.integers(-high, high, (500, 64)) + draw.integers(-spread, spread, (500, 1)), -(1 << 24), 1 << 24)
        v[:50] = centers
        number, distance = centroids.Codebook(centers).nearest(v)
        all_distances = ((v[:, None, :] - centers[None, :, :]) ** 2).sum(axis=2)
        assert (distance == all_distances.min(axis=1)).all()
        assert (number == all_distances.argmin(axis=1)).all()


def test_components_beyond_the_limit_are_left_out(spark):
    limit = centroids.component_limit(64)
    assert limit == 1 << 24
    df = spark.createDataFrame([(1, [float(limit)] * 64), (2, [float(limit - 1)] * 64), (3, [1e300] * 64)],
                               "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in centroids.integer_vectors(df, 64, 1).collect()] == [2]
