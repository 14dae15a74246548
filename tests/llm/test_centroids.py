"""Centroid clustering: the search against all distances, odd vectors."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from strata.llm import centroid_clusters as C

VECS = "vec_id long, embedding array<float>"


def plain(rows, k, rounds, dim, seed=3, scale=1024):
    kept = [(i, [int(np.floor(float(np.float32(x)) * scale)) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in first[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        centres = [[sum(col) // len(col) for col in zip(*[v for (_, v), o in zip(kept, own, strict=True) if o == j], strict=True)] or c
                   for j, c in enumerate(centres)]
    out = [(i, *nearest(v)) for i, v in kept]
    total = {j: sum(d for _, d, o in out if o == j) for _, _, j in out}
    return sorted(((i, j, d, total[j], sum(total.values()), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest())
                   for i, d, j in out), key=str)


def test_search_equals_all_distances():
    rnd = np.random.default_rng(2)
    vectors = rnd.integers(-6, 7, (3000, 3))
    for k in (1, 2, 7, 40):
        centroids = vectors[rnd.integers(0, 3000, k)]  # with ties and repeated centroids
        d = ((vectors[:, None] - centroids[None]) ** 2).sum(axis=2)
        near, dist = C.orchard(vectors, centroids, C.neighbour_lists(centroids))
        assert (near == d.argmin(axis=1)).all() and (dist == d.min(axis=1)).all()


def test_clusters_equal_plain_rounds(spark):
    rnd = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.round(rnd.normal(size=4), 1)]) for i in range(200)]
    rows += [(200 + i, rows[0][1]) for i in range(100)] + [rows[3], rows[3], (None, rows[5][1]), (9, rows[6][1])]
    rows += [(900, None), (901, []), (902, [1.0]), (903, [1.0, None, 2.0, 3.0]), (904, [float("nan"), 0.0, 0.0, 0.0]),
             (905, [float("inf"), 0.0, 0.0, 0.0]), (906, [0.0] * 5)]
    df = spark.createDataFrame(rows, VECS)
    for c in ("v", "h", "cluster", "n", "sums", "i", "distance"):
        df = df.withColumn(c, F.lit(1))
    for k, rounds in ((8, 10), (3, 0), (500, 2)):
        got = [tuple(r) for r in C.centroid_clusters(df.repartition(5), k, rounds, dim=4).collect()]
        assert sorted(got, key=str) == plain(rows, k, rounds, 4)
    assert C.centroid_clusters(df.limit(0)).collect() == []
    assert C.centroid_clusters(df.where("vec_id = 901"), dim=4).collect() == []


def test_large_components_stop(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0])], VECS)
    try:
        C.centroid_clusters(df, 1, 1, dim=2).collect()
    except Exception as e:  # noqa: BLE001
        assert "too large" in str(e) or "OVERFLOW" in str(e)
    else:
        raise AssertionError
