"""Operator 13: centroid clustering by Orchard search.

Lloyd's rounds over integer vectors.  In a round a task knows the centroids
and, for each, the list of all centroids by distance from it.  A vector starts
at centroid 0 and walks that centroid's list; where a listed centroid is
closer, the search jumps to that one's list; centroids once measured are
marked and not measured again; the walk ends where the listed centroid lies
strictly beyond twice the vector's distance to its present one, since by the
triangle inequality none from there on can be as close.  All vectors of a
batch take a step at once.

A round sends back a sum and count for each centroid and component from each
batch, summed by Spark: the driver holds the centroids alone, whatever the
number of vectors.  Vectors are turned into integers once and written to the
shared folder.  All arithmetic is in whole numbers, so the result depends on
neither partitions nor the order of rows.

Defined results: a vector is kept if it has exactly ``dim`` components, none
null, NaN or infinite; others are not in the result.  Rows that repeat a
vec_id are vectors of their own; where their hashes tie, the vector that is
less component by component comes first.  A null vec_id hashes as an empty
one.  With fewer than k vectors each is a centroid; an empty table gives an
empty result; other columns are dropped.  A component of 2^27 or more after
scaling would let a distance pass a long and raises an error.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import Scratch

LIMIT = 1 << 27


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, dim: int, scale: int) -> DataFrame:
    """vec_id, v: floor(scale * component) of each vector that is whole."""
    v = F.col(vector_col)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    ints = F.transform(v, lambda x: F.floor(x.cast("double") * scale))
    far = F.exists("v", lambda x: (x >= LIMIT) | (x <= -LIMIT))
    out = df.where((F.size(v) == dim) & whole).select(F.col(id_col).alias("vec_id"), ints.alias("v"))
    return out.select("vec_id", F.when(far, F.raise_error(F.lit("a component is too large"))).otherwise(
        F.col("v").cast("array<int>")).alias("v"))


def neighbour_lists(centroids):
    """For each centroid all others by distance, and those squared distances."""
    import numpy as np

    gap = ((centroids[:, None] - centroids[None]) ** 2).sum(axis=2)
    order = np.argsort(gap, axis=1, kind="stable")
    others = order[order != np.arange(len(gap))[:, None]].reshape(len(gap), -1)
    return others, np.take_along_axis(gap, others, axis=1)


def orchard(vectors, centroids, lists):
    """The nearest centroid (of equal ones the smaller number) and squared distance of each vector."""
    import numpy as np

    others, gaps = lists
    n, k = len(vectors), len(centroids)
    best, at = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    dist = ((vectors - centroids[0]) ** 2).sum(axis=1)
    seen = np.zeros((n, k), dtype=bool)
    seen[:, 0] = True
    walking = np.arange(n) if k > 1 else np.arange(0)
    while len(walking):
        c, i = best[walking], at[walking]
        walking = walking[gaps[c, i] <= 4 * dist[walking]]
        c, i = best[walking], at[walking]
        other = others[c, i]
        new = ~seen[walking, other]
        rows, to = walking[new], other[new]
        seen[rows, to] = True
        d = ((vectors[rows] - centroids[to]) ** 2).sum(axis=1)
        closer = (d < dist[rows]) | ((d == dist[rows]) & (to < best[rows]))
        at[walking] += 1
        jump, to = rows[closer], to[closer]
        best[jump], dist[jump], at[jump] = to, d[closer], 0
        walking = walking[at[walking] < k - 1]
    return best, dist


def _matrix(column, dim):
    import numpy as np

    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _sums(vectors: DataFrame, centroids, dim: int) -> list:
    """cluster, n, sums of the components: one row a centroid that has vectors."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        lists = neighbour_lists(centroids)
        total, count = np.zeros(centroids.shape, dtype=np.int64), np.zeros(len(centroids), dtype=np.int64)
        for b in batches:
            v = _matrix(b.column("v"), dim)
            near, _ = orchard(v, centroids, lists)
            np.add.at(total, near, v)
            count += np.bincount(near, minlength=len(centroids))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"cluster": used.astype(np.int32), "n": count[used], "sums": total[used].tolist()},
                                         schema=pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))

    parts = vectors.select("v").mapInArrow(run, "cluster int, n long, sums array<long>")
    by = parts.select("cluster", "n", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    return by.collect()  # k x dim sums


def centroid_clusters(df: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dim: int = 64, scale: int = 1024,
                      id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    import numpy as np

    spark = df.sparkSession
    vectors = Scratch(spark, "centroids").keep(integer_vectors(df, id_col, vector_col, dim, scale))
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = vectors.select(draw.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], out)
    centroids = np.array([r["v"] for r in first], dtype=np.int64)
    for _ in range(rounds):
        moved = centroids.copy()
        for r in _sums(vectors, centroids, dim):
            moved[r["cluster"], r["i"]] = int(r["s"]) // r["n"]
        centroids = moved

    def assign(batches):
        import pyarrow as pa

        lists = neighbour_lists(centroids)
        for b in batches:
            near, dist = orchard(_matrix(b.column("v"), dim), centroids, lists)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(near, pa.int32()), pa.array(dist, pa.int64())],
                                             names=["vec_id", "cluster", "distance"])

    placed = vectors.withColumn("vec_id", F.col("vec_id").cast("long")).mapInArrow(
        assign, "vec_id long, cluster int, distance long")
    inertia = {r["cluster"]: int(r["s"]) for r in placed.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    facts = [(c, s, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
             for c, s in inertia.items()]
    per = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(per), "cluster").select(  # k rows
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def clusters_sql(k: int = 8, rounds: int = 10, seed: int = 3, dim: int = 64, scale: int = 1024, table: str = "embeddings") -> str:
    """centroid_clusters as DuckDB SQL: every vector against every centroid."""
    steps = [f"""kept AS MATERIALIZED (
      SELECT row_number() OVER () AS nr, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM {table} WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (
      SELECT sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM kept ORDER BY h, v LIMIT {k}))"""]
    near = """(SELECT nr, min(struct_pack(d := list_sum(list_transform(range(1, {d}), lambda i: (kept.v[i] - c.v[i]) * (kept.v[i] - c.v[i]))), c := c.c)) AS m
      FROM kept, c{r} c GROUP BY nr)"""
    for r in range(rounds):
        steps.append(f"""s{r + 1} AS MATERIALIZED (
      SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (
        SELECT m.c AS c, unnest(range(1, {dim + 1})) AS i, unnest(v) AS x FROM {near.format(d=dim + 1, r=r)} JOIN kept USING (nr))
      GROUP BY c, i),
    c{r + 1} AS MATERIALIZED (SELECT c, coalesce(l, v) AS v FROM c{r} LEFT JOIN (
      SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS l FROM s{r + 1} GROUP BY c) USING (c))""")
    return f"""WITH {", ".join(steps)},
    a AS MATERIALIZED (SELECT vec_id, m.c AS c, CAST(m.d AS BIGINT) AS distance FROM {near.format(d=dim + 1, r=rounds)} JOIN kept USING (nr))
    SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
           CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(v, ',')) AS centroid_sha256
    FROM a JOIN c{rounds} USING (c)"""
