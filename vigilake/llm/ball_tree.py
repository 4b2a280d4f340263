"""Centroid clustering by ball-tree filtering: Lloyd rounds over integer vectors that look at whole balls before single vectors.

The vectors are cut into trees once: each task gathers up to TREE vectors, halves them along the line between two far ones until
LEAF are left, and writes the tree as one row (about a megabyte at most) in the shared folder. A node has its vectors' count,
their integer sum, and a radius around their rounded mean. A round reads the trees: where the triangle inequality says that
one centroid is the nearest of every vector of a ball, the ball's count and sum are added to it unseen; other balls are
descended, in the end to leaves, whose vectors are compared exactly. Tasks give one row per centroid, Spark adds them up,
and CLUSTERS rows come to the driver. The last pass gives every vector its cluster and distance.

All that decides is integer arithmetic; radii are rounded up and a ball is taken whole only by a clear margin, so that the
trees' shape, and with it the partitioning, changes no result. Equal distances go to the smaller number.

Defined results: vectors of another length, or with a component that is null, not finite, or 2**20 or more in magnitude
(whose squares would not fit into a long), are left out; rows without a vec_id are clustered but never a start; rows that
repeat a vec_id are vectors of their own, and starts in the order of their components; fewer vectors than CLUSTERS give so
many clusters; without vectors the result is empty; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.llm.common import save, table
from vigilake.llm.words import KEPT, release

#: Components of a vector, steps of a component's unit, clusters, rounds, and what starts are drawn by.
DIM, SCALE, CLUSTERS, ROUNDS, SEED = 64, 64, 16, 3, "1"
#: Components from this magnitude on count as not finite.
LARGEST = 2**20
#: Vectors of a tree and of a leaf at most.
TREE, LEAF = 4096, 32

_TREE = "vec_ids array<long>, points binary, starts array<int>, ends array<int>, sums binary, radii array<double>"
_EXACT = 2**22  # below this magnitude float products and their sums are exact


def _squares(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of every point to every centroid, exact."""
    small = max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)) < _EXACT
    x, c = (a.astype(np.float64 if small else np.int64) for a in (points, centroids))
    return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None]).astype(np.int64)


def _tree(ids: pa.Array, points: np.ndarray) -> list:
    """One row of _TREE. Node k has the children 2k + 1 and 2k + 2; its vectors stand from start to end; an unused place is empty."""
    n, depth = len(points), 0
    while (n >> depth) > LEAF:
        depth += 1
    order, spans = np.arange(n), [(0, n)]
    for node in range(2**depth - 1):
        a, b = spans[node]
        mid = (a + b) // 2
        part = points[order[a:b]]
        far = part[((part - part.mean(0)) ** 2).sum(1).argmax()]
        along = part @ (part[((part - far) ** 2).sum(1).argmax()] - far)
        order[a:b] = order[a:b][np.argpartition(along, mid - a)]
        spans += [(a, mid), (mid, b)]
    points = points[order]
    total = np.concatenate((np.zeros((1, DIM), np.int64), np.cumsum(points, 0)))
    starts, ends = np.array([s[0] for s in spans]), np.array([s[1] for s in spans])
    sums = total[ends] - total[starts]
    pivots = _pivots(sums, ends - starts)
    radii = [float(np.sqrt(((points[a:b] - p) ** 2).sum(1).max(initial=0))) * (1 + 1e-12) for (a, b), p in zip(spans, pivots, strict=True)]
    return [ids.take(pa.array(order)).to_pylist(), points.astype(np.int32).tobytes(), starts.tolist(), ends.tolist(), sums.tobytes(), radii]


def _pivots(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return sums // np.maximum(counts, 1)[:, None]


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for drop in KEPT.values():
        drop()
    schema = pa.schema([("vec_ids", pa.list_(pa.int64())), ("points", pa.binary()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("sums", pa.binary()), ("radii", pa.list_(pa.float64()))])
    ids, points, have = [], [], 0

    def row(k: int) -> pa.RecordBatch:
        nonlocal ids, points, have
        i, p = pa.concat_arrays(ids), np.concatenate(points)
        ids, points, have = [i[k:]], [p[k:]], len(i) - k
        return pa.record_batch([pa.array([x], f.type) for x, f in zip(_tree(i[:k], p[:k]), schema, strict=True)], schema=schema)

    for batch in batches:
        if batch.num_rows:
            ids.append(batch.column(0))
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, DIM)
            points.append(np.floor(x * SCALE).astype(np.int64))
            have += batch.num_rows
            while have >= TREE:
                yield row(TREE)
    if have:
        yield row(have)
    release()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for r in range(batch.num_rows):
            column = lambda name: batch.column(batch.schema.get_field_index(name))[r]  # noqa: B023, E731
            numbers = lambda name: column(name).values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
            points, sums = (np.frombuffer(column(name).as_py(), kind).reshape(-1, DIM).astype(np.int64) for name, kind in (("points", np.int32), ("sums", np.int64)))
            yield column("vec_ids").values, points, numbers("starts"), numbers("ends"), sums, numbers("radii")


def descended(starts: np.ndarray, ends: np.ndarray, sums: np.ndarray, radii: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(balls, their centroid, leaves): balls that go whole to one centroid, and leaves whose vectors must be looked at, level by level."""
    pivots, first_leaf = _pivots(sums, ends - starts), len(starts) // 2
    level, whole, owner, open_ = np.zeros(1, np.int64), [], [], []
    while len(level):
        level = level[ends[level] > starts[level]]
        away = np.sqrt(_squares(pivots[level], centroids).astype(np.float64))
        best = away.argmin(1)
        nearest = away[np.arange(len(level)), best]
        others = away.copy()
        others[np.arange(len(level)), best] = np.inf
        # every vector of the ball is nearer to best than to any other: |v - best| <= nearest + r < other - r <= |v - other|
        sure = others.min(1, initial=np.inf) - nearest > 2 * radii[level] + 1e-6 * (1 + nearest)
        whole.append(level[sure])
        owner.append(best[sure])
        level = level[~sure]
        open_.append(level[level >= first_leaf])
        level = level[level < first_leaf]
        level = np.concatenate((2 * level + 1, 2 * level + 2))
    return np.concatenate(whole), np.concatenate(owner), np.concatenate(open_)


def _gathered(centroids: np.ndarray):
    """Counts and sums per centroid of a task's trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), DIM), np.int64)
        for _, points, starts, ends, sums, radii in _read(batches):
            balls, owner, leaves = descended(starts, ends, sums, radii, centroids)
            np.add.at(count, owner, (ends - starts)[balls])
            np.add.at(total, owner, sums[balls])
            if len(leaves):
                rest = np.concatenate([points[a:b] for a, b in zip(starts[leaves], ends[leaves], strict=True)])
                near = _squares(rest, centroids).argmin(1)
                np.add.at(count, near, 1)
                np.add.at(total, near, rest)
        release()
        yield pa.record_batch([pa.array(np.arange(len(count), dtype=np.int32)), pa.array(count), pa.array(list(total), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    return run


def _assigned(centroids: np.ndarray):
    """Every vector with its cluster and distance; those of a whole ball are compared with one centroid only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, points, starts, ends, sums, radii in _read(batches):
            balls, owner, leaves = descended(starts, ends, sums, radii, centroids)
            cluster = np.zeros(len(points), np.int32)
            for k, o in zip(balls, owner, strict=True):
                cluster[starts[k] : ends[k]] = o
            if len(leaves):
                at = np.concatenate([np.arange(a, b) for a, b in zip(starts[leaves], ends[leaves], strict=True)])
                cluster[at] = _squares(points[at], centroids).argmin(1)
            distance = ((points - centroids[cluster]) ** 2).sum(1)
            yield pa.record_batch([ids, pa.array(cluster), pa.array(distance)], ["vec_id", "cluster", "distance"])
        release()

    return run


def kept(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the vectors that take part."""
    fine = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < LARGEST, F.lit(False)))
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where((F.size("embedding") == DIM) & fine)


def first_centroids(vectors: DataFrame, k: int = CLUSTERS) -> np.ndarray:
    """The starts: the k vectors of the smallest hashes of the seed and their id."""
    drawn = vectors.where("vec_id is not null").withColumn("h", F.sha2(F.concat(F.lit(f"{SEED}:"), F.col("vec_id").cast("string")), 256))
    rows = drawn.orderBy("h", "embedding").limit(k).select("embedding").collect()
    return np.floor(np.array([r[0] for r in rows], np.float64).reshape(-1, DIM) * SCALE).astype(np.int64)


def clustered(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of the vectors that take part, as a table, and the final centroids."""
    vectors = kept(vectors)
    centroids = first_centroids(vectors, k)
    if not len(centroids):
        return vectors.where("vec_id is not null").select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    trees = save(vectors.mapInArrow(_plant, _TREE), "trees")
    for _ in range(rounds):
        each = trees.mapInArrow(_gathered(centroids), "cluster int, n long, total array<long>")
        sums = each.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(DIM)))
        centroids = centroids.copy()
        for r in sums.where("n > 0").collect():  # k rows
            centroids[r["cluster"]] = np.array(r[2:], np.int64) // r["n"]
    return save(trees.mapInArrow(_assigned(centroids), "vec_id long, cluster int, distance long"), "assigned"), centroids


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = clustered(table(spark, sf_dir, "embeddings"))
    names = [(k, sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for k, c in enumerate(centroids)]
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    # CLUSTERS rows at most
    per = sums.join(spark.createDataFrame(names, "cluster int, centroid_sha256 string"), "cluster").crossJoin(sums.agg(F.sum("cluster_inertia").alias("inertia")))
    return found.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    steps, cells = [], f"generate_series(1, {DIM})"
    for k in range(ROUNDS + 1):
        steps.append(f"""near{k} AS (
  SELECT row_no, unnest([arg_min(c, (d, c))]) AS cluster, min(d) AS distance
  FROM (SELECT row_no, c, list_sum(list_transform({cells}, lambda i: (v[i] - w[i]) * (v[i] - w[i]))) AS d FROM vectors, centroids{k}) GROUP BY row_no)""")
        if k < ROUNDS:
            steps.append(f"""parts{k} AS (SELECT cluster, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM near{k} JOIN vectors USING (row_no), (SELECT unnest({cells}) AS i) GROUP BY cluster, i),
centroids{k + 1} AS (
  SELECT c.c, coalesce(x.w, c.w) AS w FROM centroids{k} c
  LEFT JOIN (SELECT cluster, list((s - (s % n + n) % n) // n ORDER BY i) AS w FROM parts{k} GROUP BY cluster) x ON x.cluster = c.c)""")
    last = f"near{ROUNDS}"
    return f"""
WITH vectors AS (
  SELECT vec_id, row_number() OVER () AS row_no, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(CAST(x AS DOUBLE)) < {LARGEST})) = {DIM}),
centroids0 AS (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS c, v AS w FROM (SELECT v, sha256('{SEED}:' || vec_id) AS h FROM vectors WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {CLUSTERS})),
{", ".join(steps)}
SELECT vec_id, n.cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY n.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.w, ',')) AS centroid_sha256
FROM {last} n JOIN vectors USING (row_no) JOIN centroids{ROUNDS} c ON c.c = n.cluster
"""


QUERIES = {"op12_centroid_clustering": op12_centroid_clustering}
ORACLE_SQL = {"op12_centroid_clustering": _sql()}
