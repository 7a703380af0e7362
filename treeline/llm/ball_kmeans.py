"""Centroid clustering by Ball k-means, exact in integers.

Components become the integers floor(256 x). A cluster is a ball: its centroid, and as radius the largest
distance of the members at hand. Only centroids at most twice the radius away can attract a member; these are its
neighbours, sorted by their distance. A member closer to its centroid than half the way to the nearest neighbour is in
the ball's stable core and compared with nothing. The others lie in annuli: one in the m-th is compared with the first m
neighbours only. A ball none of whose neighbours, nor itself, has moved keeps its members.

Vectors stay where they are. A round is one pass over them: it assigns each vector and adds up, in each
task, the members' components by cluster; only these sums, at most one row a task and cluster, are shuffled, and only the k centroids reach the
driver. So a cluster may hold all vectors.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import checkpointed, small_batches
from .vectors import matrix, usable

CLUSTERS, ROUNDS, SEED, WIDTH = 40, 5, 2, 64
#: Parts in which a cluster's sums are first added.
_PARTS = 16
_LONG = 1 << 63
_ROW = "vec_id long, embedding {kind}, cluster int, distance long, members long, sums array<string>"


class Clustering(NamedTuple):
    """``members`` (vec_id, cluster, distance) and the final centroids, by number."""

    members: DataFrame
    centroids: list[list[int]]


def integers(x: np.ndarray) -> np.ndarray:
    """floor(256 x): as doubles where squared distances are exact in them, else as Python integers."""
    with np.errstate(over="ignore"):
        y = np.floor(x * 256)
    if not y.size or np.isfinite(y).all() and 4 * float(np.abs(y).max()) * float(np.abs(y).max()) * y.shape[1] < 2.0**52:
        return y
    return np.vectorize(lambda v: int(v) * 256 if abs(v) >= 2.0**45 else math.floor(v * 256), otypes=[object])(x)


def _alike(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles or both as Python integers."""
    if (x.dtype == object) == (y.dtype == object):
        return x, y
    plain = np.vectorize(int, otypes=[object])
    return (x, plain(y)) if x.dtype == object else (plain(x), y)


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all of ``y``."""
    if x.dtype == object:
        out = np.zeros((len(x), len(y)), object)
        for j, row in enumerate(y):
            out[:, j] = ((x - row) ** 2).sum(axis=1) if len(x) else 0
        return out
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)[None, :]


class Balls:
    """The centroids of one round, and which of them moved in the round before."""

    def __init__(self, centroids: list[list[int]], moved: list[bool]):
        whole = np.array(centroids, dtype=object).reshape(len(centroids), -1)
        small = not whole.size or 4 * max(abs(v) for v in whole.flat) ** 2 * whole.shape[1] < 2**52
        self.centroids = whole.astype(np.float64) if small else whole
        self.moved = np.array(moved)
        self.apart = _squared(self.centroids, self.centroids)
        #: of each centroid the others, nearest first
        self.order = [np.array(sorted((j for j in range(len(whole)) if j != i), key=lambda j: (self.apart[i, j], j)), np.int64) for i in range(len(whole))]

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each point and its squared distance, ties to the smaller number: all compared."""
        x, y = _alike(points, self.centroids)
        found = _squared(x, y)
        best = np.argmin(found, axis=1)
        return best, found[np.arange(len(x)), best]

    def improved(self, points: np.ndarray, cluster: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for points whose cluster of the last round is known: only neighbours are compared."""
        points, centroids = _alike(points, self.centroids)
        best, distance = cluster.copy(), np.zeros(len(points), points.dtype)
        for ball in np.unique(cluster).tolist():
            rows = np.flatnonzero(cluster == ball)
            x = points[rows]
            own = _squared(x, centroids[ball : ball + 1])[:, 0]
            distance[rows] = own
            order, apart = self.order[ball], self.apart[ball][self.order[ball]]
            # a centroid at D (squared) is no nearer than the ball's own unless D <= 4 own
            near = order[apart <= 4 * own.max()]
            if not len(near) or not (self.moved[ball] or self.moved[near].any()):
                continue
            bounds = apart[: len(near)]
            annulus = np.searchsorted(bounds, 4 * own, side="right") if bounds.dtype != object else np.array([int(sum(b <= 4 * d for b in bounds)) for d in own])
            for m in np.unique(annulus[annulus > 0]).tolist():
                at = np.flatnonzero(annulus == m)
                numbers = np.sort(near[:m])
                found = _squared(x[at], centroids[numbers])
                first = np.argmin(found, axis=1)
                least, number = found[np.arange(len(at)), first], numbers[first]
                better = (least < own[at]) | (least == own[at]) & (number < ball)
                best[rows[at[better]]] = number[better]
                distance[rows[at[better]]] = least[better]
        return best, distance


def _assigned(rows: DataFrame, balls: Balls, first: bool) -> DataFrame:
    """The vectors with their cluster and distance, and behind each task's, a row a cluster with its sums."""
    shared = rows.sparkSession.sparkContext.broadcast(balls)
    kind = rows.schema["embedding"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32() if kind.elementType == T.FloatType() else pa.float64())), ("cluster", pa.int32()), ("distance", pa.int64()), ("members", pa.int64()), ("sums", pa.list_(pa.string()))])
        sums: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            points = integers(matrix(batch.column("embedding")))
            best, distance = shared.value.nearest(points) if first else shared.value.improved(points, batch.column("cluster").to_numpy().astype(np.int64))
            for number in np.unique(best).tolist():
                own = points[best == number]
                held = sums.setdefault(number, [0, 0])
                held[0] += len(own)
                # a batch's sums of doubles are exact integers
                held[1] = held[1] + np.array([int(v) for v in own.sum(axis=0)], dtype=object)
            shown = [int(d) if d < _LONG else None for d in distance.tolist()]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding").cast(schema.field("embedding").type), pa.array(best.astype(np.int32)), pa.array(shown, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.string()))], schema=schema)
        if sums:
            n = len(sums)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, schema.field("embedding").type), pa.array(list(sums), pa.int32()), pa.nulls(n, pa.int64()), pa.array([x[0] for x in sums.values()], pa.int64()), pa.array([[str(v) for v in x[1]] for x in sums.values()], pa.list_(pa.string()))], schema=schema)

    return rows.mapInArrow(run, _ROW.format(kind=kind.simpleString()))


def _added(table: pa.Table) -> pa.Table:
    """One row with the members and sums of all."""
    total = [sum(map(int, column)) for column in zip(*table.column("sums").to_pylist(), strict=True)]
    members = sum(table.column("members").to_pylist())
    return pa.table({"cluster": table.column("cluster").slice(0, 1), "members": pa.array([members], pa.int64()), "sums": pa.array([list(map(str, total))], pa.list_(pa.string()))})


def _totals(assigned: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """(members, sums) of every cluster that has any: a row a task and cluster, added in parts, then together."""
    parts = assigned.where("sums IS NOT NULL").select("cluster", "members", "sums", F.pmod(F.xxhash64("sums"), F.lit(_PARTS)).alias("part"))
    kind = "cluster int, members long, sums array<string>"
    some = parts.groupBy("cluster", "part").applyInArrow(lambda _, table: _added(table), kind)
    return {r.cluster: (r.members, list(map(int, r.sums))) for r in some.groupBy("cluster").applyInArrow(lambda _, table: _added(table), kind).collect()}


def ball_kmeans(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, width: int = WIDTH) -> Clustering:
    """The clusters of ``vectors`` (vec_id, embedding) with exactly ``width`` components, none null or non-finite.

    Centroids start as the vectors with the least sha256 of "seed:vec_id" and are numbered in that order; fewer vectors give as
    many centroids. A round assigns every vector to its nearest centroid, ties to the smaller number, and puts the floor of its
    vectors' mean in every centroid that has any; after the rounds all are assigned once more. All is exact, in Python's integers
    where doubles do not suffice; a squared distance beyond a long is null. Every row is a vector of its own, copies and
    repeated ids too; one without an id is clustered but never a first centroid unless no vector has an id. No
    vectors give no rows; other columns are ignored.
    """
    small_batches(vectors.sparkSession)
    given = vectors.schema["embedding"].dataType
    kind = "array<float>" if given == T.ArrayType(T.FloatType(), given.containsNull) else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    rows = rows.where(usable("embedding") & (F.size("embedding") == width))
    first = rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "embedding").limit(clusters).collect()
    centroids = [[int(v) for v in row] for row in integers(np.array([r.embedding for r in first], np.float64).reshape(len(first), width))]
    if not centroids:
        return Clustering(rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids)
    moved = [True] * len(centroids)
    for turn in range(rounds):
        rows = checkpointed(_assigned(rows, Balls(centroids, moved), not turn))
        before = centroids
        totals = _totals(rows)
        centroids = [[v // totals[i][0] for v in totals[i][1]] if i in totals else old for i, old in enumerate(before)]
        moved = [x != y for x, y in zip(before, centroids, strict=True)]
        rows = rows.where("sums IS NULL").select("vec_id", "embedding", "cluster")
    last = _assigned(rows, Balls(centroids, moved), not rounds)
    return Clustering(last.where("sums IS NULL").select("vec_id", "cluster", "distance"), centroids)


def inertias(found: Clustering) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row a vector.

    Inertias are the squared distances summed over the vector's cluster and over all, null where they exceed a long.
    """
    members = checkpointed(found.members)

    total = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    by_cluster = {r.cluster: r.total for r in members.groupBy("cluster").agg(total.alias("total")).collect()}
    fits = lambda x: int(x) if x is not None and x < _LONG else None
    whole = fits(None if None in by_cluster.values() else sum(by_cluster.values()))
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    stats = [(i, fits(total), whole, digest(found.centroids[i])) for i, total in by_cluster.items()]
    stats = members.sparkSession.createDataFrame(stats, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # one row a centroid
    return members.join(F.broadcast(stats), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, width: int = WIDTH) -> str:
    steps = [
        f"v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS k, e FROM (SELECT sha256('{seed}:' || vec_id) AS h, e FROM v ORDER BY h LIMIT {clusters}))",
        f"i AS (SELECT unnest(range(1, {width + 1})) AS i)",
    ]
    for turn in range(rounds + 1):
        steps.append(f"d{turn} AS (SELECT v.r, c.k, list_sum(list_transform(range(1, {width + 1}), lambda i: (v.e[i] - c.e[i]) * (v.e[i] - c.e[i]))) AS d FROM v, c{turn} c)")
        steps.append(f"a{turn} AS (SELECT r, CAST(min(d) AS BIGINT) AS d, arg_min(k, (d, k)) AS k FROM d{turn} GROUP BY r)")
        if turn < rounds:
            steps.append(f"s{turn} AS (SELECT k, i, CAST(sum(e[i]) AS HUGEINT) AS s, count(*) AS n FROM a{turn} JOIN v USING (r), i GROUP BY k, i)")
            steps.append(f"f{turn} AS (SELECT k, i, CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END AS m FROM s{turn})")
            steps.append(f"c{turn + 1} AS (SELECT c.k, coalesce(n.e, c.e) AS e FROM c{turn} c LEFT JOIN (SELECT k, list(CAST(m AS BIGINT) ORDER BY i) AS e FROM f{turn} GROUP BY k) n USING (k))")
    return (
        "WITH " + ",\n".join(steps) + f"\nSELECT v.vec_id, a.k AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, "
        f"sha256(array_to_string(c.e, ',')) AS centroid_sha256 FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} c USING (k)"
    )


ORACLE_SQL = _oracle()
