"""Exact top-k inner products with a KD-tree in every shard.

Components become the integers floor(256 x). Median splits over a bounded sample cut the space into leaves, and a
leaf's rows into shards. A shard's tree splits at the median of its widest dimension and
keeps the tight bounding box of every node; a query goes through it best-first by the largest
inner product that a box allows, and stops at the first box below its k-th score so far. Each
query is searched in its home shard first; the k-th score goes along to the few leaves whose boxes promise most, and
from there to the others: a query is only sent to a leaf whose box allows its k-th score.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import broadcast_if_small, checkpointed, small_batches
from .vectors import matrix, usable

K, QUERY_EVERY = 5, 50
#: Rows of a shard, about, and of a leaf of its tree; queries that one task puts to a shard.
SHARD_ROWS, LEAF_ROWS, SHARD_QUERIES = 4_096, 32, 65_536
#: Rows that the split into leaves is learned from, and of them in each leaf at least, so that boxes stay few.
SAMPLE, LEAST_SAMPLED = 16_384, 16
#: Leaves that a query visits after its home, before the others.
FIRST_LEAVES = 4
#: Boxes that may be broadcast; parts of shards likewise.
_BROADCAST_BOXES = 8_192
_LOWEST, _LONG = -(1 << 63), 1 << 63


class KdTree:
    """Median splits over integer points, with tight bounding boxes, for inner-product search."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF_ROWS):
        self.ids, self.points = ids, points
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.below: list[tuple[int, int] | np.ndarray] = []
        self._grow(np.arange(len(ids)), leaf)
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _grow(self, rows: np.ndarray, leaf: int) -> int:
        box = self.points[rows]
        number = len(self.below)
        self.low.append(box.min(axis=0))
        self.high.append(box.max(axis=0))
        self.below.append(rows)
        if len(rows) > leaf:
            widest = int(np.argmax(self.high[number] - self.low[number]))
            half = len(rows) // 2
            order = np.argsort(box[:, widest], kind="stable") if box.dtype == object else np.argpartition(box[:, widest], half)
            self.below[number] = (self._grow(rows[order[:half]], leaf), self._grow(rows[order[half:]], leaf))
        return number

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product that each node's box allows with each query."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query_id: int, query: np.ndarray, bound: np.ndarray, k: int, floor: int) -> list[tuple[int, int]]:
        """(score, -id) of the k best points other than the query's own, best first.

        Only scores of at least ``floor`` are kept; equal scores prefer the smaller id.
        """
        best: list[tuple[int, int]] = []
        open_nodes = [(-bound[0], 0)]
        while open_nodes:
            most, node = heapq.heappop(open_nodes)
            if -most < (best[0][0] if len(best) == k else floor):
                break
            below = self.below[node]
            if isinstance(below, tuple):
                for child in below:
                    heapq.heappush(open_nodes, (-bound[child], child))
                continue
            for score, found in zip((self.points[below] @ query).tolist(), self.ids[below].tolist(), strict=True):
                score = min(max(score, -_LONG), _LONG - 1)
                if found != query_id and score >= floor:
                    if len(best) < k:
                        heapq.heappush(best, (score, -found))
                    elif (score, -found) > best[0]:
                        heapq.heapreplace(best, (score, -found))
        return sorted(best, reverse=True)


def _integers(x: np.ndarray) -> np.ndarray:
    """floor(256 x): doubles where all inner products are exact in them, else Python integers."""
    with np.errstate(over="ignore"):
        y = np.floor(x * 256)
    if not y.size or np.isfinite(y).all() and float(np.abs(y).max()) * float(np.abs(y).max()) * y.shape[1] < 2.0**52:
        return y
    return np.vectorize(lambda v: int(v) * 256 if abs(v) >= 2.0**45 else math.floor(v * 256), otypes=[object])(x)


class Splits:
    """Median splits of a sample, by width: which leaf a vector lies in."""

    def __init__(self, sample: dict[int, np.ndarray], leaves: dict[int, int]):
        self.trees = {width: self._split(x, leaves[width]) for width, x in sample.items()}

    def _split(self, x: np.ndarray, leaves: int) -> tuple | int:
        """(dimension, value, below, above), or the number of leaves so far in a leaf's place."""
        self.made = 0

        def grow(x: np.ndarray, leaves: int) -> tuple | int:
            widest = int(np.argmax(x.max(axis=0) - x.min(axis=0))) if len(x) else 0
            value = float(np.median(x[:, widest])) if len(x) else 0.0
            above = x[:, widest] > value if len(x) else np.zeros(0, bool)
            if leaves < 2 or not above.any():
                self.made += 1
                return self.made - 1
            return widest, value, grow(x[~above], leaves - leaves // 2), grow(x[above], leaves // 2)

        return grow(x, leaves)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(x), np.int32), [(np.arange(len(x)), self.trees.get(x.shape[1], 0))]
        while todo:
            rows, tree = todo.pop()
            if isinstance(tree, int):
                out[rows] = tree
            else:
                above = x[rows, tree[0]] > tree[1]
                todo += [(rows[~above], tree[2]), (rows[above], tree[3])]
        return out


def _by_width(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, rows, vectors) of a batch (width, embedding)."""
    widths = batch.column("width").to_numpy()
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width)
        yield width, own, matrix(batch.column("embedding").take(pa.array(own)))


def _boxes(placed: DataFrame) -> DataFrame:
    """(width, leaf, low, high): the tight box of every leaf, in doubles that bound its integers."""
    schema = "width int, leaf int, low array<double>, high array<double>"

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[tuple[int, int], np.ndarray] = {}
        high: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            leaves = batch.column("leaf").to_numpy()
            for width, rows, x in _by_width(batch):
                for leaf in np.unique(leaves[rows]).tolist():
                    own = x[leaves[rows] == leaf]
                    key = width, leaf
                    low[key] = np.minimum(low.get(key, np.inf), own.min(axis=0))
                    high[key] = np.maximum(high.get(key, -np.inf), own.max(axis=0))
        yield _box_rows(low, high)

    def whole(table: pa.Table) -> pa.Table:
        key = table.column("width")[0].as_py(), table.column("leaf")[0].as_py()
        return pa.Table.from_batches([_box_rows({key: matrix(table.column("low")).min(axis=0)}, {key: matrix(table.column("high")).max(axis=0)})])

    return placed.select("width", "leaf", "embedding").mapInArrow(part, schema).groupBy("width", "leaf").applyInArrow(whole, schema)


def _box_rows(low: dict, high: dict) -> pa.RecordBatch:
    lists = lambda x: pa.array([v.tolist() for v in x.values()], pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in low], pa.int32()), pa.array([k[1] for k in low], pa.int32()), lists(low), lists(high)], names=["width", "leaf", "low", "high"])


def _allowed(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """At least the largest inner product that each box allows each query, both as integers floor(256 x)."""
    with np.errstate(over="ignore", invalid="ignore"):
        x, low, high = (np.floor(y * 256) for y in (x, low, high))
        most = np.maximum(x, 0) @ high.T + np.minimum(x, 0) @ low.T
        size = np.abs(x) @ np.maximum(np.abs(low), np.abs(high)).T
    most = np.where(np.isfinite(most) & np.isfinite(size), most + size * 1e-12 + 1, np.inf)
    return np.minimum(most, float(_LONG))


def _searched(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The results of sorted rows (width, leaf, part, lot, query, id, floor, embedding): each shard, then its queries."""
    shard, tree, held = None, None, []
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("width", "leaf", "part", "lot")), strict=True))
        asked = batch.column("query").to_pylist()
        start, found = 0, []
        while start < len(keys):
            stop = start
            while stop < len(keys) and keys[stop] == keys[start] and asked[stop] == asked[start]:
                stop += 1
            rows = batch.slice(start, stop - start)
            if keys[start] != shard:
                shard, tree, held = keys[start], None, []
            if not asked[start]:
                held.append(rows)
            elif held:
                if tree is None:
                    table = pa.Table.from_batches(held)
                    tree = KdTree(table.column("id").to_numpy(), _integers(matrix(table.column("embedding"))))
                queries = _integers(matrix(rows.column("embedding")))
                if (queries.dtype == object) != (tree.points.dtype == object):
                    plain = np.vectorize(int, otypes=[object])
                    if queries.dtype == object:
                        tree = KdTree(tree.ids, plain(tree.points))
                    else:
                        queries = plain(queries)
                bounds = tree.bounds(queries)
                for i, (query_id, floor) in enumerate(zip(rows.column("id").to_pylist(), rows.column("floor").to_pylist(), strict=True)):
                    found += [(query_id, -other, int(score)) for score, other in tree.search(query_id, queries[i], bounds[i], k, floor)]
            start = stop
        columns = list(zip(*found, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, k: int = K, query_every: int = QUERY_EVERY, shard_rows: int = SHARD_ROWS, sample: int = SAMPLE, shard_queries: int = SHARD_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` best other rows, all where there are fewer.

    Queries are the rows whose vec_id is divisible by ``query_every``. Leaves are learned from at most ``sample`` rows, the ones
    with the least hashes; every row is in one. A shard's rows are read into its tree once for up to ``shard_queries`` queries, which
    pass through it in batches. Scores are exact
    integers, those beyond a long its ends; ties go to the smaller vec_id. Vectors that are null, empty or hold a null or
    non-finite component, and rows with a null vec_id, take no part; vectors of another
    length than the query's are no candidates. Repeated rows are candidates each; a
    vec_id is one query, by its least vector. No queries give no rows; other columns are ignored.
    """
    small_batches(vectors.sparkSession)
    given = vectors.schema["embedding"].dataType
    kept = "array<float>" if given == T.ArrayType(T.FloatType(), given.containsNull) else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kept).alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable("embedding")).withColumn("width", F.size("embedding"))
    placed = checkpointed(_placed(rows, kept, shard_rows, sample))
    shard = ["width", "leaf", "part"]
    least = F.min(F.struct("embedding", *shard)).alias("q")
    queries = placed.where(F.col("vec_id") % query_every == 0).groupBy("vec_id").agg(least).select(F.col("vec_id").alias("query_id"), "q.*")
    queries = checkpointed(queries)
    boxes = checkpointed(_boxes(placed))
    parts = checkpointed(placed.groupBy("width", "leaf").agg((F.max("part") + 1).alias("parts")))

    def searched(asked: DataFrame) -> DataFrame:
        lots = asked.groupBy(shard).agg(F.ceil(F.count("*") / shard_queries).cast("int").alias("lots")).where("lots > 1")
        lots = broadcast_if_small(checkpointed(lots), _BROADCAST_BOXES)
        n = F.coalesce("lots", F.lit(1))
        points = placed.join(lots, shard, "left").select(*shard, F.explode(F.sequence(F.lit(0), n - 1)).alias("lot"), F.lit(False).alias("query"), F.col("vec_id").alias("id"), F.lit(0).cast("long").alias("floor"), "embedding")
        put = asked.join(lots, shard, "left").select(*shard, F.pmod(F.xxhash64("query_id"), n).cast("int").alias("lot"), F.lit(True).alias("query"), F.col("query_id").alias("id"), "floor", "embedding")
        both = points.unionByName(put).repartition(*shard, "lot").sortWithinPartitions(*shard, "lot", "query", "id")
        return both.mapInArrow(lambda batches: _searched(batches, k), "query_id long, vec_id long, score long")

    def floors(found: DataFrame) -> DataFrame:
        best = _ranked(found, k).groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
        return best.select("query_id", F.when(F.col("n") >= k, F.col("least")).otherwise(_LOWEST).alias("floor"))

    def onwards(found: DataFrame, first: bool) -> DataFrame:
        asked = queries.join(floors(found), "query_id", "left").na.fill(_LOWEST, ["floor"])
        leaves = _leaves(asked.withColumnsRenamed({"leaf": "home", "part": "home_part"}), boxes, first)
        every = leaves.join(broadcast_if_small(parts, _BROADCAST_BOXES), ["width", "leaf"])
        every = every.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return every.where("leaf <> home OR part <> home_part").select("query_id", "embedding", "floor", *shard)

    found = checkpointed(searched(queries.withColumn("floor", F.lit(_LOWEST).cast("long"))))
    for first in (True, False):
        found = checkpointed(found.unionAll(searched(onwards(found, first))))
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _placed(rows: DataFrame, kept: str, shard_rows: int, sample: int) -> DataFrame:
    """``rows`` (vec_id, embedding, width) with their leaf, and the part of it that is their shard."""
    wanted = {r.width: -(-r.n // shard_rows) for r in rows.groupBy("width").agg(F.count("*").alias("n")).where(F.col("n") > shard_rows).orderBy(F.desc("n")).limit(64).collect()}
    splits = None
    if wanted:
        chosen = rows.where(F.col("width").isin(*wanted)).orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(sample).toArrow()
        found = {}
        for batch in chosen.to_batches():
            for width, _, x in _by_width(batch):
                found.setdefault(width, []).append(x)
        learned = {width: np.concatenate(x) for width, x in found.items()}
        splits = rows.sparkSession.sparkContext.broadcast(Splits(learned, {w: min(wanted[w], max(1, len(x) // LEAST_SAMPLED)) for w, x in learned.items()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = np.zeros(batch.num_rows, np.int32)
            for _, own, x in _by_width(batch) if splits else ():
                leaves[own] = splits.value.leaf_of(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves)], names=[*batch.schema.names, "leaf"])

    leaf = checkpointed(rows.mapInArrow(run, f"vec_id long, embedding {kept}, width int, leaf int"))
    sizes = leaf.groupBy("width", "leaf").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("parts"))
    sizes = broadcast_if_small(checkpointed(sizes), _BROADCAST_BOXES)
    part: Column = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("parts")).cast("int").alias("part")
    return leaf.join(sizes, ["width", "leaf"]).select("vec_id", "embedding", "width", "leaf", part)


def _leaves(asked: DataFrame, boxes: DataFrame, first: bool) -> DataFrame:
    """``asked`` (query_id, embedding, floor, width, ...) with each ``leaf`` whose box allows the floor: the most promising, or the rest."""
    names = [c for c in asked.columns]
    schema = T.StructType([*asked.schema.fields, T.StructField("leaf", T.IntegerType())])
    if boxes.count() > _BROADCAST_BOXES:
        # too many lengths of vectors: every leaf of the query's length, once
        every = asked.join(boxes.select("width", "leaf"), "width").select(*names, "leaf")
        return every.limit(0) if first else every
    found = asked.sparkSession.sparkContext.broadcast(boxes.toArrow())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        widths = found.value.column("width").to_numpy()
        known = {}
        for width in np.unique(widths).tolist():
            own = found.value.filter(pa.array(widths == width))
            known[width] = own.column("leaf").to_numpy(), matrix(own.column("low")), matrix(own.column("high"))
        for batch in batches:
            floors = batch.column("floor").to_numpy()
            for width, rows, x in _by_width(batch):
                leaves, low, high = known[width]
                bound = _allowed(x, low, high)
                order = np.argsort(-bound, axis=1, kind="stable")
                order = order[:, :FIRST_LEAVES] if first else order[:, FIRST_LEAVES:]
                i, j = np.nonzero(np.take_along_axis(bound, order, axis=1) >= floors[rows][:, None])
                taken = batch.take(pa.array(rows[i]))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(leaves[order[i, j]].astype(np.int32))], names=[*names, "leaf"])

    return asked.select(*names).mapInArrow(run, schema)


ORACLE_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % {QUERY_EVERY} = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
