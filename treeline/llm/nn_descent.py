"""Embedding near-duplicates by NN-descent over a neighbour graph.

Every vector keeps a short list of neighbours, started from its neighbours in several orders by
random-hyperplane codes. A round joins each vector's neighbours, both ways, with each other, and
keeps the closest; a list full of links is enlarged. Rounds go on until few links are new. Links that reach
the threshold form components. Components with saturated
lists, whose entries all reach the threshold, are compared with each other exactly, as far as their
centres and radii let them link. The lists of
linked vectors are then enlarged to their whole component, in blocks, so that groups far larger
than a list lose no link; copies of one vector are one node with a weight.

Two audits measure the recall, by linked vectors. Sampled vectors are compared with all others of their label;
the sample is bounded, whatever the table. Where links are rare it may hold none, so probes go along from the
start: twins of sampled vectors just above the threshold, which nothing but the descent can find and which are
never part of a result. While either recall is too low, further orders and rounds follow; if it stays below
the least one accepted, all vectors are compared.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import connected_components
from .shared import broadcast_if_small, checkpointed
from .vectors import matrix, usable

SIMILARITY, LIST, RECALL = 0.98, 8, 0.98
#: Entries of a list that is full of links; rounds at least and at most before all vectors are compared, unless the
#: recall is the least accepted; share of new links from which on another round follows.
GROWN, ROUNDS, MOST_ROUNDS, LEAST_RECALL, NEW = 16, 2, 8, 0.9, 0.01
#: Orders by hyperplane codes, bits of a code, neighbours taken on each side in an order.
ORDERS, BITS, NEAR = 10, 48, 3
#: Vectors that the audit starts with and linked ones that it wants, those that it compares at most, and probes.
AUDITED, MOST_AUDITED, PROBES = 256, 8448, 256
_BLOCK = 512
#: Rows of one broadcast at most; other labels than whole numbers that may be broadcast.
_CHUNK, _BROADCAST_LABELS = 8192, 100_000
_EDGE = "a long, b long, cosine double"
_log = logging.getLogger(__name__)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, also of those whose squares overflow or vanish: first scaled by a power of two, which is exact."""
    _, exponent = np.frexp(np.abs(x).max(axis=1, keepdims=True)) if x.size else (x, np.zeros((len(x), 1), int))
    x = np.ldexp(x, -exponent)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cosines(x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Cosines of unit rows; those at the threshold do not depend on how rows are blocked."""
    cosine = x @ y.T
    i, j = np.nonzero(np.abs(cosine - similarity) < 1e-9)
    cosine[i, j] = (x[i] * y[j]).sum(axis=1)
    return cosine


def _edges(a: np.ndarray, b: np.ndarray, cosine: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(cosine.astype(np.float64))], names=["a", "b", "cosine"])


def _batched(batches: Iterator[pa.RecordBatch], rows: int, overlap: int) -> Iterator[pa.Table]:
    """The partition as tables of about so many rows, each starting with the last few of the one before."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= rows:
            table = pa.Table.from_batches(held)
            yield table
            held = table.slice(max(0, table.num_rows - overlap)).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _started(nodes: DataFrame, orders: int, bits: int, near: int, seed: int) -> DataFrame:
    """Edges of vectors that lie close in an order by (label, code)."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            widths = batch.column("width").to_numpy()
            for order in range(orders):
                codes = np.zeros(len(widths), np.int64)
                for width in np.unique(widths):
                    own = widths == width
                    codes[own] = _codes(matrix(batch.column("vector").filter(pa.array(own))), planes, order, bits, seed)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, order), pa.int32()), pa.array(codes), *batch.columns], names=["order", "code", *batch.schema.names])

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _batched(batches, 4096, near):
            groups = [table.column(c).to_numpy() for c in ("order", "label", "width")]
            ids = table.column("id").to_numpy()
            change = np.flatnonzero(groups[2][1:] != groups[2][:-1]) + 1
            for start, stop in zip([0, *change], [*change, len(ids)], strict=True):
                x = _unit(matrix(table.column("vector").slice(start, stop - start)))
                for step in range(1, min(near, stop - start - 1) + 1):
                    same = np.logical_and.reduce([g[start : stop - step] == g[start + step : stop] for g in groups[:2]])
                    a, b = ids[start : stop - step][same], ids[start + step : stop][same]
                    cosine = (x[:-step][same] * x[step:][same]).sum(axis=1)
                    yield _edges(np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([cosine, cosine]))

    rows = nodes.select("id", "label", "width", "vector").mapInArrow(coded, "order int, code long, id long, label long, width int, vector array<double>")
    ranged = rows.repartitionByRange("order", "label", "width", "code", "id").sortWithinPartitions("order", "label", "width", "code", "id")
    return ranged.mapInArrow(neighbours, _EDGE)


def _codes(x: np.ndarray, planes: dict[int, np.ndarray], order: int, bits: int, seed: int) -> np.ndarray:
    """Signs against random hyperplanes, as an integer."""
    key = order << 32 | x.shape[1]
    if key not in planes:
        planes[key] = np.random.default_rng([seed, order, x.shape[1]]).standard_normal((x.shape[1], bits))
    return ((x @ planes[key] > 0).astype(np.int64) << np.arange(bits, dtype=np.int64)[::-1]).sum(axis=1)


def _closest(edges: DataFrame, size: int, grown: int, similarity: float) -> DataFrame:
    """The ``size`` best edges of every node, and up to ``grown`` of one whose list is full of links."""
    once = edges.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.col("cosine").desc(), "b"))
    listed = once.withColumn("rank", rank).where(F.col("rank") <= grown)
    return listed.where((F.col("rank") <= size) | (F.col("cosine") >= similarity)).drop("rank")


def _joined(graph: DataFrame, nodes: DataFrame, size: int, grown: int, turn: int, similarity: float) -> DataFrame:
    """Edges between the neighbours of each node, out of its list and as many that list it: the best four and all links."""
    back = F.row_number().over(Window.partitionBy("b").orderBy(F.xxhash64("a", F.lit(turn)), "a"))
    listed = graph.withColumn("back", back).where(F.col("back") <= size).select(F.col("b").alias("pivot"), F.col("a").alias("id"))
    around = graph.select(F.col("a").alias("pivot"), F.col("b").alias("id")).unionAll(listed)
    around = around.unionAll(graph.select(F.col("a").alias("pivot"), F.col("a").alias("id"))).distinct()
    rows = around.join(nodes.select("id", "vector"), "id")
    rows = rows.repartition("pivot").sortWithinPartitions("pivot", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _batched(batches, 4096, grown + size + 1):
            pivots, ids = table.column("pivot").to_numpy(), table.column("id").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(pivots[1:] != pivots[:-1]) + 1, [len(pivots)]])
            found: list[tuple] = []
            for start, stop in zip(edges[:-1], edges[1:], strict=True):
                if stop - start > 1:
                    own = ids[start:stop]
                    x = _unit(matrix(table.column("vector").slice(start, stop - start)))
                    cosine = _cosines(x, x, similarity)
                    np.fill_diagonal(cosine, -2)
                    taken = cosine >= similarity
                    best = np.argsort(-cosine, axis=1, kind="stable")[:, : min(4, len(own) - 1)]
                    np.put_along_axis(taken, best, True, axis=1)
                    np.fill_diagonal(taken, False)
                    a, b = np.nonzero(taken)
                    found.append((own[a], own[b], cosine[a, b]))
            if found:
                yield _edges(*(np.concatenate(c) for c in zip(*found, strict=True)))

    return rows.select("pivot", "id", "vector").mapInArrow(run, _EDGE)


def _merged(component: DataFrame, edges: DataFrame) -> DataFrame:
    """The components after further edges (a, b) between nodes; the same where there are none."""
    edges = checkpointed(edges)
    if not edges.take(1):
        return component
    return checkpointed(connected_components(component.select(F.col("id").alias("a"), F.col("component").alias("b")).unionAll(edges)))


def _between(graph: DataFrame, component: DataFrame, nodes: DataFrame, similarity: float, size: int) -> DataFrame | None:
    """Links (a, b) between components with saturated lists, one at least of any two that have some; None without two such.

    A list full of links drops those behind them, so nothing else would find a link between two
    crowds. Components are dealt out in pieces of about a block; by the triangle
    inequality of angles only pieces whose centres lie within their radii and the threshold can link.
    """
    lists = graph.groupBy("a").agg(F.count("*").alias("n"), F.min("cosine").alias("least"))
    full = lists.where((F.col("n") >= size) & (F.col("least") >= similarity)).select(F.col("a").alias("id"))
    crowds = checkpointed(full.join(component, "id").select("component").distinct())
    if crowds.count() < 2:
        return None
    members = component.join(crowds, "component")
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / _BLOCK).alias("blocks"))
    members = members.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    members = checkpointed(members.join(nodes.select("id", F.col("label").cast("long").alias("label"), "width", "vector"), "id").drop("blocks"))

    def middle(table: pa.Table) -> pa.Table:
        x = _unit(matrix(table.column("vector")))
        centre = x.sum(axis=0)
        centre = centre / np.linalg.norm(centre) if np.linalg.norm(centre) > 1e-9 else x[0]
        radius = float(np.arccos(np.clip(x @ centre, -1, 1)).max())
        first = table.select(["component", "own", "label", "width"]).slice(0, 1)
        return first.append_column("radius", pa.array([radius])).append_column("centre", pa.array([centre.tolist()], pa.list_(pa.float64())))

    pieces = members.groupBy("component", "own").applyInArrow(middle, "component long, own long, label long, width int, radius double, centre array<double>")
    pieces = checkpointed(pieces)
    reach = float(np.arccos(np.clip(similarity, -1, 1))) + 1e-6

    def close(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        angle = np.arccos(np.clip(matrix(mine.column("centre")) @ matrix(theirs.column("centre")).T, -1, 1))
        radii = mine.column("radius").to_numpy()[:, None] + theirs.column("radius").to_numpy()[None, :]
        apart = mine.column("component").to_numpy()[:, None] != theirs.column("component").to_numpy()[None, :]
        i, j = np.nonzero((angle <= radii + reach) & apart)
        return pa.table([x.take(pa.array(k)).combine_chunks() for x, k in ((mine.column("component"), i), (mine.column("own"), i), (theirs.column("component"), j), (theirs.column("own"), j))], names=["c1", "o1", "c2", "o2"])

    near = _met_in_blocks(pieces, F.xxhash64("component", "own"), close, "c1 long, o1 long, c2 long, o2 long")
    # a block meets itself in both orders
    swap = (F.col("c1") > F.col("c2"))
    near = checkpointed(near.select(*(F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("c1", "c2"), ("o1", "o2"), ("c2", "c1"), ("o2", "o1")))).distinct())
    sides = [near.select("*", F.col(f"c{side}").alias("component"), F.col(f"o{side}").alias("own")) for side in (1, 2)]
    rows = sides[0].unionAll(sides[1]).join(members.select("id", "component", "own", "vector"), ["component", "own"])

    def linked(table: pa.Table) -> pa.Table:
        first = table.column("component").to_numpy() == table.column("c1").to_numpy()
        one, two = table.filter(pa.array(first)), table.filter(pa.array(~first))
        at = np.argwhere(_cosines(_unit(matrix(one.column("vector"))), _unit(matrix(two.column("vector"))), similarity) >= similarity)[:1]
        return pa.table({"a": one.column("id").take(pa.array(at[:, 0])), "b": two.column("id").take(pa.array(at[:, 1]))})

    return rows.groupBy("c1", "o1", "c2", "o2").applyInArrow(linked, "a long, b long")


def _met_in_blocks(rows: DataFrame, spread: Column, compared: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``compared`` over all pairs of blocks of rows of equal label and width, each pair once, a block also with itself.

    A row goes to as many tasks as its kind has blocks; no task holds more than two blocks, and the driver none.
    """
    sizes = rows.groupBy("label", "width").agg(F.ceil(F.count("*") / _BLOCK).alias("blocks"))
    sizes = broadcast_if_small(checkpointed(sizes), _BROADCAST_LABELS)
    placed = rows.join(sizes, ["label", "width"]).withColumn("block", F.pmod(spread, F.col("blocks")))
    dealt = placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select(*placed.columns, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block").to_numpy()
        first, second = (table.filter(pa.array(block == table.column(c)[0].as_py())) for c in ("i", "j"))
        return compared(first, second)

    return dealt.groupBy("label", "width", "i", "j").applyInArrow(run, schema)


def _every_link(nodes: DataFrame, component: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between components, one at least of any two that have some: all nodes of a kind compared, block against block."""
    placed = nodes.join(component, "id", "left").select("id", "label", "width", "vector", F.coalesce("component", "id").alias("component"))

    def linked(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        near = _cosines(_unit(matrix(mine.column("vector"))), _unit(matrix(theirs.column("vector"))), similarity) >= similarity
        near &= mine.column("component").to_numpy()[:, None] != theirs.column("component").to_numpy()[None, :]
        i, j = np.nonzero(near)
        return pa.table({"a": mine.column("id").take(pa.array(i)).combine_chunks(), "b": theirs.column("id").take(pa.array(j)).combine_chunks()})

    return _met_in_blocks(placed, F.xxhash64("id"), linked, "a long, b long")


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in tables of at most a block."""
    for batch in batches:
        for start in range(0, batch.num_rows, _BLOCK):
            yield pa.Table.from_batches([batch.slice(start, _BLOCK)])


def _inside(component: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(id, links): each component's nodes compared with all of it, block against block."""
    sizes = component.groupBy("component").agg(F.count("*").alias("n"))
    placed = component.join(sizes.select("component", F.ceil(F.col("n") / _BLOCK).cast("int").alias("blocks")), "component")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    placed = placed.join(nodes.select("id", "vector", "weight"), "id").withColumn("own", own)
    # a row meets its own block once and every other block from both sides
    rows = placed.select("id", "component", "vector", "weight", "own", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    # small components share a task
    key = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(4096))).otherwise(F.col("component"))
    key = F.struct(F.col("blocks") == 1, key, F.least("own", "other"), F.greatest("own", "other"))

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("component").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        of, ids = table.column("component").to_numpy(), table.column("id").to_numpy()
        own, other, weight = (table.column(c).to_numpy() for c in ("own", "other", "weight"))
        edges = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)]])
        links = np.zeros(len(ids), np.int64)
        for start, stop in zip(edges[:-1], edges[1:], strict=True):
            x = _unit(matrix(table.column("vector").slice(start, stop - start)))
            here = slice(start, stop)
            meet = (own[here][:, None] == other[here][None, :]) & (ids[here][:, None] != ids[here][None, :])
            links[here] = ((_cosines(x, x, similarity) >= similarity) & meet) @ weight[here]
        return pa.table({"id": pa.array(ids), "links": pa.array(links)})

    compared = rows.groupBy(key.alias("key")).applyInArrow(run, "id long, links long")
    return compared.groupBy("id").agg(F.sum("links").alias("links"))


def _by_kind(table: pa.Table) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, components, unit vectors) of the rows, by label and width."""
    label, width = (table.column(c).to_numpy() for c in ("label", "width"))
    out = {}
    for kind in sorted(set(zip(label.tolist(), width.tolist(), strict=True))):
        own = table.filter(pa.array((label == kind[0]) & (width == kind[1])))
        out[kind] = own.column("id").to_numpy(), own.column("component").to_numpy(), _unit(matrix(own.column("vector")))
    return out


def _audit(nodes: DataFrame, component: DataFrame, similarity: float, size: int) -> tuple[float, DataFrame]:
    """The recall among linked nodes that were seen (1 without any), and their missed links (a, b) between components.

    Sampled nodes are compared with all of their label, in one pass or two of bounded size, until enough of them have
    links and belong to small groups. The linked nodes count, not their links, and small groups apart from
    large ones: a node is missed if one of its links crosses components.
    """
    placed = checkpointed(nodes.join(component, "id", "left").select("id", "label", "width", "vector", F.coalesce("component", "id").alias("component")))
    total = placed.count()
    order = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(max(1, total)))
    linked, apart, crossing = [0, 0], [0, 0], component.select(F.col("id").alias("a"), F.col("component").alias("b")).limit(0)
    start, stop = 0, AUDITED
    while start < min(total, MOST_AUDITED):
        part = placed.where((order >= start) & (order < stop)).toArrow()
        asked = nodes.sparkSession.sparkContext.broadcast(_by_kind(part))

        def run(batches: Iterator[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
            for table in _sliced(batches):
                for kind, (own, of, x) in _by_kind(table).items():
                    if kind not in asked.value:
                        continue
                    ids, components, y = asked.value[kind]
                    near = _cosines(x, y, similarity) >= similarity
                    near &= own[:, None] != ids[None, :]
                    cross = near & (of[:, None] != components[None, :])
                    at = np.flatnonzero(near.any(axis=0))
                    others = [own[cross[:, j]].tolist() for j in at]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(near[:, at].sum(axis=0)), pa.array(others, pa.list_(pa.int64()))], names=["id", "links", "others"])

        seen = checkpointed(placed.mapInArrow(run, "id long, links long, others array<long>"))
        crossing = crossing.unionAll(seen.select(F.col("id").alias("a"), F.explode("others").alias("b")))
        each = seen.groupBy("id").agg(F.sum("links").alias("links"), F.sum(F.size("others")).alias("apart"))
        for large, n, missed in each.groupBy(F.col("links") > size).agg(F.count("*"), F.count(F.when(F.col("apart") > 0, 1))).collect():
            linked[large] += n
            apart[large] += missed
        asked.unpersist()
        if linked[0] >= AUDITED:
            break
        start, stop = stop, stop + _CHUNK
    if stop >= total:  # all links were seen, and all that were missed are in
        return 1.0, crossing
    return min(1 - m / n if n else 1.0 for n, m in zip(linked, apart, strict=True)), crossing


def _probes(nodes: DataFrame, similarity: float, seed: int) -> tuple[DataFrame, dict[int, int]]:
    """Twins of sampled nodes just above the threshold, of a bounded number, and whose twin each is."""
    low, high = nodes.agg(F.min("id"), F.max("id")).first()
    chosen = nodes.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(PROBES).select("id", "label", "width", "vector").toArrow()
    chosen = chosen.filter(pa.array(chosen.column("width").to_numpy() > 1))
    if not chosen.num_rows:
        return nodes.limit(0), {}
    # ids that no vector has
    first = low - chosen.num_rows if low > -(1 << 63) + PROBES else high + 1
    rows, twin_of, rnd = [], {}, np.random.default_rng(seed)
    cosine = similarity + 0.05 * (1 - similarity)
    for i, row in enumerate(chosen.to_pylist()):
        x = _unit(np.array([row["vector"]], float))[0]
        side = rnd.standard_normal(len(x))
        side -= (side @ x) * x
        y = cosine * x + np.sqrt(1 - cosine**2) * side / np.linalg.norm(side)
        twin_of[first + i] = row["id"]
        rows.append((first + i, row["label"], row["width"], y.tolist()))
    return nodes.sparkSession.createDataFrame(rows, "id long, label long, width int, vector array<double>"), twin_of


def _linked_probes(graph: DataFrame, twin_of: dict[int, int], similarity: float) -> float:
    """The share of probes that have any link, at least that of those whose links lead to their twin."""
    if not twin_of:
        return 1.0
    return graph.where((F.col("cosine") >= similarity) & F.col("a").isin(*twin_of)).select("a").distinct().count() / len(twin_of)


def _probed(graph: DataFrame, component: DataFrame, twin_of: dict[int, int], similarity: float) -> float:
    """The share of probes whose links lead to their twin's component."""
    if not twin_of:
        return 1.0
    spark = graph.sparkSession
    twins = F.broadcast(spark.createDataFrame(list(twin_of.items()), "a long, twin long"))
    links = graph.where(F.col("cosine") >= similarity).join(twins, "a")
    placed = links.join(component.select(F.col("id").alias("b"), F.col("component").alias("c_b")), "b", "left")
    placed = placed.join(component.select(F.col("id").alias("twin"), F.col("component").alias("c_twin")), "twin", "left")
    same = F.coalesce("c_b", "b") == F.coalesce("c_twin", "twin")
    return placed.where(same).select("a").distinct().count() / len(twin_of)


def _coded(rows: DataFrame) -> DataFrame:
    """``rows`` with labels of other types than whole numbers replaced by a number for each."""
    if isinstance(rows.schema["label"].dataType, T.IntegralType):
        return rows.withColumn("label", F.col("label").cast("long"))
    codes = checkpointed(rows.where("label IS NOT NULL").select("label").distinct().withColumn("code", F.monotonically_increasing_id()))
    return rows.join(broadcast_if_small(codes, _BROADCAST_LABELS), "label", "left").select("vec_id", "vector", F.col("code").alias("label"))


def embedding_near_duplicates(vectors: DataFrame, similarity: float = SIMILARITY, size: int = LIST, grown: int = GROWN, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept, recall), one row per row of ``vectors`` (vec_id, embedding, label).

    Vectors of equal labels are linked at a cosine of at least ``similarity``, in doubles.
    ``n_links`` counts the other vectors linked directly, ``component_id`` is the smallest vec_id that
    links reach; ``recall`` is what the last audit measured, 1 where all vectors were compared. Vectors that are null, empty or zero or hold null or non-finite components, and those
    without a label, link with nothing, nor do vectors of different lengths. A null vec_id has
    no links, a null component and is not kept; rows that repeat a vec_id are one vector,
    the first by its components. Labels of any type are compared as they are. A recall below the wanted one is logged as a warning. No rows give no rows; other columns are ignored.
    """
    rows = _coded(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").alias("label")))
    rows = rows.withColumn("own", F.col("vec_id"))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("vector") & F.exists("vector", lambda x: x != 0)
    valid = rows.where(good).groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row")).select("vec_id", "row.label", "row.vector")
    copies = checkpointed(valid.withColumn("node", F.md5(F.array_join(F.transform("vector", lambda x: x.cast("string")), ",").cast("binary"))))
    nodes = copies.groupBy("label", "node").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"), F.first("vector").alias("vector"))
    nodes = checkpointed(nodes.select("id", "label", "node", "weight", "vector", F.size("vector").alias("width")))
    probes, twin_of = _probes(nodes, similarity, 11)
    every = nodes.select("id", "label", "width", "vector").unionByName(probes.select("id", "label", "width", "vector"))
    real = ~F.col("a").isin(*twin_of) & ~F.col("b").isin(*twin_of) if twin_of else F.lit(True)
    graph = checkpointed(_closest(_started(every, ORDERS, BITS, NEAR, 1), size, grown, similarity))
    links_before, reached = 0, 0.0
    for turn in range(1, MOST_ROUNDS + 1):
        graph = checkpointed(_closest(graph.unionAll(_joined(graph, every, size, grown, turn, similarity)), size, grown, similarity))
        linked = graph.where((F.col("cosine") >= similarity) & real)
        links_before, n = linked.count(), links_before
        if turn < MOST_ROUNDS and (turn < ROUNDS or links_before - n > NEW * links_before):
            continue
        if turn < MOST_ROUNDS and _linked_probes(graph, twin_of, similarity) < recall:
            # no components can make up for probes without any link
            graph = checkpointed(_closest(graph.unionAll(_started(every, ORDERS, BITS, NEAR, 1 + turn)), size, grown, similarity))
            continue
        component = checkpointed(connected_components(linked.select("a", "b")))
        between = _between(graph.where(real), component, nodes, similarity, size)
        if between is not None:
            component = _merged(component, between)
        seen, crossing = _audit(nodes, component, similarity, size)
        component = _merged(component, crossing)
        reached = min(seen, _probed(graph, component, twin_of, similarity))
        _log.info("round %d: recall %.3f", turn, reached)
        if reached >= recall:
            break
        if turn < MOST_ROUNDS:
            graph = checkpointed(_closest(graph.unionAll(_started(every, ORDERS, BITS, NEAR, 1 + turn)), size, grown, similarity))
    if reached < LEAST_RECALL:
        component = _merged(component, _every_link(nodes, component, similarity))
        reached = 1.0
    elif reached < recall:
        _log.warning("the audit found a recall of %.3f, below %.3f", reached, recall)
    links = _inside(component, nodes, similarity)
    whole = nodes.select("label", "node", "id", "weight").join(component, "id", "left").join(links, "id", "left")
    whole = whole.select("label", "node", F.coalesce("component", "id").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    found = copies.select("vec_id", "label", "node").join(whole, ["label", "node"]).select(F.col("vec_id").alias("own"), "component", "links")
    out = rows.select("vec_id", "own").join(found, "own", "left")
    least = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), least.alias("component_id"), F.coalesce(F.col("vec_id") == least, F.lit(False)).alias("kept"), F.lit(float(reached)).alias("recall"))


ORACLE_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {SIMILARITY}),
r(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id), n AS (SELECT a, count(*) AS k FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.k, 0) AS BIGINT) AS n_links, m.c AS component_id, e.vec_id = m.c AS kept
FROM embeddings e JOIN m ON m.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
