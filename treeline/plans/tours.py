"""The depth-first order of trees of any size and depth, by a tour that is shortened inside blocks of rows before it is ranked.

A tour enters every node and leaves it: entering leads to the first child, or else to leaving; leaving leads to the next sibling, or else to leaving
the parent. A node's place is how many nodes are entered from there to the end. Rows are sorted by (document, ord, id) in ranges; a task
follows the tour inside a block of them to where it leaves the block. Only places where the tour comes into a block then take part in rounds of jumps: they are
few where nodes lie near their parents, as in lists that grow with time, and at most twice the nodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import group_starts
from ..session import Rounds

#: Rows in which a task shortens the tour at once.
BLOCK = 1 << 17
_KEY = ["doc_id", "id"]


def _siblings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (doc_id, up, ord, id) with the ``next`` sibling, whether they are ``eldest``, and whether they are the first or last of the range."""
    held, before = None, None
    for batch in chain((b for b in batches if b.num_rows), [None]):
        if held is not None:
            n, keys = len(held), [held["doc_id"], held["up"]]
            starts = group_starts(keys, before)
            edge = np.zeros(n, np.int64)
            edge[0] += before is None
            edge[-1] += 2 * (batch is None)
            last = tuple(c[-1].as_py() for c in keys)
            follows = batch is not None and not group_starts([batch["doc_id"], batch["up"]], last)[0]
            behind = pa.concat_arrays([held["id"].slice(1), batch["id"].slice(0, 1) if batch is not None else pa.nulls(1, pa.string())])
            ends = np.append(starts[1:], not follows)
            made = {"next": pc.if_else(pa.array(ends), pa.scalar(None, pa.string()), behind), "eldest": pa.array(starts), "edge": pa.array(edge)}
            yield pa.RecordBatch.from_pydict(dict(zip(held.schema.names, held.columns, strict=True)) | made)
            before = last
        held = batch


def _with_siblings(nodes: DataFrame) -> DataFrame:
    """(doc_id, id, up, ord, next, child): a node's next sibling and its first child by (ord, id); one parent may have most of the nodes."""
    spark = nodes.sparkSession
    ranged = nodes.repartitionByRange("doc_id", "up", "ord", "id").sortWithinPartitions("doc_id", "up", "ord", "id").withColumn("part", F.spark_partition_id())
    schema = T.StructType(list(ranged.schema.fields)).add("next", "string").add("eldest", "boolean").add("edge", "long")
    rows = Rounds(spark)(ranged.mapInArrow(_siblings, schema))
    # a sibling may be in the next range: two rows a range
    ends = rows.where("edge > 0").groupBy("part").agg(*(F.max(F.when(F.col("edge").bitwiseAND(bit) > 0, F.struct("doc_id", "up", "id"))).alias(name) for name, bit in (("head", 1), ("tail", 2))))
    along = Window.orderBy("part")
    met = ends.select("tail", F.lead("head").over(along).alias("head")).where("head.doc_id = tail.doc_id AND head.up <=> tail.up")
    met = Rounds(spark)(met.select("tail.doc_id", F.col("tail.id").alias("elder"), F.col("head.id").alias("younger")))
    rows = rows.join(met.select("doc_id", F.col("elder").alias("id"), F.col("younger").alias("__next")), _KEY, "left").join(met.select("doc_id", F.col("younger").alias("id"), F.lit(False).alias("__eldest")), _KEY, "left")
    rows = rows.select(*_KEY, "up", "ord", F.coalesce("next", "__next").alias("next"), F.coalesce("__eldest", "eldest").alias("eldest"))
    children = rows.where("eldest AND up IS NOT NULL").select("doc_id", F.col("up").alias("id"), F.col("id").alias("child"))
    return rows.drop("eldest").join(children, _KEY, "left").select(*_KEY, "up", "ord", "next", "child")


def _shortened(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Where the tour leaves the block after entering (``in``) and leaving (``out``) each row: the node, whether it is entered there, and how many are entered until then; null counts on cycles."""
    rows = table.combine_chunks()
    ids, ups, nexts, children = (rows[c].combine_chunks() for c in ("id", "up", "next", "child"))
    n = len(ids)
    docs = rows["doc_id"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    codes = pc.fill_null(pa.concat_arrays([ids, ups, nexts, children]).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64).reshape(4, n)
    keys = docs * (4 * n) + codes
    order = np.argsort(keys[0], kind="stable")
    ranked = keys[0][order]

    def rows_of(which: int) -> np.ndarray:
        at = np.minimum(np.searchsorted(ranked, keys[which]), n - 1)
        return np.where((ranked[at] == keys[which]) & (codes[which] >= 0), order[at], -1)

    above, beside, below = rows_of(1), rows_of(2), rows_of(3)
    enter = np.where(codes[3] >= 0, below, np.arange(n, 2 * n))
    leave = np.where(codes[2] >= 0, beside, np.where(above >= 0, above + n, -1))
    jump, last, count = np.concatenate([enter, leave]), np.arange(2 * n), np.repeat([1, 0], n)
    for _ in range((2 * n).bit_length() + 1):
        o = np.flatnonzero(jump >= 0)
        if not len(o):
            break
        j = jump[o]
        count[o], last[o], jump[o] = count[o] + count[j], last[j], jump[j]
    goal = pa.concat_arrays([children, pc.coalesce(nexts, ups)])
    entered = np.concatenate([np.ones(n, bool), codes[2] >= 0])
    made = {}
    for name, part in (("in", slice(0, n)), ("out", slice(n, 2 * n))):
        to, loops = last[part], jump[part] >= 0
        made |= {f"{name}_to": goal.take(pa.array(to, mask=loops)), f"{name}_enters": pa.array(entered[to]), f"{name}_count": pa.array(count[part], mask=loops)}
    yield from pa.Table.from_pydict({"doc_id": rows["doc_id"], "id": ids} | made).to_batches(max_chunksize=10_000)


def _by_blocks(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= block:
                yield from _shortened(pa.Table.from_batches(held))
                held, count = [], 0
        if count:
            yield from _shortened(pa.Table.from_batches(held))

    return run


def places(nodes: DataFrame, block: int | None = None) -> DataFrame:
    """(doc_id, id, back) of ``nodes`` (doc_id, id, parent_id, ord): how many nodes of its document come behind a node, itself counted, depth first by (ord, id).

    Keys are unique and not null. Nodes behind a missing parent and on or below cycles are left out; null and empty parents are none.
    """
    spark = nodes.sparkSession
    rows = _with_siblings(nodes.select(*_KEY, F.when(F.col("parent_id") != "", F.col("parent_id")).alias("up"), "ord"))
    ranged = rows.repartitionByRange("doc_id", "ord", "id").sortWithinPartitions("doc_id", "ord", "id").select(*_KEY, "up", "next", "child")
    schema = T.StructType(list(nodes.select(_KEY).schema.fields))
    for name in ("in", "out"):
        schema = schema.add(f"{name}_to", "string").add(f"{name}_enters", "boolean").add(f"{name}_count", "long")
    short = Rounds(spark)(ranged.mapInArrow(_by_blocks(BLOCK if block is None else block), schema))

    ways = [short.select("doc_id", F.col(f"{n}_to").alias("at"), F.col(f"{n}_enters").alias("enters")).where("at IS NOT NULL") for n in ("in", "out")]
    spots = Rounds(spark)(ways[0].unionByName(ways[1]).distinct())
    found = spots.join(short.withColumnRenamed("id", "at"), ["doc_id", "at"])
    turned = lambda c: F.when(F.col("enters"), F.col(f"in_{c}")).otherwise(F.col(f"out_{c}"))
    kept = Rounds(spark)
    # a spot at a missing node and one that leads round a cycle have no row or no count, so what leads there ends without a place
    state = kept(found.select("doc_id", "at", "enters", turned("to").alias("to"), turned("enters").alias("to_enters"), turned("count").alias("count")).where("count IS NOT NULL"))
    for _ in range(state.count().bit_length() + 1):
        if not state.where("to IS NOT NULL").take(1):
            break
        ahead = state.select("doc_id", F.col("at").alias("to"), F.col("enters").alias("to_enters"), F.col("to").alias("__to"), F.col("to_enters").alias("__enters"), F.col("count").alias("__count"))
        moved = state.where("to IS NOT NULL").join(ahead, ["doc_id", "to", "to_enters"])
        moved = moved.select("doc_id", "at", "enters", F.col("__to").alias("to"), F.col("__enters").alias("to_enters"), (F.col("count") + F.col("__count")).alias("count"))
        state = kept(state.where("to IS NULL").unionByName(moved))
    ends = state.where("to IS NULL").select("doc_id", F.col("at").alias("in_to"), F.col("enters").alias("in_enters"), "count")
    open_ = short.where("in_count IS NOT NULL").select(*_KEY, "in_to", "in_enters", "in_count").join(ends, ["doc_id", "in_to", "in_enters"], "left")
    back = F.when(F.col("in_to").isNull(), F.col("in_count")).otherwise(F.col("in_count") + F.col("count"))
    return open_.select(*_KEY, back.alias("back")).where("back IS NOT NULL")
