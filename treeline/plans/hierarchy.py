"""Trees of many documents, given as (doc_id, id, parent_id): paths, depths, closures.

Ids are unique inside a document only, so every function is keyed by document and id. Documents that lie whole in a block of
sorted rows are walked there (``blocks``), the others by pointer doubling: each round
joins every open path with the path of the node it hangs on, so trees of depth d take
about log2 d joins, whatever their number and size; recursion limits on rows or levels do not apply.
``paths`` is the result of ``rooted``; functions that need it take it, so that several share one walk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import BRANCH_COLORS, palette
from ..session import settled
from . import blocks

KEY = ["doc_id", "id"]


def rooted(nodes: DataFrame, rounds: int = 40, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, id, path, dangling) of every node of ``nodes`` (doc_id, id, parent_id), with the columns ``keep`` of it.

    ``path`` holds the ids from the topmost resolvable ancestor down to the node; ``dangling`` is
    true where that ancestor names a parent that does not exist. Nodes on or below a cycle
    have a null path. Null and empty parents are none.
    """
    known, rest = blocks.resolved(nodes.select(*KEY, "parent_id", *keep), paths=True, keep=keep)
    known = known.select(*KEY, "path", "dangling", *keep)
    if rest is None:
        return known
    found = _doubled(rest, rounds)
    return known.unionByName(found.join(rest.select(*KEY, *keep), KEY) if keep else found)


def _doubled(nodes: DataFrame, rounds: int) -> DataFrame:
    """``rooted`` by pointer doubling alone."""
    parent = F.when(F.col("parent_id") != "", F.col("parent_id"))
    state = settled(nodes.select(*KEY, parent.alias("up"), F.array("id").alias("path"), F.lit(False).alias("dangling")))
    for _ in range(rounds):
        is_open = F.col("up").isNotNull() & ~F.col("dangling")
        # an open path that holds its own next node goes round a cycle
        if not state.where(is_open & ~F.array_contains("path", F.col("up"))).take(1):
            break
        above = state.select("doc_id", F.col("id").alias("up_id"), F.col("up").alias("up_up"), F.col("path").alias("up_path"), F.col("dangling").alias("up_dangling"))
        moved = state.where(is_open).join(above.withColumnRenamed("up_id", "up"), ["doc_id", "up"], "left")
        lost, turns = F.col("up_path").isNull(), F.array_contains("path", F.col("up"))
        moved = moved.select(
            *KEY,
            F.when(lost | turns, F.col("up")).otherwise(F.col("up_up")).alias("up"),
            F.when(lost | turns, F.col("path")).otherwise(F.concat("up_path", "path")).alias("path"),
            F.when(turns, F.lit(False)).when(lost, F.lit(True)).otherwise(F.col("up_dangling")).alias("dangling"),
        )
        state = settled(state.where(~is_open).unionByName(moved))
    whole = F.col("up").isNull() | F.col("dangling")
    return state.select(*KEY, F.when(whole, F.col("path")).alias("path"), "dangling")


def levels(paths: DataFrame) -> DataFrame:
    """(doc_id, id, level): edges to the root; a missing parent counts as a level."""
    return paths.select(*KEY, (F.size("path") - 1 + F.col("dangling").cast("int")).cast("long").alias("level"))


def branch_of(path) -> F.Column:
    """The node below the root on a path, or the only node."""
    return F.when(F.size(path) > 1, F.element_at(path, 2)).otherwise(F.element_at(path, 1))


def branch_colors(paths: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, id, branch_id, color) by the branch a node is on, and the columns ``keep``; below a missing parent, its topmost node."""
    branch = F.when(F.col("dangling"), F.element_at("path", 1)).otherwise(branch_of(F.col("path")))
    found = paths.select(*KEY, branch.alias("branch_id"), *keep)
    return found.select(*KEY, "branch_id", palette(F.col("branch_id"), BRANCH_COLORS).alias("color"), *keep)


def closure(paths: DataFrame) -> DataFrame:
    """(doc_id, ancestor, descendant, distance) for every node and all nodes of its path, itself at 0."""
    known = paths.where("path IS NOT NULL")
    return known.select("doc_id", F.col("id").alias("descendant"), F.size("path").alias("n"), F.posexplode("path").alias("at", "ancestor")).select(
        "doc_id", "ancestor", "descendant", (F.col("n") - 1 - F.col("at")).cast("long").alias("distance")
    )


def subtrees(paths: DataFrame, tops: DataFrame) -> DataFrame:
    """(doc_id, id, top): every node at or below one of ``tops`` (doc_id, id), once for each."""
    on = paths.where("path IS NOT NULL").select(*KEY, F.explode("path").alias("top"))
    return on.join(tops.select("doc_id", F.col("id").alias("top")).distinct(), ["doc_id", "top"], "left_semi").select(*KEY, "top")


def ancestor_labels(nodes: DataFrame, paths: DataFrame, separator: str = " > ") -> DataFrame:
    """(doc_id, id, labels): the labels of a node's ancestors, root first, itself left out."""
    above = closure(paths).where("distance > 0").join(nodes.select("doc_id", F.col("id").alias("ancestor"), "label"), ["doc_id", "ancestor"])
    ordered = above.groupBy("doc_id", F.col("descendant").alias("id")).agg(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "label"))).alias("found"))
    joined = ordered.select(*KEY, F.array_join(F.col("found.label"), separator).alias("labels"))
    return nodes.select(KEY).join(joined, KEY, "left").select(*KEY, F.coalesce("labels", F.lit("")).alias("labels"))


def without_subtrees(nodes: DataFrame, paths: DataFrame, tops: DataFrame) -> DataFrame:
    """The nodes that stay when ``tops`` (doc_id, id) are deleted with all below them."""
    return nodes.join(subtrees(paths, tops).select(KEY).distinct(), KEY, "left_anti")


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Parent-child edges that have lost an end."""
    ids = settled(nodes.select(KEY))
    found = edges.where("is_parent_child")
    for end in ("source", "target"):
        found = found.join(ids.select("doc_id", F.col("id").alias(end), F.lit(True).alias(f"has_{end}")), ["doc_id", end], "left")
    return found.where("has_source IS NULL OR has_target IS NULL").select(*KEY, "source", "target")


def makes_cycle(moves: DataFrame, paths: DataFrame) -> DataFrame:
    """``moves`` (doc_id, id, new_parent) with ``cycle``: whether the node is its new parent or above it."""
    found = moves.join(paths.select("doc_id", F.col("id").alias("new_parent"), F.col("path").alias("__path")), ["doc_id", "new_parent"], "left")
    return found.withColumn("cycle", F.coalesce(F.array_contains(F.col("__path"), F.col("id")), F.lit(False)) | (F.col("id") == F.col("new_parent"))).drop("__path")


def possible(moves: DataFrame, nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """The moves (doc_id, id, new_parent) that make no cycle and whose nodes exist."""
    fine = makes_cycle(moves, paths).where("NOT cycle").join(nodes.select(KEY), KEY, "left_semi")
    return fine.join(nodes.select("doc_id", F.col("id").alias("new_parent")), ["doc_id", "new_parent"], "left_semi").select(*KEY, "new_parent")
