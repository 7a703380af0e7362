"""What an editor's actions write: new nodes and edges, moves of whole subtrees, replaced states.

Every function takes and gives whole relations of many documents; nodes are (doc_id, id, parent_id,
side, ...), edges (doc_id, id, source, target, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import BRANCH_COLORS, handles, or_else, palette, side_of
from ..session import settled
from .hierarchy import KEY, ancestor_labels, subtrees
from .layout import ROOT_X, ROOT_Y, STEP_X, spots_below, spots_of_tops

# Fixed values that new nodes and edges show.
ROOT_ID, ROOT_LABEL, ROOT_COLOR, FREE_LABEL, FREE_COLOR = "root-node", "Main Topic", "#3b82f6", "Free Node", "#64748b"
EDGE_COLOR, EDGE_WIDTH, EDGE_STYLE, EDGE_CURVATURE = "#3b82f6", 2, "solid", 0.25
FONT_SIZES, DASHES = {0: "20px", 1: "16px"}, {"dashed": "10,5", "dotted": "2,4"}


def parent_edges(children: DataFrame, color: Column) -> DataFrame:
    """The edges to children (doc_id, id, parent_id, side) from their parents."""
    source, target = handles(F.col("side"))
    name = F.concat(F.lit("e-"), "parent_id", F.lit("-"), "id")
    return children.select("doc_id", name.alias("id"), F.col("parent_id").alias("source"), F.col("id").alias("target"), source.alias("source_handle"), target.alias("target_handle"), color.alias("color"), F.lit(True).alias("is_parent_child"))


def root_rows(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """The root of each of ``documents`` (doc_id, title) that has no nodes yet."""
    empty = documents.join(nodes.select("doc_id").distinct(), "doc_id", "left_anti")
    none = F.lit(None).cast("string")
    return empty.select("doc_id", F.lit(ROOT_ID).alias("id"), none.alias("parent_id"), or_else(F.col("title"), ROOT_LABEL).alias("label"), F.lit(float(ROOT_X)).alias("x"), F.lit(float(ROOT_Y)).alias("y"), F.lit(ROOT_COLOR).alias("color"), F.lit(0).cast("long").alias("level"), none.alias("side"), F.lit(True).alias("auto_align"))


def child_rows(parents: Column, child: Column, tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a new node ``child`` below each of ``parents``, those rows of a ``layout.tree``, of which all roots and branches are needed.

    A child goes to the emptier side of a root and else to its parent's, one level down, in the branch's colour. A placed node hangs on aligned
    nodes alone, so its level and branch are those among all nodes, and the one walk of the tree is enough.
    """
    found, deep = spots_of_tops(tree).where(parents), tree.where(parents & (F.col("level") > 1))
    if deep.take(1):
        found = found.unionByName(spots_below(deep, tree).select(found.columns))
    color = palette(F.col("branch"), BRANCH_COLORS).alias("color")
    level, aligned = (F.col("level") + 1).alias("level"), F.lit(True).alias("auto_align")
    rows = found.select("doc_id", child.alias("id"), F.col("id").alias("parent_id"), F.lit("").alias("label"), "x", "y", level, color, "side", aligned)
    return rows, parent_edges(rows, F.col("color"))


def free_rows(asked: DataFrame, roots: DataFrame) -> DataFrame:
    """Free nodes (doc_id, id, x, y) at their points, on the side of their document's root (doc_id, x) that they lie on."""
    found = asked.join(roots.select("doc_id", F.col("x").alias("root_x")), "doc_id", "left")
    side = side_of(F.col("x"), F.coalesce("root_x", "x"))
    return found.select(*KEY, F.lit(None).cast("string").alias("parent_id"), F.lit(FREE_LABEL).alias("label"), "x", "y", F.lit(1).cast("long").alias("level"), F.lit(FREE_COLOR).alias("color"), side.alias("side"), F.lit(False).alias("auto_align"), F.lit(True).alias("is_free"))


def custom_edges(asked: DataFrame) -> DataFrame:
    """Edges drawn by hand from (doc_id, id, source, source_anchor, target, target_anchor); none from a node to itself."""
    made = asked.where(F.col("source") != F.col("target"))
    fixed = {"color": F.lit(EDGE_COLOR), "width": F.lit(EDGE_WIDTH).cast("long"), "style": F.lit(EDGE_STYLE), "is_parent_child": F.lit(False), "curvature": F.lit(EDGE_CURVATURE)}
    return made.select(*KEY, "source", "target", F.concat(F.lit("source-"), "source_anchor").alias("source_handle"), F.concat(F.lit("target-"), "target_anchor").alias("target_handle"), *(v.alias(k) for k, v in fixed.items()))


def reparented(nodes: DataFrame, edges: DataFrame, paths: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after the moves (doc_id, id, new_parent) that are possible, at most one a document.

    ``nodes`` (doc_id, id, parent_id, side, color, auto_align), ``edges`` (doc_id, id, source, target, source_handle,
    target_handle, color, is_parent_child). The whole subtree takes the side of the new parent, or the emptier one of a root, and so do
    the edges into its nodes; the moved node takes the new parent's colour, is aligned again, and its old edge gives
    way to a new one.
    """
    # one move a document: all that it needs to know meets it by document
    moves = moves.select(*KEY, "new_parent")
    told = nodes.select("doc_id", F.col("id").alias("node"), "parent_id", "side", "color", "auto_align").join(moves, "doc_id")
    is_goal, is_child = F.col("node") == F.col("new_parent"), F.col("parent_id") == F.col("new_parent")
    told = told.where((F.col("node") == F.col("id")) | is_goal | F.coalesce(is_child, F.lit(False)))
    counted = [F.count_if(is_child & F.coalesce("auto_align", F.lit(True)) & (F.col("side") == side)).alias(side) for side in ("left", "right")]
    facts = told.groupBy(*KEY, "new_parent").agg(F.bool_or(F.col("node") == F.col("id")).alias("there"), F.max(F.when(is_goal, F.struct("parent_id", "side", "color"))).alias("goal"), *counted)
    emptier = F.when(F.col("left") <= F.col("right"), "left").otherwise("right")
    side = F.when(F.coalesce("goal.parent_id", F.lit("")) == "", emptier).otherwise(F.coalesce("goal.side", F.lit("right")))
    below = paths.select("doc_id", F.col("id").alias("node"), "path").join(moves, "doc_id").where(F.array_contains("path", F.col("id"))).drop("path")
    below = settled(below)
    loops = below.where(is_goal).select(*KEY, "new_parent")
    fine = facts.where("there AND goal IS NOT NULL AND id <> new_parent").select(*KEY, "new_parent", side.alias("new_side"), F.col("goal.color").alias("new_color"))
    fine = settled(fine.join(loops, [*KEY, "new_parent"], "left_anti"))
    inside = settled(below.join(fine, [*KEY, "new_parent"]).select("doc_id", F.col("node").alias("id"), "new_side"))
    moved = nodes.join(fine.select(*KEY, "new_parent", "new_color"), KEY, "left").join(inside, KEY, "left")
    hit = F.col("new_parent").isNotNull()
    changed = {
        "parent_id": F.coalesce("new_parent", "parent_id"),
        "side": F.coalesce("new_side", "side"),
        "color": F.when(hit, F.col("new_color")).otherwise(F.col("color")),
        "auto_align": F.when(hit, True).otherwise(F.col("auto_align")),
    }
    moved = moved.withColumns(changed).select(nodes.columns)
    into = inside.select("doc_id", F.col("id").alias("target"), "new_side")
    gone = fine.select("doc_id", F.col("id").alias("target"), F.lit(True).alias("gone"))
    left = edges.join(gone, ["doc_id", "target"], "left").where(~(F.coalesce("gone", F.lit(False)) & F.col("is_parent_child")))
    left = left.join(into, ["doc_id", "target"], "left")
    turned, (source, target) = F.col("is_parent_child") & F.col("new_side").isNotNull(), handles(F.col("new_side"))
    left = left.withColumns({"source_handle": F.when(turned, source).otherwise(F.col("source_handle")), "target_handle": F.when(turned, target).otherwise(F.col("target_handle"))})
    new = fine.select("doc_id", "id", F.col("new_parent").alias("parent_id"), F.col("new_side").alias("side"), "new_color")
    return moved, left.select(edges.columns).unionByName(parent_edges(new, F.col("new_color")).select(edges.columns))


def turned_subtrees(nodes: DataFrame, edges: DataFrame, paths: DataFrame, tops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after the subtrees of ``tops`` (doc_id, id, new_side) change sides, with the edges into their nodes."""
    inside = settled(subtrees(paths, tops).join(tops.select("doc_id", F.col("id").alias("top"), "new_side"), ["doc_id", "top"]).groupBy(KEY).agg(F.max("new_side").alias("new_side")))
    turned = nodes.join(inside, KEY, "left").withColumn("side", F.coalesce("new_side", "side")).select(nodes.columns)
    found = edges.join(inside.select("doc_id", F.col("id").alias("target"), "new_side"), ["doc_id", "target"], "left")
    hit, (source, target) = F.col("is_parent_child") & F.col("new_side").isNotNull(), handles(F.col("new_side"))
    return turned, found.withColumns({"source_handle": F.when(hit, source).otherwise(F.col("source_handle")), "target_handle": F.when(hit, target).otherwise(F.col("target_handle"))}).select(edges.columns)


def without_range(rows: DataFrame, start: int, count: int, key: str = "doc_id") -> DataFrame:
    """Ordered rows (key, ord) after ``count`` of them go from a position on; those behind move up."""
    stop = start + count
    kept = rows.where(~F.col("ord").between(start, stop - 1))
    return kept.withColumn("ord", F.when(F.col("ord") >= stop, F.col("ord") - count).otherwise(F.col("ord")))


def font_size(level: Column, own: Column) -> Column:
    """A node's own size, or that of its level."""
    sized = F.when(level == 0, FONT_SIZES[0]).when(level == 1, FONT_SIZES[1]).otherwise("14px")
    return or_else(own, sized)


def dashes(style: Column) -> Column:
    """The dash pattern of an edge style; "none" for a solid one."""
    return F.when(style == "dashed", DASHES["dashed"]).when(style == "dotted", DASHES["dotted"]).otherwise("none")


def generated_nodes(trees: DataFrame) -> DataFrame:
    """(doc_id, id, parent_id, label, level, side, nth) of all nodes below the roots of generated trees (doc_id, json), of any depth.

    Half of the first level goes left, half right, with all below it; ``nth`` counts from 0 among the children of one parent, at the first level
    of one side. A node without an id is named by its texts from the first level on, the second of equal siblings with "#1" behind it and so on, so that making the rows again gives the same ids, one a
    node. Text that is no JSON has no nodes. The walk goes a level at a time over all trees.
    """
    below = lambda c: F.try_variant_get(c, "$.children", "array<variant>")
    tree = trees.select("doc_id", below(F.try_parse_json("json")).alias("children"))
    rows = tree.select("doc_id", F.lit(ROOT_ID).alias("parent_id"), F.ceil(F.size("children") / 2).alias("half"), F.posexplode("children").alias("i", "c"))
    rows = rows.withColumn("side", F.when(F.col("i") < F.col("half"), "left").otherwise("right"))
    nth, level, out = F.when(F.col("side") == "left", F.col("i")).otherwise(F.col("i") - F.col("half")), 1, None
    while True:
        text, given = (F.try_variant_get("c", f"$.{name}", "string") for name in ("text", "id"))
        named = rows.withColumns({"label": text, "given": given, "nth": nth.cast("long")})
        equal = Window.partitionBy("doc_id", "parent_id", F.coalesce("label", F.lit("")), F.col("given").isNull()).orderBy("i")
        again = F.row_number().over(equal) - 1
        escaped = F.coalesce("label", F.lit(""))
        for sign, written in (("~", "~0"), ("/", "~1"), ("#", "~2")):
            escaped = F.replace(escaped, F.lit(sign), F.lit(written))
        prefix = F.lit("ai-") if level == 1 else F.concat("parent_id", F.lit("/"))
        made = F.concat(prefix, escaped, F.when(again > 0, F.concat(F.lit("#"), again.cast("string"))).otherwise(""))
        found = settled(named.select("doc_id", F.coalesce("given", made).alias("id"), "parent_id", "label", F.lit(level).cast("long").alias("level"), "side", "nth", "c"))
        out = found.drop("c") if out is None else out.unionByName(found.drop("c"))
        rows = found.select("doc_id", F.col("id").alias("parent_id"), "side", F.posexplode(below(F.col("c"))).alias("i", "c"))
        if not rows.take(1):
            return out
        nth, level = F.col("i"), level + 1


def flattened(trees: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of generated trees (doc_id, json) of any depth, at their places.

    The root of the document stays and is named by the answer (see ``generated_roots``).
    """
    x = ROOT_X + F.when(F.col("side") == "left", -STEP_X * F.col("level")).otherwise(STEP_X * F.col("level"))
    rows = generated_nodes(trees).select("doc_id", "id", "parent_id", "label", "level", "side", x.cast("double").alias("x"), (100.0 * F.col("level") + 80 * F.col("nth")).alias("y"))
    return rows, parent_edges(rows, F.lit(ROOT_COLOR))


def generated_valid(trees: DataFrame) -> DataFrame:
    """(doc_id, valid, nodes): whether every node of a generated tree (doc_id, json), root included, has a text; how many there are."""
    named = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    roots = trees.select("doc_id", F.try_variant_get(F.try_parse_json("json"), "$.text", "string").alias("text")).select("doc_id", named("text").alias("valid"))
    every = roots.unionByName(generated_nodes(trees).select("doc_id", named("label").alias("valid")))
    return every.groupBy("doc_id").agg(F.bool_and("valid").alias("valid"), F.count("*").alias("nodes"))


def generated_roots(nodes: DataFrame, trees: DataFrame, titles: DataFrame) -> DataFrame:
    """The nodes that stay when generated trees (doc_id, json) replace a document's: its root, named by the tree or the title."""
    named = trees.select("doc_id", F.get_json_object("json", "$.text").alias("named")).join(titles, "doc_id", "left")
    roots = nodes.where(F.col("id") == ROOT_ID).join(named, "doc_id")
    return roots.withColumn("label", or_else(F.col("named"), F.col("title"))).select(nodes.columns)


def contexts(asked: DataFrame, nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(doc_id, id, current, parents, siblings) for a prompt about each of ``asked`` (doc_id, id, parent_id, label).

    Siblings are in order, without the node itself. Only the asked nodes' parents are listed, one list a parent.
    """
    labels = ancestor_labels(nodes, paths)
    parents = asked.select("doc_id", "parent_id").distinct()
    listed = nodes.join(parents, ["doc_id", "parent_id"], "left_semi").groupBy("doc_id", "parent_id").agg(F.array_sort(F.collect_list(F.struct("ord", "id", "label"))).alias("all"))
    found = asked.select(*KEY, "parent_id", F.col("label").alias("current")).join(labels, KEY).join(listed, ["doc_id", "parent_id"])
    others = F.transform(F.filter("all", lambda x: x["id"] != F.col("id")), lambda x: x["label"])
    return found.select(*KEY, "current", or_else(F.col("labels"), "root").alias("parents"), F.array_join(others, ", ").alias("siblings"))
