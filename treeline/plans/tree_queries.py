"""Queries over node trees and their edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.scalars import BRANCH_COLORS, palette
from ..operators import mutations as M
from ..operators import relational as R
from ..session import settled
from ..sources.tables import Tables, branches_to_move, tree_edges
from . import editing as E
from . import hierarchy as H
from . import intervals as I
from . import layout as L
from . import moves as V
from .hierarchy import KEY, rooted
from .registry import given, query

_HASH = "CAST(list_sum(list_transform(string_split({x}, ''), lambda c: ascii(c))) AS BIGINT)"
# The palette that results show.
_BRANCH = "['#3b82f6', '#ef4444', '#10b981', '#f59e0b', '#8b5cf6', '#ec4899', '#14b8a6', '#f97316']"
_TOP_OF = "CASE WHEN len(path) > 1 THEN path[2] ELSE path[1] END"
_COLOR = f"{_BRANCH}[{_HASH.format(x=_TOP_OF)} % 8 + 1]"
#: The node of document 0 that single-node queries drag or turn.
TOP = "r1"


@query(given("nodes", "paths") + "SELECT doc_id, id, len(path) - 1 AS level FROM paths")
def node_level(t: Tables) -> DataFrame:
    return I.climbed(t.nodes()).select(*KEY, "level")


@query(given("nodes", "paths") + """
SELECT p.doc_id, p.id, coalesce(string_agg(n.label, ' > ' ORDER BY u.i), '') AS labels FROM paths p
LEFT JOIN (SELECT doc_id, id, unnest(path) AS at, unnest(range(len(path))) AS i FROM paths) u ON u.doc_id = p.doc_id AND u.id = p.id AND u.at <> p.id
LEFT JOIN nodes n ON n.doc_id = u.doc_id AND n.id = u.at GROUP BY p.doc_id, p.id""")
def ancestor_path(t: Tables) -> DataFrame:
    return H.ancestor_labels(t.nodes(), rooted(t.nodes()))


@query(given("nodes") + "SELECT doc_id, coalesce(parent_id, '') AS parent_id, id, count(*) OVER (PARTITION BY doc_id, parent_id) - 1 AS others, lag(label) OVER w AS before, lead(label) OVER w AS after FROM nodes WINDOW w AS (PARTITION BY doc_id, parent_id ORDER BY ord, id)")
def siblings(t: Tables) -> DataFrame:
    """How many siblings a node has, itself not counted, and its neighbours among them; never all in one row."""
    among = Window.partitionBy("doc_id", "parent_id")
    ordered = among.orderBy("ord", "id")
    return t.nodes().select("doc_id", F.coalesce("parent_id", F.lit("")).alias("parent_id"), "id", (F.count("*").over(among) - 1).alias("others"), F.lag("label").over(ordered).alias("before"), F.lead("label").over(ordered).alias("after"))


@query(given("nodes", "paths") + f"SELECT doc_id, id, {_TOP_OF} AS branch_id, {_COLOR} AS color FROM paths")
def branch_color(t: Tables) -> DataFrame:
    found = I.climbed(t.nodes())
    return found.select(*KEY, F.col("branch").alias("branch_id"), palette(F.col("branch"), BRANCH_COLORS).alias("color"))


@query(given("nodes", "paths") + "SELECT doc_id, unnest(path) AS ancestor, id AS descendant, len(path) - 1 - unnest(range(len(path))) AS distance FROM paths")
def descendants_closure(t: Tables) -> DataFrame:
    return H.closure(rooted(t.nodes()))


@query(given("nodes", "paths", "moves") + "SELECT n.doc_id, n.id, n.parent_id, n.label FROM nodes n JOIN paths p ON p.doc_id = n.doc_id AND p.id = n.id LEFT JOIN moves m ON m.doc_id = n.doc_id WHERE NOT coalesce(list_contains(p.path, m.id), false)")
def cascade_delete(t: Tables) -> DataFrame:
    """The first branch of every document with several deleted, with all below it."""
    nodes = settled(t.nodes())
    return I.without_subtrees(nodes, branches_to_move(nodes)).select(*KEY, "parent_id", "label")


@query(given("nodes", "paths", "edges", "moves") + """
, gone AS (SELECT p.doc_id, p.id FROM paths p JOIN moves m ON m.doc_id = p.doc_id AND list_contains(p.path, m.id))
SELECT e.doc_id, e.id, e.source, e.target FROM edges e LEFT JOIN gone a ON a.doc_id = e.doc_id AND a.id = e.source LEFT JOIN gone b ON b.doc_id = e.doc_id AND b.id = e.target WHERE is_parent_child AND (a.id IS NOT NULL OR b.id IS NOT NULL)""")
def dangling_edges(t: Tables) -> DataFrame:
    """Edges that a cascading delete of nodes leaves behind."""
    nodes = settled(t.nodes())
    return H.dangling_edges(tree_edges(nodes), I.without_subtrees(nodes, branches_to_move(nodes)))


@query(given("nodes", "paths", "moves") + "SELECT p.doc_id, p.id AS new_parent, list_contains(p.path, m.id) AS cycle FROM paths p JOIN moves m ON m.doc_id = p.doc_id")
def cycle_check(t: Tables) -> DataFrame:
    """Whether the first branch could not be moved below each other node of its document."""
    nodes = settled(t.nodes())
    moves = nodes.select("doc_id", F.col("id").alias("new_parent")).join(branches_to_move(nodes).select(KEY), "doc_id")
    return I.makes_cycle(moves, settled(I.numbered(nodes))).select("doc_id", "new_parent", "cycle")


@query(given("nodes", "paths") + """
, spots AS (SELECT doc_id, id, unnest(path) AS node, unnest(range(len(path))) AS i FROM paths), o AS (SELECT doc_id, id, lpad(CAST(ord AS VARCHAR), 20, '0') || '/' || id || chr(1) AS place FROM nodes),
sorted AS (SELECT s.doc_id, s.id, string_agg(o.place, '' ORDER BY s.i) AS way FROM spots s JOIN o ON o.doc_id = s.doc_id AND o.id = s.node GROUP BY s.doc_id, s.id),
numbers AS (SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY way) - 1 AS nth FROM sorted),
sizes AS (SELECT doc_id, node AS id, count(*) AS size FROM spots GROUP BY doc_id, node)
SELECT n.doc_id, n.id, p.path[1] AS top, n.nth AS first, n.nth + s.size - 1 AS last FROM numbers n JOIN sizes s ON s.doc_id = n.doc_id AND s.id = n.id JOIN paths p ON p.doc_id = n.doc_id AND p.id = n.id""")
def tree_intervals(t: Tables) -> DataFrame:
    """Every node's number in its document, depth first, and the last one below it."""
    return I.numbered(t.nodes()).select(*KEY, "top", "first", "last")


#: A log of moves, and its replay, one move of each document after the other.
_REPLAY = given("nodes", "log") + """
, steps AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS n FROM log),
start AS (SELECT doc_id, map_from_entries(list((id, coalesce(parent_id, '')))) AS m FROM nodes WHERE doc_id > 0 AND id NOT LIKE 'o%' GROUP BY doc_id),
way AS (SELECT doc_id, 0::BIGINT AS n, 0::BIGINT AS seq, '' AS id, '' AS new_parent, false AS accepted, m FROM start UNION ALL
  SELECT doc_id, n, seq, id, new_parent, ok, CASE WHEN ok THEN map_concat(m, MAP {id: new_parent}) ELSE m END FROM
  (SELECT w.doc_id, s.n, s.seq, s.id, s.new_parent, w.m, NOT list_contains(string_split(list_reduce(list_prepend(s.new_parent, list_transform(range(24), lambda i: '')), lambda a, i: a || '>' || coalesce(w.m[string_split(a, '>')[-1]], '')), '>'), s.id) AS ok
   FROM way w JOIN steps s ON s.doc_id = w.doc_id AND s.n = w.n + 1))
"""


@query(_REPLAY + "SELECT doc_id, seq, id, new_parent, accepted FROM way WHERE n > 0")
def moves_judged(t: Tables) -> DataFrame:
    """Which moves of every document's log are made, and which would close a cycle at their moment."""
    return V.judged(t.nodes(), t.moves_log())


_MOVED = _REPLAY + """
, final AS (SELECT doc_id, id, arg_max(new_parent, seq) AS to_parent FROM way WHERE accepted GROUP BY 1, 2),
moved AS (SELECT b.doc_id, b.id, coalesce(f.to_parent, b.parent_id) AS parent_id, b.label, b.ord, b.auto_align OR f.id IS NOT NULL AS auto_align FROM nodes b LEFT JOIN final f ON f.doc_id = b.doc_id AND f.id = b.id)
"""


@query(_MOVED + "SELECT doc_id, id, parent_id FROM moved")
def moved_trees(t: Tables) -> DataFrame:
    """The trees after all moves of the log."""
    return V.after(t.nodes(), t.moves_log())


#: Nodes with the sides and colours that they show, edges with handles; and the side of the moved branch.
_SHOWN = given("nodes", "paths", "aligned", "branches", "moves") + f"""
, shown AS (SELECT n.doc_id, n.id, n.parent_id, b.side, {_COLOR.replace('path', 'p.path')} AS color, n.auto_align, p.path FROM nodes n JOIN paths p ON p.doc_id = n.doc_id AND p.id = n.id
  LEFT JOIN aligned a ON a.doc_id = n.doc_id AND a.id = n.id LEFT JOIN branches b ON b.doc_id = a.doc_id AND b.branch = a.path[2]),
goal AS (SELECT m.doc_id, m.id AS moved, m.new_parent, coalesce(s.side, 'right') AS new_side, s.color AS new_color FROM moves m JOIN shown s ON s.doc_id = m.doc_id AND s.id = m.new_parent),
inside AS (SELECT s.doc_id, s.id, g.new_side FROM shown s JOIN goal g ON g.doc_id = s.doc_id AND list_contains(s.path, g.moved))
"""


def _paths(t: Tables) -> DataFrame:
    return rooted(t.nodes().withColumnRenamed("parent_id", "above").withColumn("parent_id", F.col("above")), keep=("above", "auto_align"))


def _shown(t: Tables, paths: DataFrame) -> DataFrame:
    """The nodes of ``paths`` with their sides and colours."""
    sides, colored = L.sides(L.tree(t.nodes())), H.branch_colors(paths, ("above", "auto_align"))
    return settled(colored.join(sides, KEY, "left").select(*KEY, F.col("above").alias("parent_id"), "side", "color", "auto_align"))


def _tree_edges(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    return t.edges().where("is_parent_child").select(*KEY, "source", "target", none.alias("source_handle"), none.alias("target_handle"), "color", "is_parent_child")


@query(_SHOWN + """
SELECT s.doc_id, s.id, CASE WHEN g.moved IS NULL THEN s.parent_id ELSE g.new_parent END AS parent_id, coalesce(i.new_side, s.side) AS side,
  CASE WHEN g.moved IS NULL THEN s.color ELSE g.new_color END AS color, CASE WHEN g.moved IS NULL THEN s.auto_align ELSE true END AS auto_align
FROM shown s LEFT JOIN goal g ON g.doc_id = s.doc_id AND g.moved = s.id LEFT JOIN inside i ON i.doc_id = s.doc_id AND i.id = s.id""")
def reparent(t: Tables) -> DataFrame:
    """The first branch of every document moved below its last one: parent, side of the subtree, colour."""
    paths = _paths(t)
    return E.reparented(_shown(t, paths), _tree_edges(t), paths, t.branches_to_move())[0]


_TURNED = "CASE WHEN new_side IS NULL THEN NULL WHEN new_side = 'left' THEN '{}-left' ELSE '{}-right' END"


@query(_SHOWN + f"""
SELECT e.doc_id, e.id, e.source, e.target, {_TURNED.format('source', 'source').replace('new_side', 'i.new_side')} AS source_handle, CASE WHEN i.new_side IS NULL THEN NULL WHEN i.new_side = 'left' THEN 'target-right' ELSE 'target-left' END AS target_handle, e.color
FROM (SELECT doc_id, 'e-' || parent_id || '-' || id AS id, parent_id AS source, id AS target, '#3b82f6' AS color FROM nodes WHERE parent_id IS NOT NULL) e
LEFT JOIN inside i ON i.doc_id = e.doc_id AND i.id = e.target LEFT JOIN goal g ON g.doc_id = e.doc_id AND g.moved = e.target WHERE g.moved IS NULL
UNION ALL SELECT doc_id, 'e-' || new_parent || '-' || moved, new_parent, moved, {_TURNED.format('source', 'source')}, CASE WHEN new_side = 'left' THEN 'target-right' ELSE 'target-left' END, new_color FROM goal""")
def reparent_edges(t: Tables) -> DataFrame:
    """The edges after the same moves: the old ones out, new ones in, handles on the new side."""
    paths = _paths(t)
    return E.reparented(_shown(t, paths), _tree_edges(t), paths, t.branches_to_move())[1].drop("is_parent_child")


@query(_SHOWN + f"""
SELECT e.doc_id, e.id, {_TURNED.format('source', 'source').replace('new_side', 'turned')} AS source_handle, CASE WHEN turned IS NULL THEN NULL WHEN turned = 'left' THEN 'target-right' ELSE 'target-left' END AS target_handle
FROM (SELECT n.doc_id, 'e-' || n.parent_id || '-' || n.id AS id, CASE WHEN i.id IS NOT NULL THEN 'right' END AS turned FROM nodes n LEFT JOIN inside i ON i.doc_id = n.doc_id AND i.id = n.id WHERE n.parent_id IS NOT NULL) e""")
def subtree_side(t: Tables) -> DataFrame:
    """A side for a whole subtree of every document: the handles of the edges into its nodes."""
    paths = rooted(t.nodes())
    tops = t.branches_to_move().select(*KEY, F.lit("right").alias("new_side"))
    nodes = t.nodes().select(*KEY, "parent_id", F.lit(None).cast("string").alias("side"))
    return E.turned_subtrees(nodes, _tree_edges(t), paths, tops)[1].select(*KEY, "source_handle", "target_handle")


@query(given("nodes", "aligned", "heights") + "SELECT doc_id, id, leaves, height FROM heights")
def subtree_height(t: Tables) -> DataFrame:
    return L.heights(L.tree(t.nodes()))


@query(given("nodes", "aligned", "branches") + "SELECT a.doc_id, a.id, b.side FROM aligned a JOIN branches b ON b.doc_id = a.doc_id AND b.branch = a.path[2]")
def side_assignment(t: Tables) -> DataFrame:
    return L.sides(L.tree(t.nodes()))


_PLACED = """
, s AS (SELECT a.doc_id, a.id, a.parent_id, a.ord, a.path, b.side, CAST(h.height AS DOUBLE) AS height FROM aligned a JOIN heights h ON h.doc_id = a.doc_id AND h.id = a.id LEFT JOIN branches b ON b.doc_id = a.doc_id AND b.branch = a.path[2]),
o AS (SELECT *, -(sum(height + 80) OVER (PARTITION BY doc_id, parent_id, side) - 80) / 2 + height / 2
  + coalesce(sum(height + 80) OVER (PARTITION BY doc_id, parent_id, side ORDER BY ord, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS step FROM s),
y AS (SELECT doc_id, id, CAST(400 + 600 * (row_number() OVER (PARTITION BY doc_id ORDER BY ord, id) - 1) AS DOUBLE) AS y FROM s WHERE parent_id IS NULL UNION ALL SELECT o.doc_id, o.id, y.y + o.step FROM o JOIN y ON o.doc_id = y.doc_id AND o.parent_id = y.id),
placed AS (SELECT o.doc_id, o.id, o.side, CAST(600 + CASE WHEN o.side = 'left' THEN -250 ELSE 250 END * (len(o.path) - 1) AS DOUBLE) AS x, y.y FROM o JOIN y ON y.doc_id = o.doc_id AND y.id = o.id),
k AS (SELECT doc_id, parent_id AS id, count(*) AS n FROM nodes WHERE auto_align GROUP BY 1, 2)
"""
_LAYOUT = given("nodes", "aligned", "heights", "branches", "suggested") + _PLACED
_LAYOUT_PATHS = given("nodes", "paths", "aligned", "heights", "branches", "suggested") + _PLACED


@query(_LAYOUT + "SELECT doc_id, id, side, x, y FROM placed")
def balanced_layout(t: Tables) -> DataFrame:
    return L.positions(L.tree(t.nodes()))


@query(_LAYOUT + "SELECT n.doc_id, n.id, coalesce(p.x, 0) AS x, coalesce(p.y, 0) AS y FROM nodes n LEFT JOIN placed p ON p.doc_id = n.doc_id AND p.id = n.id")
def apply_layout(t: Tables) -> DataFrame:
    """Computed places written back to aligned nodes; the others stay at the origin."""
    nodes = t.nodes().withColumns({"x": F.lit(0.0), "y": F.lit(0.0)})
    return L.applied(nodes, L.positions(L.tree(nodes))).select(*KEY, "x", "y")


@query(given("nodes", "aligned", "branches", "suggested") + "SELECT doc_id, id, side FROM suggested")
def suggested_side(t: Tables) -> DataFrame:
    """The side a new child would go to: the emptier one below a root, else the parent's."""
    return L.suggested_sides(t.nodes(), L.sides(L.tree(t.nodes())))


@query(_LAYOUT + """
SELECT p.doc_id, p.id, g.side, p.x + CASE WHEN g.side = 'left' THEN -250 ELSE 250 END AS x, p.y + CASE WHEN p.id LIKE 's%' THEN 80 ELSE 40 END * coalesce(k.n, 0) AS y
FROM placed p JOIN suggested g ON g.doc_id = p.doc_id AND g.id = p.id LEFT JOIN k ON k.doc_id = p.doc_id AND k.id = p.id""")
def new_child_position(t: Tables) -> DataFrame:
    """Where a new child of each placed node would appear; order statuses count as free nodes."""
    nodes, places = t.nodes().withColumn("is_free", F.startswith("id", F.lit("s"))), L.positions(L.tree(t.nodes()))
    return L.child_places(nodes, places, L.suggested_sides(nodes, places))


@query(_LAYOUT_PATHS + f"""
SELECT p.doc_id, 'x-' || p.id AS id, p.id AS parent_id, '' AS label, p.x + CASE WHEN g.side = 'left' THEN -250 ELSE 250 END AS x, p.y + 40 * coalesce(k.n, 0) AS y, len(paths.path) AS level,
  {_COLOR.replace('path', 'paths.path')} AS color, g.side, true AS auto_align FROM placed p JOIN paths USING (doc_id, id) JOIN suggested g ON g.doc_id = p.doc_id AND g.id = p.id LEFT JOIN k ON k.doc_id = p.doc_id AND k.id = p.id
WHERE paths.parent_id = 'root-node' OR paths.parent_id IS NULL""")
def added_nodes(t: Tables) -> DataFrame:
    """A new child below the root and every branch: level, side, colour and place."""
    return _added(t)[0]


def _added(t: Tables) -> tuple[DataFrame, DataFrame]:
    # of the walked nodes these alone are written
    tree = L.tree(t.nodes(), lambda level, parent: (level < 2) | (parent == "root-node"))
    return E.child_rows(F.col("parent_id").isNull() | (F.col("parent_id") == "root-node"), F.concat(F.lit("x-"), "id"), tree)


@query(_LAYOUT_PATHS + f"""
SELECT p.doc_id, 'e-' || p.id || '-x-' || p.id AS id, p.id AS source, 'x-' || p.id AS target, CASE WHEN g.side = 'left' THEN 'source-left' ELSE 'source-right' END AS source_handle,
  CASE WHEN g.side = 'left' THEN 'target-right' ELSE 'target-left' END AS target_handle, {_COLOR.replace('path', 'paths.path')} AS color, true AS is_parent_child
FROM placed p JOIN paths USING (doc_id, id) JOIN suggested g ON g.doc_id = p.doc_id AND g.id = p.id WHERE paths.parent_id = 'root-node' OR paths.parent_id IS NULL""")
def added_edges(t: Tables) -> DataFrame:
    """The edges to those children."""
    return _added(t)[1]


@query("SELECT p_partkey AS doc_id, 'free-1' AS id, NULL::VARCHAR AS parent_id, 'Free Node' AS label, p_size * 10.0::DOUBLE AS x, p_retailprice / 10 AS y, 1::BIGINT AS level, '#64748b' AS color, CASE WHEN p_size * 10.0 < 250 THEN 'left' ELSE 'right' END AS side, false AS auto_align, true AS is_free FROM part")
def added_free_nodes(t: Tables) -> DataFrame:
    """A free node in each of many documents, at a point, on the side of the root where it lies."""
    asked = t.points().select(F.col("id").alias("doc_id"), F.lit("free-1").alias("id"), "x", "y")
    return E.free_rows(asked, asked.select("doc_id", F.lit(250.0).alias("x")))


@query("""
WITH p AS (SELECT p_partkey AS id, p_size * 10.0::DOUBLE AS x, p_retailprice / 10 AS y FROM part)
SELECT a.id, min(b.id) AS target FROM p a JOIN p b ON a.id <> b.id AND abs(a.x - b.x) < 50 AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < 50 WHERE b.id % 10 <> 0 GROUP BY a.id""")
def drop_target(t: Tables) -> DataFrame:
    """The first other node near enough; every tenth counts as a root, which nothing is dropped on."""
    return R.drop_targets(t.points(), roots=t.points().where("id % 10 = 0"))


@query(given("nodes", "edges") + "SELECT doc_id, node_id, count(*) AS n, count(*) FILTER (is_parent_child) AS tree_edges FROM (SELECT doc_id, source AS node_id, is_parent_child FROM edges UNION ALL SELECT doc_id, target, is_parent_child FROM edges WHERE target <> source) GROUP BY doc_id, node_id")
def edge_incidence(t: Tables) -> DataFrame:
    ends = F.explode(F.array_distinct(F.array("source", "target"))).alias("node_id")
    # ends repeat little, so counting them before the shuffle would only hold a map of all ends of a file's part in memory
    return t.edges().select("doc_id", ends, "is_parent_child").repartition("doc_id", "node_id").groupBy("doc_id", "node_id").agg(F.count("*").alias("n"), F.count_if("is_parent_child").alias("tree_edges"))


@query(given("nodes", "edges") + f"SELECT doc_id, id, source, target FROM edges WHERE doc_id <> 0 OR source <> '{TOP}' AND target <> '{TOP}'")
def edges_while_dragging(t: Tables) -> DataFrame:
    """Edges at a dragged node are hidden."""
    hidden = t.edges().where((F.col("doc_id") == 0) & ((F.col("source") == TOP) | (F.col("target") == TOP))).select(KEY)
    return t.edges().select(*KEY, "source", "target").join(hidden, KEY, "left_anti")


@query(given("nodes", "edges") + f"""
SELECT e.doc_id, e.id, CASE WHEN is_parent_child AND doc_id = 0 AND source = '{TOP}' THEN 'source-left' END AS source_handle, CASE WHEN is_parent_child AND doc_id = 0 AND source = '{TOP}' THEN 'target-right' END AS target_handle
FROM edges e""")
def edge_handle_update(t: Tables) -> DataFrame:
    """Handles of the edges out of a node that was dropped left of the root."""
    edges = t.edges().withColumns({"source_handle": F.lit(None).cast("string"), "target_handle": F.lit(None).cast("string")})
    source, target = S.handles(F.lit("left"))
    there = t.nodes().select("doc_id", F.col("id").alias("target"), F.lit(True).alias("there"))
    joined = edges.join(there, ["doc_id", "target"], "left")
    hit = F.col("is_parent_child") & (F.col("doc_id") == 0) & (F.col("source") == TOP) & F.coalesce("there", F.lit(False))
    return M.updated(joined, hit, source_handle=source, target_handle=target).select(*KEY, "source_handle", "target_handle")


@query(given("nodes", "edges") + """
SELECT doc_id, id, coalesce(color, '#3b82f6') AS color, CASE WHEN is_parent_child THEN 2 ELSE 4 END::BIGINT AS width, 'solid' AS style, is_parent_child, 0.25::DOUBLE AS curvature FROM edges WHERE is_parent_child OR source <> 'c1'""")
def custom_edge_update(t: Tables) -> DataFrame:
    """Custom edges drawn wider and one node's deleted, tree edges untouched; shown with defaults."""
    edges = t.edges().withColumn("width", F.lit(0).cast("long"))
    edges = M.updated(edges, ~F.col("is_parent_child"), width=F.lit(4).cast("long"))
    edges = M.deleted(edges, ~F.col("is_parent_child") & (F.col("source") == "c1"))
    return edges.select(*KEY, S.or_else(F.col("color"), "#3b82f6").alias("color"), S.or_else(F.col("width"), F.lit(2).cast("long")).alias("width"), F.lit("solid").alias("style"), "is_parent_child", F.lit(0.25).alias("curvature"))


@query("SELECT doc_id, 'custom-' || doc_id AS id, 'r1' AS source, 'n2' AS target, 'source-top' AS source_handle, CASE WHEN doc_id % 2 = 0 THEN 'target-left' ELSE 'target-bottom' END AS target_handle, '#3b82f6' AS color, 2::BIGINT AS width, 'solid' AS style, false AS is_parent_child, 0.25::DOUBLE AS curvature FROM documents WHERE doc_id % 3 <> 0")
def custom_edge_create(t: Tables) -> DataFrame:
    """Edges drawn between two nodes of many documents; every third would lead back to its own node."""
    target = F.when(F.col("doc_id") % 3 == 0, "r1").otherwise("n2")
    anchor = F.when(F.col("doc_id") % 2 == 0, "left").otherwise("bottom")
    asked = t.base("documents").select("doc_id", F.concat(F.lit("custom-"), F.col("doc_id").cast("string")).alias("id"), F.lit("r1").alias("source"), F.lit("top").alias("source_anchor"), target.alias("target"), anchor.alias("target_anchor"))
    return E.custom_edges(asked)


@query(given("nodes", "paths") + f"""
SELECT p.doc_id, p.id, 'node' AS type, len(p.path) - 1 AS level, len(p.path) = 1 AS is_root, n.auto_align AND len(p.path) > 1 AS follows, NOT n.auto_align AS draggable,
  {_COLOR} AS color, CASE len(p.path) WHEN 1 THEN '20px' WHEN 2 THEN '16px' ELSE '14px' END AS font_size FROM paths p JOIN nodes n ON n.doc_id = p.doc_id AND n.id = p.id""")
def node_render(t: Tables) -> DataFrame:
    """Nodes as they are drawn, with derived level, colour and size of type."""
    paths = rooted(t.nodes())
    found = t.nodes().join(H.levels(paths), KEY).join(H.branch_colors(paths).select(*KEY, "color"), KEY)
    aligned = F.coalesce("auto_align", F.lit(True))
    size = E.font_size(F.col("level"), F.lit(None).cast("string"))
    return found.select(*KEY, F.lit("node").alias("type"), "level", (F.col("level") == 0).alias("is_root"), (aligned & (F.col("level") > 0)).alias("follows"), (~aligned).alias("draggable"), "color", size.alias("font_size"))


@query(given("nodes") + "SELECT doc_id, id, CASE WHEN id = 'root-node' OR ord % 10 <> 0 THEN auto_align ELSE NOT auto_align END AS auto_align FROM nodes")
def toggle_auto_align(t: Tables) -> DataFrame:
    """Every tenth node's alignment turned, never the root's."""
    turned = (F.col("id") != "root-node") & (F.col("ord") % 10 == 0)
    return M.updated(t.nodes(), turned, auto_align=~F.coalesce("auto_align", F.lit(True))).select(*KEY, "auto_align")


@query("SELECT o_custkey + 1 + CASE WHEN o_custkey % 2 = 0 THEN 1000000 ELSE 0 END AS doc_id, 'root-node' AS id, NULL::VARCHAR AS parent_id, CASE WHEN o_custkey % 4 = 0 THEN 'Main Topic' ELSE max(o_orderpriority) END AS label, 600::DOUBLE AS x, 400::DOUBLE AS y, '#3b82f6' AS color, 0::BIGINT AS level, NULL::VARCHAR AS side, true AS auto_align FROM orders WHERE o_custkey % 2 = 0 GROUP BY o_custkey")
def root_initialised(t: Tables) -> DataFrame:
    """The roots of documents that have no nodes yet: here those of customers with an even key."""
    title = F.when(F.col("o_custkey") % 4 == 0, "").otherwise(F.max("o_orderpriority"))
    asked = t.base("orders").groupBy("o_custkey").agg(title.alias("title"))
    asked = asked.select((F.col("o_custkey") + 1 + F.when(F.col("o_custkey") % 2 == 0, 1_000_000).otherwise(0)).alias("doc_id"), "title")
    return E.root_rows(asked, t.nodes())


_FLAT = """
WITH g AS (SELECT r_regionkey, r_name, row_number() OVER (ORDER BY r_regionkey) - 1 AS i, count(*) OVER () AS n FROM region),
t AS (SELECT r_regionkey, r_name, i, CASE WHEN i < ceil(n / 2.0) THEN 'left' ELSE 'right' END AS side, ceil(n / 2.0)::BIGINT AS half FROM g),
k AS (SELECT n_name, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation),
d AS (SELECT DISTINCT p_size::BIGINT AS doc_id FROM part),
f AS (SELECT 'ai-' || r_name AS id, 'root-node' AS parent_id, r_name AS label, 1::BIGINT AS level, side, (CASE WHEN side = 'left' THEN 350 ELSE 850 END)::DOUBLE AS x, (100 + 80 * CASE WHEN side = 'left' THEN i ELSE i - half END)::DOUBLE AS y FROM t
UNION ALL SELECT 'ai-' || t.r_name || '/' || k.n_name, 'ai-' || t.r_name, k.n_name, 2, t.side, CASE WHEN t.side = 'left' THEN 100 ELSE 1100 END, 200 + 80 * k.i FROM k JOIN t ON t.r_regionkey = k.n_regionkey)
"""


def _generated(t: Tables) -> DataFrame:
    """Generated trees (doc_id, tree), the same of regions and nations for many documents, as JSON."""
    nations = t.base("nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", F.col("n_name").alias("text")))).alias("c"))
    below = t.base("region").join(nations, "r_regionkey", "left")
    regions = below.select("r_regionkey", F.col("r_name").alias("text"), F.transform("c", lambda x: F.struct(x["text"].alias("text"))).alias("children"))
    tree = regions.groupBy(F.lit("World").alias("text")).agg(F.array_sort(F.collect_list(F.struct("r_regionkey", "text", "children"))).alias("c"))
    text = F.to_json(F.struct("text", F.transform("c", lambda x: F.struct(x["text"].alias("text"), x["children"].alias("children"))).alias("children")))
    documents = t.base("part").select(F.col("p_size").cast("long").alias("doc_id"), F.lit("World").alias("text")).distinct()
    return documents.join(tree.select("text", text.alias("json")), "text").select("doc_id", "json")


@query(_FLAT + "SELECT doc_id, f.* FROM d CROSS JOIN f")
def tree_flatten(t: Tables) -> DataFrame:
    """Generated trees made node rows, each in its document: half of the branches left, half right."""
    return E.flattened(_generated(t))[0]


@query(_FLAT + "SELECT doc_id, 'e-' || parent_id || '-' || id AS id, parent_id AS source, id AS target, CASE WHEN side = 'left' THEN 'source-left' ELSE 'source-right' END AS source_handle, CASE WHEN side = 'left' THEN 'target-right' ELSE 'target-left' END AS target_handle, '#3b82f6' AS color, true AS is_parent_child FROM d CROSS JOIN f")
def tree_flatten_edges(t: Tables) -> DataFrame:
    """The edges of those trees."""
    return E.flattened(_generated(t))[1]


#: Trees of documents, of unlike depth, with equal labels side by side.
_DEEP = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, doc_id % 5 AS n FROM documents),
f AS (SELECT doc_id, u.id AS id, 'root-node' AS parent_id, u.label AS label, 1::BIGINT AS level, u.side AS side, u.nth AS nth FROM
  (SELECT doc_id, unnest([{'id': 'ai-Pros', 'label': 'Pros', 'side': 'left', 'nth': 0}, {'id': 'ai-Pros#1', 'label': 'Pros', 'side': 'left', 'nth': 1}, {'id': 'ai-' || source, 'label': source, 'side': 'right', 'nth': 0}]) AS u FROM d)
UNION ALL SELECT doc_id, 'ai-Pros' || repeat('/deep', k), 'ai-Pros' || repeat('/deep', k - 1), 'deep', k + 1, 'left', 0 FROM (SELECT doc_id, unnest(range(1, n + 1)) AS k FROM d)
UNION ALL SELECT doc_id, 'ai-Pros' || repeat('/deep', n) || '/' || lang, 'ai-Pros' || repeat('/deep', n), lang, n + 2, 'left', 0 FROM d)
"""


def _deep(t: Tables) -> DataFrame:
    n = (F.col("doc_id") % 5).cast("int")
    text = lambda c: F.coalesce(c, F.lit(""))
    chain = F.concat(F.repeat(F.lit('{"text":"deep","children":['), n), F.lit('{"text":"'), text("lang"), F.lit('"}'), F.repeat(F.lit("]}"), n))
    json = F.concat(F.lit('{"text":"World","children":[{"text":"Pros","children":['), chain, F.lit(']},{"text":"Pros"},{"text":"'), text("source"), F.lit('"}]}'))
    return t.base("documents").select("doc_id", json.alias("json"))


@query(_DEEP + "SELECT doc_id, id, parent_id, label, level, side, (600 + CASE WHEN side = 'left' THEN -250 ELSE 250 END * level)::DOUBLE AS x, (100 * level + 80 * nth)::DOUBLE AS y FROM f")
def tree_flatten_deep(t: Tables) -> DataFrame:
    """Generated trees of any depth made node rows, equal labels apart."""
    return E.flattened(_deep(t))[0]


@query(_DEEP + "SELECT doc_id, bool_and(label <> '') AS valid, count(*) + 1 AS nodes FROM f GROUP BY doc_id")
def tree_valid_deep(t: Tables) -> DataFrame:
    """Whether every node of a generated tree of any depth has a text."""
    return E.generated_valid(_deep(t))


@query("SELECT doc_id, id, CASE WHEN nth <= ceil(n / 2.0) THEN 'left' ELSE 'right' END AS side FROM (SELECT n_regionkey::BIGINT AS doc_id, n_nationkey AS id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS nth, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation)")
def tree_split_halves(t: Tables) -> DataFrame:
    """The first half of each document's branches left, the rest right."""
    own = Window.partitionBy("n_regionkey")
    nth, n = F.row_number().over(own.orderBy("n_nationkey")), F.count("*").over(own)
    return t.base("nation").select(F.col("n_regionkey").cast("long").alias("doc_id"), F.col("n_nationkey").alias("id"), F.when(nth <= F.ceil(n / 2), "left").otherwise("right").alias("side"))


@query(given("nodes", "paths") + """
, a AS (SELECT p.doc_id, p.id, string_agg(n.label, ' > ' ORDER BY u.i) AS labels FROM paths p JOIN (SELECT doc_id, id, unnest(path) AS at, unnest(range(len(path))) AS i FROM paths) u ON u.doc_id = p.doc_id AND u.id = p.id AND u.at <> p.id
  JOIN nodes n ON n.doc_id = u.doc_id AND n.id = u.at GROUP BY p.doc_id, p.id),
s AS (SELECT doc_id, parent_id, list(id ORDER BY ord, id) AS ids, list(label ORDER BY ord, id) AS labels FROM nodes WHERE doc_id > 0 AND parent_id LIKE 'p%' GROUP BY 1, 2)
SELECT n.doc_id, n.id, n.label AS current, coalesce(a.labels, 'root') AS parents,
  array_to_string([s.labels[i] for i in range(1, len(s.labels) + 1) if s.ids[i] <> n.id], ', ') AS siblings
FROM nodes n JOIN a ON a.doc_id = n.doc_id AND a.id = n.id JOIN s ON s.doc_id = n.doc_id AND s.parent_id = n.parent_id""")
def suggestion_context(t: Tables) -> DataFrame:
    """What a suggestion for each order status would be asked with: its path and its siblings' labels, its own left out."""
    nodes = t.nodes()
    asked = nodes.where("doc_id > 0 AND startswith(parent_id, 'p')")
    return E.contexts(asked, nodes, rooted(nodes))
