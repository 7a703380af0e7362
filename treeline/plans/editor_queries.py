"""Queries of single editor actions and of the stores behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import mutations as M
from ..operators import relational as R
from ..sources.tables import Tables
from . import editing as E
from . import layout as L
from .hierarchy import KEY, rooted
from .registry import given, query
from .stream_queries import _SESSIONS
from .tree_queries import _LAYOUT


@query("SELECT conv_id AS doc_id, coalesce(d.text, '') AS state FROM (SELECT DISTINCT conv_id * 2 AS conv_id FROM conversations) c LEFT JOIN documents d ON d.doc_id = c.conv_id")
def initial_state(t: Tables) -> DataFrame:
    """Opened documents with their snapshot, or empty."""
    opened = t.op_log().select((F.col("doc_id") * 2).alias("doc_id")).distinct()
    return M.loaded(opened, t.snapshots().select("doc_id", "state")).select("doc_id", "state")


@query("SELECT doc_id, 'manual' AS type, CASE WHEN doc_id % 2 = 0 THEN 'Manual save ' || doc_id ELSE 'mine' END AS label, octet_length(encode(text)) AS size FROM documents")
def manual_versions(t: Tables) -> DataFrame:
    states = t.snapshots().select("doc_id", S.base64_of(F.encode("state", "utf-8")).alias("encoded"))
    return M.manual_version(states, F.when(F.col("doc_id") % 2 == 1, "mine"))


@query("SELECT doc_id, text AS state FROM documents WHERE text <> ''")
def checked_snapshots(t: Tables) -> DataFrame:
    """States out of envelopes that must be valid."""
    made = t.snapshots().where("state <> ''").select("doc_id", S.envelope(F.col("state"), F.lit("me"), F.lit("auto"), F.lit("now")).alias("s"))
    return made.select("doc_id", S.checked_envelope(F.col("s")).alias("state"))


@query(given("nodes") + "SELECT doc_id, id, CASE WHEN ord % 4 = 1 THEN upper(label) ELSE label END AS label, ord % 4 = 1 AS bold FROM nodes UNION ALL SELECT 0, 'new-1', 'Free Node', false")
def upsert_nodes(t: Tables) -> DataFrame:
    """Every fourth node restyled, and one that is new."""
    nodes = t.nodes().select(*KEY, "label", F.lit(False).alias("bold"), "ord")
    changed = nodes.where("ord % 4 = 1").withColumns({"label": F.upper("label"), "bold": F.lit(True)})
    fresh = t.spark.range(1).select(F.lit(0).cast("long").alias("doc_id"), F.lit("new-1").alias("id"), F.lit("Free Node").alias("label"), F.lit(False).alias("bold"), F.lit(0).cast("long").alias("ord"))
    return M.upserted(nodes, changed.unionByName(fresh), KEY).drop("ord")


@query("SELECT n_nationkey AS id, CASE WHEN n_regionkey = 1 THEN 'dashed' ELSE 'solid' END AS style, n_nationkey::BIGINT AS ord FROM nation")
def splice_edges(t: Tables) -> DataFrame:
    """Edges replaced at their places in the list."""
    edges = t.base("nation").select(F.col("n_nationkey").alias("id"), F.lit("solid").alias("style"), F.col("n_nationkey").cast("long").alias("ord"), F.col("n_regionkey").alias("r"))
    changed = edges.where("r = 1").withColumn("style", F.lit("dashed")).drop("r")
    return M.spliced(edges.drop("r"), "id", changed)


@query(given("nodes") + "SELECT doc_id, id, label FROM nodes WHERE id = 'root-node'")
def clear_but_root(t: Tables) -> DataFrame:
    return M.deleted(t.nodes(), F.col("id") != "root-node").select(*KEY, "label")


@query("SELECT p_partkey AS id, CASE WHEN p_size * 10.0 < 250 THEN 'left' ELSE 'right' END AS side FROM part")
def side_by_position(t: Tables) -> DataFrame:
    return t.points().select("id", S.side_of(F.col("x"), F.lit(250.0)).alias("side"))


@query(_LAYOUT + """
SELECT p.doc_id, 's-' || p.id AS id, p.id AS parent_id, p.x + CASE WHEN p.side = 'left' THEN -250 ELSE 250 END AS x, p.y + 80 * coalesce(k.n, 0) AS y, coalesce(p.side, 'right') AS side,
  CASE WHEN p.side = 'left' THEN 'source-left' ELSE 'source-right' END AS source_handle, CASE WHEN p.side = 'left' THEN 'target-right' ELSE 'target-left' END AS target_handle
FROM placed p LEFT JOIN k ON k.doc_id = p.doc_id AND k.id = p.id""")
def apply_suggestion(t: Tables) -> DataFrame:
    """A suggested child below each placed node, 80 px a sibling, and its edge's handles."""
    counted = t.nodes().where(F.coalesce("auto_align", F.lit(True))).groupBy("doc_id", F.col("parent_id").alias("id")).agg(F.count("*").alias("n"))
    found = L.positions(L.tree(t.nodes())).join(counted, KEY, "left").withColumn("side", F.coalesce("side", F.lit("right")))
    x = F.col("x") + F.when(F.col("side") == "left", -L.STEP_X).otherwise(L.STEP_X)
    made = found.select("doc_id", F.concat(F.lit("s-"), "id").alias("new"), F.col("id").alias("parent_id"), x.alias("x"), (F.col("y") + 80 * F.coalesce("n", F.lit(0))).alias("y"), "side")
    return M.with_handles(made.withColumnRenamed("new", "id"), F.col("side"))


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 4 = 3 THEN NULL ELSE n_name || '|' || n_name || ' 2' END AS texts FROM nation")
def suggestions_parsed(t: Tables) -> DataFrame:
    """Fenced JSON answers parsed; an answer without a list gives null."""
    listed = F.concat(F.lit('```json\n{"suggestions":[{"text":"'), "n_name", F.lit('"},{"text":"'), "n_name", F.lit(' 2"}]}\n```'))
    text = F.when(F.col("n_nationkey") % 4 == 3, '{"text":"none"}').otherwise(listed)
    return t.base("nation").select(F.col("n_nationkey").alias("id"), F.array_join(S.suggestions(text), "|").alias("texts"))


@query(given("nodes", "paths") + "SELECT doc_id, id, CASE WHEN id LIKE 'p%' THEN id ELSE left(sha256(array_to_string(path, '/')), 16) END AS path_id FROM paths")
def tree_ids(t: Tables) -> DataFrame:
    """Ids where nodes have none, made from places, the same each time; here only order priorities have one."""
    given_id = F.when(F.startswith("id", F.lit("p")), F.col("id"))
    return rooted(t.nodes()).select(*KEY, F.coalesce(given_id, S.path_id(F.array_join("path", "/"))).alias("path_id"))


@query("SELECT doc_id, id, style, ord - CASE WHEN ord >= 4 THEN 2 ELSE 0 END AS ord FROM (SELECT n_regionkey::BIGINT AS doc_id, n_nationkey AS id, 'solid' AS style, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS ord FROM nation) WHERE ord NOT IN (2, 3)")
def edge_range_delete(t: Tables) -> DataFrame:
    """Two edges deleted at their position in every document's list; those behind move up."""
    place = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    edges = t.base("nation").select(F.col("n_regionkey").cast("long").alias("doc_id"), F.col("n_nationkey").alias("id"), F.lit("solid").alias("style"), (place - 1).cast("long").alias("ord"))
    return E.without_range(edges, 2, 2)


@query("SELECT n_nationkey AS id, CASE n_nationkey % 3 WHEN 0 THEN '10,5' WHEN 1 THEN '2,4' ELSE 'none' END AS dash FROM nation")
def edge_dashes(t: Tables) -> DataFrame:
    styles = F.element_at(F.array(*map(F.lit, ("dashed", "dotted", "solid"))), F.col("n_nationkey") % 3 + 1)
    return t.base("nation").select(F.col("n_nationkey").alias("id"), E.dashes(styles).alias("dash"))


@query(given("nodes") + "SELECT n.doc_id, id, parent_id, CASE WHEN n.doc_id % 2 = 0 THEN 'World' ELSE 'title ' || n.doc_id END AS label, ord, auto_align FROM nodes n WHERE id = 'root-node' AND n.doc_id % 3 = 0")
def generated_roots(t: Tables) -> DataFrame:
    """What is left of documents that a generated tree replaces: their roots, named by it or by the title."""
    documents = t.nodes().where("parent_id IS NULL AND doc_id % 3 = 0").select("doc_id")
    text = F.when(F.col("doc_id") % 2 == 0, '{"text":"World","children":[]}').otherwise('{"text":"","children":[]}')
    return E.generated_roots(t.nodes(), documents.withColumn("json", text), documents.withColumn("title", F.concat(F.lit("title "), F.col("doc_id").cast("string"))))


@query("""
SELECT r_regionkey AS id, bool_and(n_name IS NOT NULL AND n_name <> '') AND r_name <> '' AS valid, count(n_nationkey) AS children
FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name""")
def tree_valid(t: Tables) -> DataFrame:
    """Whether every node of a two-level tree has a text: a flat test and a logical and."""
    rows = t.base("region").join(t.base("nation"), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    has_text = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    return rows.groupBy(F.col("r_regionkey").alias("id")).agg(F.bool_and(has_text("n_name") & has_text("r_name")).alias("valid"), F.count("n_nationkey").alias("children"))


@query(given("users", "maps", "collab") + """
SELECT m.id AS map_id, 'owner' AS role, m.owner_id AS user_id FROM maps m UNION ALL SELECT c.map_id, c.role, c.user_id FROM collab c WHERE EXISTS (SELECT 1 FROM maps m WHERE m.id = c.map_id)""")
def all_members(t: Tables) -> DataFrame:
    """Owner and collaborators of each map as one list."""
    owners = t.maps().select(F.col("id").alias("map_id"), F.lit("owner").alias("role"), F.col("owner_id").alias("user_id"))
    shared = t.collaborators().join(t.maps().select(F.col("id").alias("map_id")), "map_id", "left_semi")
    return owners.unionByName(shared.select("map_id", "role", "user_id"))


@query(given("maps") + "SELECT id, owner_id = 7 AS may_delete, title = ydoc_id AS same, length(title) BETWEEN 1 AND 200 AS fits FROM maps")
def map_guards(t: Tables) -> DataFrame:
    """Ownership, null-safe equality and length tests."""
    return t.maps().select("id", (F.col("owner_id") == 7).alias("may_delete"), F.col("title").eqNullSafe(F.col("ydoc_id")).alias("same"), F.length("title").between(1, 200).alias("fits"))


@query(given("maps") + """SELECT id, '{"id":' || id || ',"title":"' || title || '","access":{"role":"owner"}}' AS body FROM maps""")
def map_bodies(t: Tables) -> DataFrame:
    """Maps as JSON response bodies with an added access object."""
    return t.maps().select("id", F.to_json(F.struct("id", "title", F.struct(F.lit("owner").alias("role")).alias("access"))).alias("body"))


@query("SELECT conv_id AS doc_id, string_agg(DISTINCT role, ',' ORDER BY role) AS keys, count(DISTINCT role) AS size, bool_or(role = 'user') AS has_user FROM conversations GROUP BY 1")
def document_maps(t: Tables) -> DataFrame:
    """A document's keys as a map value: keys, size, membership."""
    state = R.last_writes(t.op_log()).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("m"))
    return state.select("doc_id", F.array_join(F.array_sort(F.map_keys("m")), ",").alias("keys"), F.size("m").cast("long").alias("size"), F.map_contains_key("m", "user").alias("has_user"))


@query(_SESSIONS.format(key="user_id", gap="30 seconds"))
def doc_residency(t: Tables) -> DataFrame:
    """When documents are held in memory: from first use until 30 seconds after the last."""
    return R.quiet_groups(t.base("events"), "user_id", "ts", "30 seconds")
