"""Registering queries together with the SQL they must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
#: The relations of ``sources.tables`` in SQL.
RELATIONS = {
    "users": "SELECT c_custkey AS id, c_name AS name, lower(trim(c_name)) || '@' || lower(c_mktsegment) || '.example' AS email FROM customer",
    "maps": "SELECT o_orderkey AS id, o_custkey AS owner_id, o_orderpriority AS title, o_orderdate AS updated_at, 'y' || o_orderkey AS ydoc_id FROM orders",
    "collab": "SELECT l_orderkey AS map_id, l_suppkey AS user_id, CASE WHEN bool_or(l_linestatus = 'O') THEN 'editor' ELSE 'viewer' END AS role FROM lineitem GROUP BY ALL",
    "versions": f"SELECT event_id AS id, user_id AS map_id, {_K} AS user_id, ts AS created_at, CASE event_type WHEN 'view' THEN 'auto' WHEN 'error' THEN 'auto' WHEN 'click' THEN 'manual' WHEN 'signup' THEN 'restore' WHEN 'purchase' THEN 'delete-backup' END AS type, CAST(floor(value * 10000) AS BIGINT) AS size FROM events",
    "notes": f"SELECT event_id AS id, user_id AS to_user, {_K} AS from_user, event_id % 150 AS map_id, ts AS created_at, {_K} % 3 = 0 AS read, CASE {_K} % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'accepted' ELSE 'rejected' END AS status FROM events",
    "places": "SELECT user_id, map_id, min(place) AS place FROM (SELECT owner_id AS user_id, id AS map_id, 0 AS place FROM maps UNION ALL SELECT c.user_id, c.map_id, CASE role WHEN 'editor' THEN 1 ELSE 2 END FROM collab c JOIN maps m ON m.id = c.map_id) GROUP BY ALL",
    "nodes": """SELECT 0::BIGINT AS doc_id, 'root-node' AS id, CAST(NULL AS VARCHAR) AS parent_id, 'Central Idea' AS label, 0::BIGINT AS ord, true AS auto_align
      UNION ALL SELECT 0, 'r' || r_regionkey, 'root-node', r_name, r_regionkey, true FROM region UNION ALL SELECT 0, 'n' || n_nationkey, 'r' || n_regionkey, n_name, n_nationkey, true FROM nation
      UNION ALL SELECT 0, 'c' || c_custkey, 'n' || c_nationkey, c_name, c_custkey, c_custkey % 17 <> 0 FROM customer UNION ALL SELECT c_custkey + 1, 'root-node', NULL, c_name, 0, true FROM customer
      UNION ALL SELECT DISTINCT o_custkey + 1, 'p' || o_orderpriority, 'root-node', o_orderpriority, 0, true FROM orders
      UNION ALL SELECT DISTINCT o_custkey + 1, 's' || o_orderpriority || '/' || o_orderstatus, 'p' || o_orderpriority, o_orderstatus, 0, true FROM orders
      UNION ALL SELECT o_custkey + 1, 'o' || o_orderkey, 's' || o_orderpriority || '/' || o_orderstatus, 'order ' || o_orderkey, o_orderkey, o_orderkey % 11 <> 0 FROM orders""",
    "edges": "SELECT doc_id, 'e-' || parent_id || '-' || id AS id, parent_id AS source, id AS target, '#3b82f6' AS color, true AS is_parent_child FROM nodes WHERE parent_id IS NOT NULL UNION ALL SELECT DISTINCT 0, 'custom-c' || o_custkey || '-s' || l_suppkey, 'c' || o_custkey, 's' || l_suppkey, CAST(NULL AS VARCHAR), false FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "moves": "SELECT doc_id, arg_min(id, (ord, id)) AS id, arg_max(id, (ord, id)) AS new_parent FROM nodes WHERE parent_id = 'root-node' GROUP BY doc_id HAVING arg_min(id, (ord, id)) <> arg_max(id, (ord, id))",
    "log": """SELECT doc_id, seq, CASE WHEN seq % 7 < 4 THEN g ELSE s END AS id, CASE WHEN seq % 7 = 6 THEN 'root-node' ELSE nxt END AS new_parent FROM
      (SELECT o_custkey + 1 AS doc_id, o_orderkey AS seq, 'p' || o_orderpriority AS g, 's' || o_orderpriority || '/' || o_orderstatus AS s, lead('s' || o_orderpriority || '/' || o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nxt FROM orders) WHERE seq % 7 = 6 OR nxt IS NOT NULL""",
    "paths": "SELECT doc_id, id, [id] AS path, parent_id FROM nodes WHERE parent_id IS NULL UNION ALL SELECT n.doc_id, n.id, list_append(p.path, n.id), n.parent_id FROM nodes n JOIN paths p ON n.doc_id = p.doc_id AND n.parent_id = p.id",
    "aligned": "SELECT doc_id, id, [id] AS path, parent_id, ord FROM nodes WHERE parent_id IS NULL AND auto_align UNION ALL SELECT n.doc_id, n.id, list_append(p.path, n.id), n.parent_id, n.ord FROM nodes n JOIN aligned p ON n.doc_id = p.doc_id AND n.parent_id = p.id WHERE n.auto_align",
    "heights": "SELECT doc_id, node AS id, count(*) AS leaves, 130 * count(*) - 80 AS height FROM (SELECT doc_id, unnest(path) AS node FROM aligned a WHERE NOT EXISTS (SELECT 1 FROM aligned b WHERE b.doc_id = a.doc_id AND b.parent_id = a.id)) GROUP BY doc_id, node",
    "branches": "SELECT doc_id, id AS branch, CASE WHEN row_number() OVER (PARTITION BY doc_id, parent_id ORDER BY ord, id) % 2 = 1 THEN 'left' ELSE 'right' END AS side FROM aligned WHERE len(path) = 2",
    "suggested": """SELECT n.doc_id, n.id, CASE WHEN n.parent_id IS NULL THEN CASE WHEN coalesce(c.l, 0) <= coalesce(c.r, 0) THEN 'left' ELSE 'right' END ELSE coalesce(b.side, 'right') END AS side
      FROM nodes n LEFT JOIN aligned a ON a.doc_id = n.doc_id AND a.id = n.id LEFT JOIN branches b ON b.doc_id = a.doc_id AND b.branch = a.path[2]
      LEFT JOIN (SELECT doc_id, count(*) FILTER (side = 'left') AS l, count(*) FILTER (side = 'right') AS r FROM branches GROUP BY doc_id) c ON c.doc_id = n.doc_id""",
}


def given(*relations: str) -> str:
    """A WITH clause that defines some of the relations, in this order."""
    return "WITH RECURSIVE " + ", ".join(f"{name} AS ({RELATIONS[name]})" for name in relations) + " "


def query(sql: str | None):
    """Registers a function of the tables under its name, with its SQL where there is one."""

    def add(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[build.__name__] = lambda spark, folder: build(Tables(spark, folder))
        if sql:
            SQL[build.__name__] = sql
        return build

    return add
