"""Queries over documents, their members, notifications and versions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import commits as C
from ..operators import mutations as M
from ..operators import relational as R
from ..session import removed, shared_folder
from ..sources.tables import Tables
from .registry import given, query

#: The user and map of single-user and single-map queries.
USER, MAP = 7, 42
_NOW = "2024-01-31 00:00:00"


def now():
    return F.lit(_NOW).cast("timestamp_ntz")


@query(given("users", "maps", "collab", "places") + """
SELECT p.user_id, p.map_id, m.title, m.updated_at, u.name AS owner_name, CASE WHEN place = 0 THEN 'my' ELSE 'shared' END AS bucket,
  row_number() OVER (PARTITION BY p.user_id ORDER BY m.updated_at DESC NULLS LAST, p.map_id) AS recency
FROM places p JOIN maps m ON m.id = p.map_id LEFT JOIN users u ON u.id = m.owner_id""")
def list_my_maps(t: Tables) -> DataFrame:
    return R.listed_maps(t.maps(), t.collaborators(), t.users())


@query(given("maps", "collab", "places") + f"""
SELECT p.map_id, m.title, m.updated_at, place = 0 AS mine FROM places p JOIN maps m ON m.id = p.map_id WHERE user_id = {USER}""")
def maps_of_user(t: Tables) -> DataFrame:
    """One user's maps, newest first: the filters reach both scans."""
    mine, shared = t.maps().where(F.col("owner_id") == USER), t.collaborators().where(F.col("user_id") == USER)
    found = shared.select(F.col("map_id").alias("id")).join(t.maps(), "id").select(mine.columns).unionByName(mine)
    once = found.dropDuplicates(["id"]).orderBy(F.col("updated_at").desc_nulls_last(), "id")
    return once.select(F.col("id").alias("map_id"), "title", "updated_at", (F.col("owner_id") == USER).alias("mine"))


@query(given("maps", "collab", "places") + "SELECT user_id, count(*) FILTER (place = 0) AS owned, count(*) FILTER (place > 0) AS shared FROM places GROUP BY user_id")
def owned_shared_counts(t: Tables) -> DataFrame:
    return R.reachable(t.maps(), t.collaborators()).groupBy("user_id").agg(F.count_if(F.col("place") == 0).alias("owned"), F.count_if(F.col("place") > 0).alias("shared"))


@query(given("maps") + f"SELECT * FROM maps WHERE id = {MAP}")
def map_by_id(t: Tables) -> DataFrame:
    return R.by_key(t.maps(), "id", MAP)


@query(given("maps") + f"SELECT * FROM maps WHERE ydoc_id = 'y{MAP}' ORDER BY id LIMIT 1")
def map_by_ydoc(t: Tables) -> DataFrame:
    return R.first_match(t.maps(), F.col("ydoc_id") == f"y{MAP}", "id")


@query(given("maps", "users", "collab") + """
SELECT m.id, m.title, u.name AS owner_name, u.email AS owner_email, coalesce(c.n, 0) AS n_collaborators FROM maps m
LEFT JOIN users u ON u.id = m.owner_id LEFT JOIN (SELECT map_id, count(*) AS n FROM collab GROUP BY map_id) c ON c.map_id = m.id""")
def get_map_populated(t: Tables) -> DataFrame:
    counts = t.collaborators().groupBy(F.col("map_id").alias("id")).agg(F.count("*").alias("n"))
    found = R.populated(t.maps(), t.users(), "owner_id", "owner").join(counts, "id", "left")
    return found.select("id", "title", "owner_name", "owner_email", F.coalesce("n", F.lit(0)).cast("long").alias("n_collaborators"))


@query(given("users", "collab") + """
SELECT c.map_id, string_agg(coalesce(u.email, '') || ':' || c.role, ', ' ORDER BY c.user_id) AS members
FROM collab c LEFT JOIN users u ON u.id = c.user_id GROUP BY c.map_id""")
def collaborators_populated(t: Tables) -> DataFrame:
    found = R.populated(t.collaborators(), t.users(), "user_id", "user")
    listed = found.groupBy("map_id").agg(F.array_sort(F.collect_list(F.struct("user_id", F.concat(F.coalesce("user_email", F.lit("")), F.lit(":"), "role").alias("text")))).alias("m"))
    return listed.select("map_id", F.array_join("m.text", ", ").alias("members"))


@query(given("maps", "collab") + """
SELECT m.id AS map_id, 1 + coalesce(c.n, 0) AS members, CASE WHEN coalesce(c.n, 0) = 0 THEN '1 member' ELSE (1 + c.n) || ' members' END AS label
FROM maps m LEFT JOIN (SELECT map_id, count(*) AS n FROM collab GROUP BY map_id) c ON c.map_id = m.id""")
def members_count(t: Tables) -> DataFrame:
    members = t.maps().select(F.col("id").alias("map_id")).unionAll(t.collaborators().join(t.maps().select(F.col("id").alias("map_id")), "map_id", "left_semi").select("map_id"))
    counted = members.groupBy("map_id").agg(F.count("*").alias("members"))
    return counted.withColumn("label", F.when(F.col("members") == 1, "1 member").otherwise(F.concat(F.col("members").cast("string"), F.lit(" members"))))


@query(given("maps", "collab", "places") + """
SELECT user_id, map_id, ['owner', 'editor', 'viewer'][place + 1] AS read_role, CASE WHEN place < 2 THEN ['owner', 'editor'][place + 1] END AS write_role FROM places""")
def access_matrix(t: Tables) -> DataFrame:
    return R.access(t.maps(), t.collaborators())


@query(given("notes", "users", "maps") + f"""
SELECT n.id, n.created_at, n.read, n.status, u.name AS from_name, u.email AS from_email, m.title FROM notes n LEFT JOIN users u ON u.id = n.from_user
LEFT JOIN maps m ON m.id = n.map_id WHERE n.to_user = {USER} ORDER BY n.created_at DESC, n.id LIMIT 50""")
def notifications_top50(t: Tables) -> DataFrame:
    top = R.newest(t.notifications().where(F.col("to_user") == USER), 50)
    found = R.populated(top, t.users(), "from_user", "from").join(t.maps().select(F.col("id").alias("map_id"), "title"), "map_id", "left")
    return found.select("id", "created_at", "read", "status", "from_name", "from_email", "title")


@query(given("notes") + "SELECT to_user, count(*) FILTER (NOT read) AS unread FROM notes GROUP BY to_user")
def unread_count_by_user(t: Tables) -> DataFrame:
    return t.notifications().groupBy("to_user").agg(F.count_if(F.col("read") == F.lit(False)).alias("unread"))


@query(given("notes") + "SELECT to_user, CASE WHEN count(*) FILTER (NOT coalesce(read, false)) > 9 THEN '9+' ELSE CAST(count(*) FILTER (NOT coalesce(read, false)) AS VARCHAR) END AS badge FROM notes GROUP BY to_user")
def unread_badge(t: Tables) -> DataFrame:
    unread = t.notifications().groupBy("to_user").agg(F.count_if(~F.coalesce("read", F.lit(False))).alias("n"))
    return unread.select("to_user", F.when(F.col("n") > 9, "9+").otherwise(F.col("n").cast("string")).alias("badge"))


@query(given("notes") + f"SELECT id, to_user, CASE WHEN to_user = {USER} THEN true ELSE read END AS read FROM notes")
def mark_all_read(t: Tables) -> DataFrame:
    return M.all_read(t.notifications(), USER).select("id", "to_user", "read")


@query(given("notes", "collab") + """
SELECT map_id, user_id, role FROM collab UNION ALL
SELECT DISTINCT map_id, to_user, 'viewer' FROM notes n WHERE status = 'pending' AND NOT EXISTS (SELECT 1 FROM collab c WHERE c.map_id = n.map_id AND c.user_id = n.to_user)""")
def accept_invites(t: Tables) -> DataFrame:
    return M.accepted(t.notifications(), t.collaborators())


@query(given("notes") + "SELECT id, CASE WHEN status = 'pending' THEN 'rejected' ELSE status END AS status, CASE WHEN status = 'pending' THEN true ELSE read END AS read FROM notes")
def reject_invites(t: Tables) -> DataFrame:
    return M.updated(t.notifications(), F.col("status") == "pending", status="rejected", read=True).select("id", "status", "read")


@query(given("notes") + "SELECT id, status, 'Already ' || status AS problem FROM notes WHERE status <> 'pending'")
def handled_invites(t: Tables) -> DataFrame:
    """Invitations that a second answer is refused for."""
    return t.notifications().where("status <> 'pending'").select("id", "status", F.concat(F.lit("Already "), "status").alias("problem"))


@query(given("notes", "users", "collab") + """
SELECT id, to_user, map_id FROM notes n WHERE EXISTS (SELECT 1 FROM users u WHERE u.id = n.to_user)
AND NOT EXISTS (SELECT 1 FROM collab c WHERE c.map_id = n.map_id AND c.user_id = n.to_user)""")
def invite_guard(t: Tables) -> DataFrame:
    return R.guarded_invites(t.notifications(), t.users(), t.collaborators()).select("id", "to_user", "map_id")


@query(given("collab") + f"SELECT map_id, count(*) AS before, count(*) FILTER (user_id <> {USER}) AS after, bool_or(user_id = {USER}) AS found FROM collab GROUP BY map_id")
def remove_collaborator(t: Tables) -> DataFrame:
    """A collaborator taken out of every array of members; not found where the length stays."""
    arrays = t.collaborators().groupBy("map_id").agg(F.collect_list(F.struct("user_id", "role")).alias("members"))
    cut = arrays.withColumn("left", F.filter("members", lambda m: m["user_id"] != USER))
    return cut.select("map_id", F.size("members").cast("long").alias("before"), F.size("left").cast("long").alias("after"), (F.size("members") != F.size("left")).alias("found"))


@query(given("collab") + f"SELECT map_id, user_id, CASE WHEN user_id = {USER} AND map_id % 3 < 2 THEN ['editor', 'viewer'][map_id % 3 + 1] ELSE role END AS role FROM collab")
def change_role(t: Tables) -> DataFrame:
    """A role asked for one user on each map; only editor and viewer can be given, a third ask for more."""
    asked = F.element_at(F.array(F.lit("editor"), F.lit("viewer"), F.lit("owner")), (F.col("map_id") % 3 + 1).cast("int"))
    rows = t.collaborators().withColumn("asked", asked)
    return M.updated(rows, (F.col("user_id") == USER) & F.col("asked").isin("editor", "viewer"), role=F.col("asked")).select("map_id", "user_id", "role")


@query(given("versions", "users") + "SELECT v.id, v.map_id, v.type, v.size, v.created_at, u.name AS user_name, u.email AS user_email FROM versions v LEFT JOIN users u ON u.id = v.user_id")
def version_list(t: Tables) -> DataFrame:
    return R.populated(t.versions(), t.users(), "user_id", "user").drop("user_id")


@query(given("versions") + "SELECT id, map_id, row_number() OVER (PARTITION BY map_id ORDER BY created_at DESC, id) = 1 AS current FROM versions")
def version_current_flag(t: Tables) -> DataFrame:
    """The newest version of each map is current; an aggregation joined back, not a sort per map."""
    newest = R.latest_each(t.versions().select("id", "map_id", "created_at"), "map_id").select("map_id", F.col("id").alias("newest"))
    return t.versions().join(newest, "map_id").select("id", "map_id", (F.col("id") == F.col("newest")).alias("current"))


@query(given("versions", "maps") + """
SELECT m.id AS map_id, v.id AS version_id, coalesce(v.size, 0) AS size FROM maps m
LEFT JOIN (SELECT * FROM versions QUALIFY row_number() OVER (PARTITION BY map_id ORDER BY created_at DESC, id) = 1) v ON v.map_id = m.id""")
def latest_version(t: Tables) -> DataFrame:
    best = R.latest_each(t.versions().select("id", "map_id", "created_at", "size"), "map_id")
    found = t.maps().select(F.col("id").alias("map_id")).join(best, "map_id", "left")
    return found.select("map_id", F.col("id").alias("version_id"), F.coalesce("size", F.lit(0)).cast("long").alias("size"))


@query(given("versions", "maps") + "SELECT id, map_id, type FROM versions v WHERE NOT EXISTS (SELECT 1 FROM maps m WHERE m.id = v.map_id AND m.id % 10 <> 0)")
def orphan_versions(t: Tables) -> DataFrame:
    """Versions of deleted maps; every tenth map counts as deleted."""
    return R.orphans(t.versions(), t.maps().where("id % 10 <> 0")).select("id", "map_id", "type")


@query(given("versions", "maps") + """
SELECT map_id, user_id, type, size FROM versions UNION ALL
SELECT id, owner_id, 'delete-backup', strlen(title) FROM maps WHERE id % 10 = 0 AND title IS NOT NULL""")
def delete_with_backup(t: Tables) -> DataFrame:
    """The versions after every tenth map is deleted; a map's title stands for its snapshot."""
    maps = t.maps().withColumn("snapshot", F.encode("title", "utf-8"))
    return M.removed_maps(maps, t.versions(), F.col("id") % 10 == 0)[1]


#: Versions with a state each, maps with a snapshot or none, and the version that is chosen for each map.
_STATES = given("versions", "maps") + """
, v AS (SELECT id, map_id, created_at, to_base64(encode('state ' || size % 7)) AS encoded FROM versions),
l AS (SELECT id AS map_id, CASE WHEN id % 4 <> 0 THEN to_base64(encode('state ' || id % 7)) END AS encoded FROM maps)
"""


def _versions(t: Tables) -> DataFrame:
    state = F.concat(F.lit("state "), (F.col("size") % 7).cast("string"))
    return t.versions().select("id", "map_id", "created_at", S.base64_of(F.encode(state, "utf-8")).alias("encoded"))


def _snapshots(t: Tables) -> DataFrame:
    state = F.concat(F.lit("state "), (F.col("id") % 7).cast("string"))
    return t.maps().select("id", F.when(F.col("id") % 4 != 0, S.base64_of(F.encode(state, "utf-8"))).alias("snapshot"))


@query(_STATES + """
, c AS (SELECT map_id, max(id) + CASE WHEN map_id % 5 = 0 THEN 1 ELSE 0 END AS version_id FROM v GROUP BY map_id),
p AS (SELECT c.map_id, v.created_at, v.encoded AS restored, l.encoded AS now FROM c JOIN v ON v.id = c.version_id AND v.map_id = c.map_id LEFT JOIN l ON l.map_id = c.map_id),
w AS (SELECT map_id, 1::BIGINT AS step, 'auto' AS type, 'Auto-backup before restore' AS label, now AS encoded FROM p WHERE now IS NOT NULL AND now <> restored
UNION ALL SELECT map_id, 2, 'current', NULL, restored FROM p UNION ALL SELECT map_id, 3, 'restore', 'Restored from ' || strftime(created_at, '%Y-%m-%d %H:%M:%S'), restored FROM p)
SELECT *, octet_length(from_base64(encoded)) AS size FROM w""")
def restore_plan(t: Tables) -> DataFrame:
    """A version restored in every map that has some; every fifth asks for one that is not its own."""
    chosen = _versions(t).groupBy("map_id").agg((F.max("id") + F.when(F.col("map_id") % 5 == 0, 1).otherwise(0)).alias("version_id"))
    live = _snapshots(t).where("snapshot IS NOT NULL").select(F.col("id").alias("map_id"), F.col("snapshot").alias("encoded"))
    return M.restore_plan(_versions(t), live, chosen)


_CHOSEN = """
, c AS (SELECT map_id, max(id) + CASE WHEN map_id % 5 = 0 THEN 1 ELSE 0 END AS version_id FROM v GROUP BY map_id),
p AS (SELECT c.map_id, c.version_id, v.encoded AS restored, l.encoded AS now FROM c JOIN v ON v.id = c.version_id AND v.map_id = c.map_id LEFT JOIN l ON l.map_id = c.map_id)
"""


@query(_STATES + _CHOSEN + """
SELECT map_id, 'current' AS relation, NULL::VARCHAR AS kind, restored AS what FROM p
UNION ALL SELECT map_id, 'current', NULL, encoded FROM l WHERE encoded IS NOT NULL AND map_id NOT IN (SELECT map_id FROM p)
UNION ALL SELECT map_id, 'versions', 'auto', now FROM p WHERE now <> restored
UNION ALL SELECT map_id, 'versions', 'restore', restored FROM p
UNION ALL SELECT map_id, 'audit', 'restore-version', CAST(version_id AS VARCHAR) FROM p""")
def restore_committed(t: Tables) -> DataFrame:
    """The restores of ``restore_plan`` as one commit over current states, versions and audit rows, read back."""
    folder = f"{shared_folder(t.spark)}/ledger-{uuid.uuid4().hex}"
    removed(t.spark, folder, at_exit=True)
    ledger = C.Ledger(t.spark, folder)
    chosen = _versions(t).groupBy("map_id").agg((F.max("id") + F.when(F.col("map_id") % 5 == 0, 1).otherwise(0)).alias("version_id"))
    ledger.commit(0, current=_snapshots(t).where("snapshot IS NOT NULL").select(F.col("id").alias("map_id"), F.col("snapshot").alias("encoded")))
    C.restored(ledger, _versions(t), chosen.withColumn("user_id", F.lit(USER).cast("long")))
    current = ledger.newest("current", ["map_id"]).select("map_id", F.lit("current").alias("relation"), F.lit(None).cast("string").alias("kind"), F.col("encoded").alias("what"))
    versions = ledger.read("versions").select("map_id", F.lit("versions"), "type", "encoded")
    return current.unionAll(versions).unionAll(ledger.read("audit").select("map_id", F.lit("audit"), "action", F.col("detail")["versionId"]))


@query(_STATES + """
, n AS (SELECT map_id, encoded FROM v QUALIFY row_number() OVER (PARTITION BY map_id ORDER BY created_at DESC, id) = 1)
SELECT l.map_id, coalesce(l.encoded, n.encoded) AS encoded, CASE WHEN l.encoded IS NOT NULL THEN 'map' ELSE 'version' END AS source
FROM l LEFT JOIN n ON n.map_id = l.map_id WHERE l.encoded IS NOT NULL OR n.encoded IS NOT NULL""")
def loaded_states(t: Tables) -> DataFrame:
    """The state that each map opens with: its snapshot, else its newest version's, else not found."""
    return M.loaded_states(_snapshots(t), _versions(t))


@query(given("maps") + "SELECT id AS map_id, owner_id AS user_id, 'save-version' AS action, title AS detail_title, CAST(id AS VARCHAR) AS detail_id FROM maps")
def audit_append(t: Tables) -> DataFrame:
    rows = t.maps().select(F.col("id").alias("map_id"), F.col("owner_id").alias("user_id"), "title")
    logged = M.audited(rows.select("map_id", "user_id", "title"), "save-version", title=F.col("title"), id=F.col("map_id"))
    return logged.select("map_id", "user_id", "action", F.col("detail")["title"].alias("detail_title"), F.col("detail")["id"].alias("detail_id"))


@query(f"SELECT event_id, ts + INTERVAL 7 DAY AS expires_at, ts + INTERVAL 15 MINUTE AS access_until, ts + INTERVAL 7 DAY < TIMESTAMP '{_NOW}' AS expired FROM events")
def token_expiry(t: Tables) -> DataFrame:
    week, quarter = F.expr("INTERVAL 7 DAYS"), F.expr("INTERVAL 15 MINUTES")
    return t.base("events").select("event_id", (F.col("ts") + week).alias("expires_at"), (F.col("ts") + quarter).alias("access_until"), (F.col("ts") + week < now()).alias("expired"))


@query(f"""
WITH t AS (SELECT event_id AS token, user_id, ts + INTERVAL 7 DAY AS expires_at FROM events),
good AS (SELECT * FROM t WHERE NOT expires_at < TIMESTAMP '{_NOW}' AND user_id % 2 = 0)
SELECT token, user_id, expires_at FROM t WHERE token NOT IN (SELECT token FROM good) UNION ALL
SELECT token + 1000000000, user_id, TIMESTAMP '{_NOW}' + INTERVAL 7 DAY FROM good""")
def token_rotation(t: Tables) -> DataFrame:
    """Even users exchange their valid tokens: each works once, and a new one takes its place."""
    week = F.expr("INTERVAL 7 DAYS")
    tokens = t.base("events").select(F.col("event_id").alias("token"), "user_id", (F.col("ts") + week).alias("expires_at"))
    good = (F.col("user_id") % 2 == 0) & ~(F.col("expires_at") < now())
    fresh = tokens.where(good).select((F.col("token") + 1_000_000_000).alias("token"), "user_id", (now() + week).alias("expires_at"))
    return M.deleted(tokens, good).unionByName(fresh)


@query(given("versions") + "SELECT count(*) AS n, count(*) FILTER (type = 'auto') AS autos, sum(size)::BIGINT AS bytes, max(created_at) AS newest FROM versions")
def version_totals(t: Tables) -> DataFrame:
    return t.versions().agg(F.count("*").alias("n"), F.count_if(F.col("type") == "auto").alias("autos"), F.sum("size").alias("bytes"), F.max("created_at").alias("newest"))


@query(given("maps") + "SELECT id, coalesce(CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 = 1 THEN '' ELSE 'new' END, title) AS nullish, CASE WHEN id % 5 IN (0, 1) THEN title ELSE 'new' END AS falsy FROM maps")
def default_updates(t: Tables) -> DataFrame:
    """A patch taken unless null, and unless null, empty or zero."""
    patch = F.when(F.col("id") % 5 == 0, F.lit(None).cast("string")).when(F.col("id") % 5 == 1, "").otherwise("new")
    return t.maps().select("id", F.coalesce(patch, "title").alias("nullish"), S.or_else(patch, F.col("title")).alias("falsy"))
