"""Queries of scalar functions: text, time, numbers, binary envelopes, JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import mutations as M
from ..sources.tables import Tables
from .document_queries import _NOW, now
from .registry import given, query

_HASH = "CAST(list_sum(list_transform(string_split({x}, ''), lambda c: ascii(c))) AS BIGINT)"
_PALETTE = "['#3b82f6', '#ef4444', '#10b981', '#f59e0b', '#8b5cf6', '#ec4899']"


@query(given("users") + "SELECT id, lower(regexp_replace(chr(9) || ' ' || upper(email) || chr(10), '^\\s+|\\s+$', '', 'g')) AS email FROM users")
def email_normalise(t: Tables) -> DataFrame:
    messy = F.concat(F.lit("\t "), F.upper("email"), F.lit("\n"))
    return t.users().select("id", S.normal_email(messy).alias("email"))


@query(given("users") + "SELECT id, regexp_matches(CASE WHEN id % 3 = 0 THEN replace(email, '@', ' at ') ELSE email END, '\\S+@\\S+\\.\\S+') AS valid FROM users")
def email_valid(t: Tables) -> DataFrame:
    text = F.when(F.col("id") % 3 == 0, F.replace("email", F.lit("@"), F.lit(" at "))).otherwise(F.col("email"))
    return t.users().select("id", S.looks_like_email(text).alias("valid"))


@query(given("users") + "SELECT id, upper(left(coalesce(nullif(CASE WHEN id % 2 = 0 THEN '' ELSE name END, ''), nullif(email, ''), '?'), 1)) AS initial FROM users")
def display_initial(t: Tables) -> DataFrame:
    name = F.when(F.col("id") % 2 == 0, "").otherwise(F.col("name"))
    return t.users().select("id", S.initial(name, F.col("email")).alias("initial"))


@query(given("collab") + """
SELECT map_id, user_id, upper(left(role, 1)) || substr(role, 2) AS badge, CASE role WHEN 'owner' THEN 'bg-yellow-100 text-yellow-800' WHEN 'editor' THEN 'bg-blue-100 text-blue-800' ELSE 'bg-gray-100 text-gray-600' END AS style FROM collab""")
def capitalise_role(t: Tables) -> DataFrame:
    style = F.create_map(*(F.lit(x) for pair in S.ROLE_STYLES.items() for x in pair))[F.col("role")]
    return t.collaborators().select("map_id", "user_id", S.capitalised(F.col("role")).alias("badge"), style.alias("style"))


@query(given("users") + f"SELECT id, {_PALETTE}[{_HASH.format(x='name')} % 6 + 1] AS color FROM users")
def user_color(t: Tables) -> DataFrame:
    return t.users().select("id", S.palette(F.col("name"), S.USER_COLORS).alias("color"))


@query(given("nodes") + "SELECT doc_id, id, CASE WHEN ord % 2 = 0 THEN 'source-left' ELSE 'source-right' END AS source_handle, CASE WHEN ord % 2 = 0 THEN 'target-right' ELSE 'target-left' END AS target_handle FROM nodes")
def handle_from_side(t: Tables) -> DataFrame:
    return M.with_handles(t.nodes().select("doc_id", "id", "ord"), F.when(F.col("ord") % 2 == 0, "left").otherwise("right")).drop("ord")


@query("SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS plain FROM documents")
def fence_strip(t: Tables) -> DataFrame:
    """Whole texts out of their fences."""
    fenced = F.concat(F.lit("```json\n"), "text", F.lit("\n```"))
    return t.base("documents").select("doc_id", S.without_fences(fenced).alias("plain"))


@query(given("nodes") + "SELECT doc_id, id, CASE WHEN ord % 3 = 0 THEN 'New Node' ELSE label END AS label FROM nodes")
def label_default(t: Tables) -> DataFrame:
    typed = F.when(F.col("ord") % 3 == 0, F.lit(" \t\n")).otherwise(F.concat(F.lit("  "), "label"))
    return t.nodes().select("doc_id", "id", S.or_else(S.trimmed(typed), "New Node").alias("label"))


@query(given("versions") + "SELECT id, CASE type WHEN 'manual' THEN 'Manual Save' WHEN 'auto' THEN 'Auto Save' WHEN 'restore' THEN 'Restored' WHEN 'delete-backup' THEN 'Backup' ELSE type END AS label FROM versions")
def version_type_label(t: Tables) -> DataFrame:
    return t.versions().select("id", S.type_label(F.col("type")).alias("label"))


@query(given("versions") + """
SELECT id, CASE WHEN size IS NULL OR size = 0 THEN 'N/A' WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN printf('%.1f KB', round(size / 1024.0, 1))
  ELSE printf('%.1f MB', round(size / 1048576.0, 1)) END AS text FROM versions""")
def version_size_human(t: Tables) -> DataFrame:
    return t.versions().select("id", S.human_size(F.col("size")).alias("text"))


@query(f"""
WITH a AS (SELECT event_id, ts, epoch_us(TIMESTAMP '{_NOW}') - epoch_us(ts) AS us FROM events)
SELECT event_id, CASE WHEN us // 60000000 < 1 THEN 'Just now' WHEN us // 60000000 < 60 THEN (us // 60000000) || 'm ago' WHEN us // 3600000000 < 24 THEN (us // 3600000000) || 'h ago'
  WHEN us // 86400000000 < 7 THEN (us // 86400000000) || 'd ago' ELSE month(ts) || '/' || day(ts) || '/' || year(ts) END AS text FROM a""")
def relative_time(t: Tables) -> DataFrame:
    return t.base("events").select("event_id", S.age_text(F.col("ts"), now()).alias("text"))


@query("SELECT event_id, strftime(ts, '%b %-d, %Y') AS day, strftime(ts, '%b %-d, %Y, %I:%M %p') AS minute, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso, epoch_us(ts) // 1000 AS millis FROM events")
def date_formats(t: Tables) -> DataFrame:
    text = lambda form: F.date_format(F.col("ts").cast("timestamp"), form)
    return t.base("events").select("event_id", text("MMM d, yyyy").alias("day"), text("MMM d, yyyy, hh:mm a").alias("minute"), text("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("iso"), F.unix_millis(F.col("ts").cast("timestamp")).alias("millis"))


@query("SELECT doc_id, 1 AS schema_version, to_base64(encode(text)) AS encoded_state, 'system' AS created_by, 'auto' AS reason, true AS valid FROM documents WHERE text <> ''")
def snapshot_envelope(t: Tables) -> DataFrame:
    states = t.snapshots().where("state <> ''")
    made = states.select("doc_id", S.envelope(S.base64_of(F.encode("state", "utf-8")), F.lit(""), F.lit(None).cast("string"), F.lit(_NOW)).alias("s"))
    return made.select("doc_id", F.col("s.schemaVersion").alias("schema_version"), F.col("s.encodedState").alias("encoded_state"), F.col("s.meta.createdBy").alias("created_by"), F.col("s.meta.reason").alias("reason"), S.valid_envelope(F.col("s")).alias("valid"))


@query("SELECT doc_id, octet_length(encode(text)) AS size FROM documents")
def snapshot_size(t: Tables) -> DataFrame:
    return t.snapshots().select("doc_id", S.payload_size(S.base64_of(F.encode("state", "utf-8"))).alias("size"))


@query("SELECT doc_id, text AS state, true AS same FROM documents")
def snapshot_b64_roundtrip(t: Tables) -> DataFrame:
    back = F.decode(F.unbase64(S.base64_of(F.encode("state", "utf-8"))), "utf-8")
    return t.snapshots().select("doc_id", back.alias("state"), back.eqNullSafe(F.col("state")).alias("same"))


@query("""
WITH f AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN '{"schemaVersion":1,"encodedState":"' || to_base64(encode(text)) || '"}' WHEN 1 THEN to_base64(encode(text)) ELSE '{"meta":{}}' END AS stored FROM documents)
SELECT doc_id, encoded, encoded IS NULL AS invalid FROM (SELECT doc_id, CASE WHEN stored LIKE '{%' THEN nullif(json_extract_string(stored, '$.encodedState'), '') ELSE stored END AS encoded FROM f)""")
def legacy_snapshots(t: Tables) -> DataFrame:
    """Stored snapshots by their form: an envelope gives its state, bare bytes are encoded, anything else is invalid."""
    kind, raw = F.col("doc_id") % 3, F.encode("state", "utf-8")
    envelope = F.to_json(F.struct(F.lit(1).alias("schemaVersion"), S.base64_of(raw).alias("encodedState")))
    stored = F.when(kind == 0, F.encode(envelope, "utf-8")).when(kind == 1, raw).otherwise(F.encode(F.lit('{"meta":{}}'), "utf-8"))
    found = t.snapshots().select("doc_id", S.stored_state(stored).alias("encoded"))
    return found.select("doc_id", "encoded", F.col("encoded").isNull().alias("invalid"))


@query(given("nodes") + "SELECT d.doc_id, 'auto' AS type, to_base64(encode(text)) AS encoded, octet_length(encode(text)) AS size FROM documents d WHERE EXISTS (SELECT 1 FROM nodes n WHERE n.doc_id = d.doc_id)")
def autosave_write(t: Tables) -> DataFrame:
    """Versions of the documents that have nodes."""
    counts = t.nodes().groupBy("doc_id").agg(F.count("*").alias("node_count"))
    states = t.snapshots().select("doc_id", S.base64_of(F.encode("state", "utf-8")).alias("encoded")).join(counts, "doc_id")
    return M.autosaved(states)


@query("SELECT event_id, epoch_us(ts) // 1000000 AS seconds, CAST(to_timestamp(epoch_us(ts) // 1000000) AT TIME ZONE 'UTC' AS TIMESTAMP) AS at FROM events")
def epoch_timestamps(t: Tables) -> DataFrame:
    """Seconds since 1970 as timestamps."""
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    return t.base("events").select("event_id", seconds.alias("seconds"), F.timestamp_seconds(seconds).cast("timestamp_ntz").alias("at"))


@query(given("users") + "SELECT id, upper(left(name, 1)) || substr(name, 2) AS name, CASE WHEN id % 3 = 0 THEN 'none' ELSE coalesce(email, '') || ' / ' || name END AS line, regexp_replace(name, '^Customer', 'User') AS plain FROM users")
def text_pieces(t: Tables) -> DataFrame:
    """A capital first, a joined list with a default, a prefix replaced."""
    items = F.when(F.col("id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("email", "name"))
    return t.users().select("id", S.capitalised(F.col("name")).alias("name"), S.joined(items, " / ", "none").alias("line"), S.with_prefix(F.col("name"), "Customer", "User").alias("plain"))


@query("SELECT doc_id, 'data:text/plain;base64,' || to_base64(encode(text)) AS uri FROM documents WHERE octet_length(encode(text)) <= 5242880")
def upload_data_uri(t: Tables) -> DataFrame:
    data = F.encode("state", "utf-8")
    return t.snapshots().where(F.octet_length("state") <= 5 << 20).select("doc_id", S.data_uri(F.lit("text/plain"), data).alias("uri"))


@query("SELECT page_id, lower(html) LIKE '<!doctype%' AS is_page, length(url) BETWEEN 1 AND 200 AS fits, string_split(url, '/')[3] AS host FROM pages")
def upload_filters(t: Tables) -> DataFrame:
    """A prefix, a length and a part of a path."""
    return t.base("pages").select("page_id", F.startswith(F.lower("html"), F.lit("<!doctype")).alias("is_page"), F.length("url").between(1, 200).alias("fits"), F.get(F.split("url", "/"), 2).alias("host"))


@query("""
WITH p AS (SELECT p_partkey AS id, p_size * 10.0::DOUBLE AS x, p_retailprice / 10 AS y FROM part)
SELECT id, round((x + 600) / 2 - 40 * sin(atan2(400 - y, 600 - x)), 6) AS cx, round((y + 400) / 2 + 40 * cos(atan2(400 - y, 600 - x)), 6) AS cy FROM p""")
def edge_control_point(t: Tables) -> DataFrame:
    x, y = S.control_point(F.col("x"), F.col("y"), F.lit(600.0), F.lit(400.0), 40.0)
    return t.points().select("id", F.round(x, 6).alias("cx"), F.round(y, 6).alias("cy"))


@query("""
SELECT n_nationkey AS id, n_nationkey % 5 <> 4 AS parsed, n_nationkey % 5 NOT IN (3, 4) AS valid, CASE WHEN n_nationkey % 5 NOT IN (3, 4) THEN n_name END AS text,
  CASE WHEN n_nationkey % 5 < 3 THEN n_nationkey % 5 ELSE 0 END::BIGINT AS n_children FROM nation""")
def generated_tree_check(t: Tables) -> DataFrame:
    """Generated JSON trees: parsed, checked at the root, children counted."""
    kids = F.transform(F.sequence(F.lit(0), F.col("n_nationkey") % 5), lambda i: F.concat(F.lit('{"text":"c'), i.cast("string"), F.lit('"}')))
    children = F.concat(F.lit("["), F.array_join(F.slice(kids, F.lit(1), F.col("n_nationkey") % 5), ","), F.lit("]"))
    text = (
        F.when(F.col("n_nationkey") % 5 == 4, "not json")
        .when(F.col("n_nationkey") % 5 == 3, F.concat(F.lit('{"text":"'), "n_name", F.lit('"}')))
        .otherwise(F.concat(F.lit('{"text":"'), "n_name", F.lit('","children":'), children, F.lit("}")))
    )
    tree = F.from_json(text, "text string, children array<struct<text:string>>")
    found = t.base("nation").select("n_nationkey", tree.alias("t"), F.try_parse_json(text).isNotNull().alias("parsed"))
    valid = F.col("parsed") & F.coalesce(F.col("t.text") != "", F.lit(False)) & F.col("t.children").isNotNull()
    return found.select(F.col("n_nationkey").alias("id"), "parsed", valid.alias("valid"), F.when(valid, F.col("t.text")).alias("text"), F.when(F.col("t.children").isNotNull(), F.size("t.children")).otherwise(0).cast("long").alias("n_children"))
