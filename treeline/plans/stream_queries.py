"""Queries over edit logs, presence and debounced saves, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lists as L
from ..operators import mutations as M
from ..operators import relational as R
from ..operators import undo as U
from ..sources.tables import Tables
from ..streaming import attendance as A
from ..streaming import edits as E
from ..streaming import invitations as I
from .registry import query

#: Gap of the test data's sessions, and the moment at which presence is judged.
GAP, _AT, _WINDOW_MS = "6 hours", "2024-01-30 12:00:00", 86_400_000
_SESSIONS = """
WITH m AS (SELECT {key} AS key, ts, ts > lag(ts) OVER (PARTITION BY {key} ORDER BY ts) + INTERVAL '{gap}' AS fresh FROM events),
g AS (SELECT key, ts, sum(CASE WHEN fresh IS NULL OR fresh THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ts) AS n FROM m)
SELECT key AS {key}, min(ts) AS start, max(ts) + INTERVAL '{gap}' AS stop, count(*) AS n FROM g GROUP BY key, g.n"""


@query("SELECT conv_id AS doc_id, count(*) AS n_nodes, count(*) FILTER (role = 'user') AS n_edges FROM conversations GROUP BY 1")
def doc_cardinality(t: Tables) -> DataFrame:
    return t.op_log().groupBy("doc_id").agg(F.count("*").alias("n_nodes"), F.count_if(F.col("client") == "user").alias("n_edges"))


_LWW = "SELECT conv_id AS doc_id, role AS key, arg_max(text, turn) AS value, max(turn) AS clock FROM conversations GROUP BY 1, 2"


@query(_LWW)
def lww_state(t: Tables) -> DataFrame:
    return R.last_writes(t.op_log())


@query("SELECT conv_id AS doc_id, turn AS clock, role AS key, text AS value FROM conversations WHERE conv_id % 3 <> 0 UNION ALL SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 'root', 'restored' FROM conversations WHERE conv_id % 3 = 0")
def full_replace(t: Tables) -> DataFrame:
    """Every third document replaced as a whole."""
    current = t.op_log().select("doc_id", "clock", "key", "value")
    restored = current.where("doc_id % 3 = 0").select("doc_id").distinct().select("doc_id", F.lit(0).cast("long").alias("clock"), F.lit("root").alias("key"), F.lit("restored").alias("value"))
    return M.replaced(current, restored, ["doc_id"])


@query(_SESSIONS.format(key="user_id", gap="6 hours"))
def autosave_sessions(t: Tables) -> DataFrame:
    return R.quiet_groups(t.base("events"), "user_id", "ts", GAP)


@query(_SESSIONS.format(key="event_type", gap="15 minutes"))
def undo_groups(t: Tables) -> DataFrame:
    return R.quiet_groups(t.base("events"), "event_type", "ts", "15 minutes")


@query("""
WITH RECURSIVE l AS (SELECT user_id % 20 AS doc_id, 'c' || user_id AS client, event_id AS seq, ts, CASE event_type WHEN 'error' THEN 'undo' WHEN 'signup' THEN 'redo' ELSE 'edit' END AS kind, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS VARCHAR) AS key, event_type || ' ' || event_id AS value FROM events),
n AS (SELECT *, lag(kind) OVER w AS kind_before, lag(ts) OVER w AS ts_before FROM l WINDOW w AS (PARTITION BY client ORDER BY seq)),
s AS (SELECT *, CAST(sum(CASE WHEN kind = 'edit' AND kind_before = 'edit' AND ts < ts_before + INTERVAL 6 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY client ORDER BY seq) AS BIGINT) AS step FROM n),
d AS (SELECT client, step, min(kind) AS kind FROM s GROUP BY client, step),
r AS (SELECT client, step, CASE WHEN kind = 'edit' THEN [step] ELSE CAST([] AS BIGINT[]) END AS undo, CAST([] AS BIGINT[]) AS redo FROM d WHERE step = 1
UNION ALL SELECT d.client, d.step, CASE WHEN d.kind = 'edit' THEN list_append(r.undo, d.step) WHEN d.kind = 'undo' THEN r.undo[:-2] WHEN len(r.redo) > 0 THEN list_append(r.undo, r.redo[-1]) ELSE r.undo END,
CASE WHEN d.kind = 'edit' THEN CAST([] AS BIGINT[]) WHEN d.kind = 'redo' THEN r.redo[:-2] WHEN len(r.undo) > 0 THEN list_append(r.redo, r.undo[-1]) ELSE r.redo END FROM r JOIN d ON d.client = r.client AND d.step = r.step + 1),
f AS (SELECT client, unnest(arg_max(undo, step)) AS step FROM r GROUP BY client)
SELECT doc_id, key, arg_max(value, seq) AS value, max(seq) AS seq FROM s JOIN f USING (client, step) WHERE kind = 'edit' GROUP BY doc_id, key""")
def undone_state(t: Tables) -> DataFrame:
    """What stands of each document after all edits, undos and redos of its clients; edits within six hours are one step."""
    return U.state(t.undo_log(), "6 hours")


@query("""
WITH RECURSIVE o AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id // 20 AS n FROM events),
r AS (SELECT event_id % 20 AS doc_id, 'e' || event_id AS id, CASE WHEN n >= (k % 4 + 1) * 3 THEN 'e' || (event_id - 60 * (k % 4 + 1)) END AS after, event_type || ' ' || event_id AS value, row_number() OVER (ORDER BY n // 3 DESC, 'c' || user_id, 'e' || event_id) AS nth FROM o),
p AS (SELECT doc_id, id, value, [nth] AS path FROM r WHERE after IS NULL UNION ALL SELECT r.doc_id, r.id, r.value, list_append(p.path, r.nth) FROM r JOIN p ON r.doc_id = p.doc_id AND r.after = p.id),
d AS (SELECT DISTINCT 'e' || (event_id - 20 * (k % 7 + 1)) AS id FROM o WHERE event_type = 'error')
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY path) - 1 AS position, id, value FROM p ANTI JOIN d USING (id)""")
def lists_after_edits(t: Tables) -> DataFrame:
    """The lists of twenty documents after all insertions and deletions, made at the same time by several clients."""
    return L.listed(t.list_log())


_PRESENT = f"""
SELECT user_id AS client_id, max(ts) AS last_updated FROM events WHERE user_id <> 7 GROUP BY 1 HAVING NOT epoch_us(TIMESTAMP '{_AT}') - epoch_us(max(ts)) > {_WINDOW_MS * 1000}"""


@query(_PRESENT)
def presence_active(t: Tables) -> DataFrame:
    return R.present(t.presence(), 7, F.lit(_AT).cast("timestamp_ntz"), _WINDOW_MS)


@query(f"SELECT count(*) AS online, string_agg(client_id, ',' ORDER BY client_id) FILTER (nth <= 3) AS shown FROM (SELECT *, row_number() OVER (ORDER BY client_id) AS nth FROM ({_PRESENT}))")
def presence_summary(t: Tables) -> DataFrame:
    """How many are online, and the three that are shown."""
    here = R.present(t.presence(), 7, F.lit(_AT).cast("timestamp_ntz"), _WINDOW_MS).select("client_id")
    first = here.orderBy("client_id").limit(3).agg(F.array_join(F.array_sort(F.collect_list("client_id")), ",").alias("shown"))
    both = here.agg(F.count("*").alias("online")).unionByName(first, allowMissingColumns=True)
    return both.agg(F.max("online").alias("online"), F.max("shown").alias("shown"))


@query(f"""WITH s AS ({_SESSIONS.format(key="user_id", gap="6 hours")}) SELECT * FROM s WHERE stop <= (SELECT max(ts) FROM events)""")
def stream_autosave(t: Tables) -> DataFrame:
    """The debounce as a stream: sessions closed by the watermark."""
    stream = E.read_log(t.spark, f"{t.folder}/events.parquet").select("user_id", "ts")
    closed = E.appended(E.debounced(stream, "user_id", "ts", GAP))
    return closed.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "stop")})


@query(_LWW)
def stream_lww(t: Tables) -> DataFrame:
    log = E.read_log(t.spark, f"{t.folder}/conversations.parquet")
    return E.merged_state(log.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("clock"), F.col("role").alias("client"), F.col("role").alias("key"), F.col("text").alias("value")))


@query(_PRESENT)
def stream_presence(t: Tables) -> DataFrame:
    stream = E.read_log(t.spark, f"{t.folder}/events.parquet").select(F.col("user_id").alias("client_id"), "ts")
    return R.present(E.latest(E.last_seen(stream, "client_id", "ts"), ["client_id"]), 7, F.lit(_AT).cast("timestamp_ntz"), _WINDOW_MS)


@query("""
WITH e AS (SELECT user_id AS doc_id, ts, event_id, event_id % 3 = 0 AS joins, lag(event_id % 3 = 0) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, min(CASE WHEN joins THEN ts END) OVER (PARTITION BY doc_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS again FROM e)
SELECT doc_id, ts + INTERVAL 30 SECOND AS evicted_at FROM n WHERE NOT joins AND before AND (again IS NULL OR again >= ts + INTERVAL 30 SECOND) AND ts + INTERVAL 30 SECOND < (SELECT max(ts) FROM events)""")
def stream_eviction(t: Tables) -> DataFrame:
    """Documents dropped from memory 30 seconds after their last client has left, by a timer each."""
    events = E.read_log(t.spark, f"{t.folder}/events.parquet")
    kind = F.when(F.col("event_id") % 3 == 0, "join").otherwise("leave")
    gone = E.appended(E.evicted(events.select(F.col("user_id").alias("doc_id"), F.lit("c").alias("client"), kind.alias("kind"), "ts", F.col("event_id").alias("nth"))))
    return gone.withColumn("evicted_at", F.col("evicted_at").cast("timestamp_ntz"))


@query("""
WITH e AS (SELECT user_id % 20 AS doc_id, user_id AS client, ts, event_id % 5 = 0 AS leaves, lag(event_id % 5 = 0) OVER w AS left_before, ts > lag(ts) OVER w + INTERVAL 12 HOUR AS silent, lead(ts) OVER w AS next_ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
k AS (SELECT *, left_before IS NOT NULL AND NOT left_before AND NOT silent AS was_here FROM e)
SELECT doc_id, client, true AS here, ts AS at FROM k WHERE NOT leaves AND NOT was_here UNION ALL SELECT doc_id, client, false, ts FROM k WHERE leaves AND was_here
UNION ALL SELECT doc_id, client, false, ts + INTERVAL 12 HOUR FROM k WHERE NOT leaves AND (next_ts > ts + INTERVAL 12 HOUR OR next_ts IS NULL AND ts + INTERVAL 12 HOUR < (SELECT max(ts) FROM events))""")
def stream_attendance(t: Tables) -> DataFrame:
    """Comings and goings of the clients of twenty documents: a leave counts at once, silence after twelve hours."""
    kind = F.when(F.col("event_id") % 5 == 0, "leave").otherwise("move")
    events = E.read_log(t.spark, f"{t.folder}/events.parquet").select((F.col("user_id") % 20).alias("doc_id"), F.col("user_id").alias("client"), kind.alias("kind"), "ts", F.col("event_id").alias("nth"))
    with A.rocksdb(t.spark):
        moves = E.appended(A.attendance(events, 12 * 3600))
    return moves.withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("""
WITH o AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
i AS (SELECT event_id AS invite_id, user_id AS to_user, ts AS sent_at FROM o WHERE event_id % 4 = 0),
a AS (SELECT event_id - event_id % 4 - 4 * (k % 5) AS invite_id, CASE WHEN event_type IN ('click', 'purchase') THEN 'accepted' ELSE 'rejected' END AS answer, ts AS answered_at FROM o WHERE event_id % 4 <> 0),
w AS (SELECT least((SELECT max(sent_at) FROM i), (SELECT max(answered_at) FROM a)) AS mark)
SELECT i.invite_id, to_user, sent_at, arg_min(answer, (answered_at, answer)) AS answer, min(answered_at) AS answered_at FROM i LEFT JOIN a ON a.invite_id = i.invite_id AND answered_at BETWEEN sent_at AND sent_at + INTERVAL 1 HOUR
GROUP BY ALL HAVING min(answered_at) IS NOT NULL OR i.sent_at + INTERVAL 1 HOUR < (SELECT mark FROM w)""")
def stream_invitations(t: Tables) -> DataFrame:
    """Invitations with their first answers, or none within an hour, as a join of two streams."""
    log = E.read_log(t.spark, f"{t.folder}/events.parquet")
    asked = log.where("event_id % 4 = 0").select(F.col("event_id").alias("invite_id"), F.col("user_id").alias("to_user"), F.col("ts").alias("sent_at"))
    k = F.get_json_object("props", "$.k").cast("long")
    answer = F.when(F.col("event_type").isin("click", "purchase"), "accepted").otherwise("rejected")
    told = E.read_log(t.spark, f"{t.folder}/events.parquet").where("event_id % 4 <> 0").select((F.col("event_id") - F.col("event_id") % 4 - 4 * (k % 5)).alias("invite_id"), answer.alias("answer"), F.col("ts").alias("answered_at"))
    found = I.outcomes(E.appended(I.answered(asked, told, "1 hour")))
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("sent_at", "answered_at")})
