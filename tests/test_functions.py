"""Scalar semantics at their edges, mutations, and streams."""

import base64
import datetime

import pytest
from pyspark.sql import functions as F

from treeline.functions import scalars as S
from treeline.operators import mutations as M
from treeline.operators import relational as R
from treeline.plans import catalog
from treeline.sources.tables import Tables
from treeline.streaming import edits as E


def evaluated(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_size_branches_and_ties(spark):
    sizes = [None, 0, 1, 1023, 1024, 1280, 1048575, 1048576]
    want = ["N/A", "N/A", "1 B", "1023 B", "1.0 KB", "1.3 KB", "1024.0 KB", "1.0 MB"]
    assert evaluated(spark, S.human_size(F.col("x")), [(x,) for x in sizes], "x long") == want


@pytest.mark.parametrize("seconds,text", [(59, "Just now"), (60, "1m ago"), (3599, "59m ago"), (3600, "1h ago"), (86399, "23h ago"), (86400, "1d ago"), (6 * 86400, "6d ago"), (7 * 86400, "1/24/2024")])
def test_age(spark, seconds, text):
    now = datetime.datetime(2024, 1, 31)
    row = [(now - datetime.timedelta(seconds=seconds), now)]
    assert evaluated(spark, S.age_text(F.col("a"), F.col("b")), row, "a timestamp_ntz, b timestamp_ntz") == [text]


def test_defaults_and_trims(spark):
    assert evaluated(spark, S.or_else(F.col("x"), "d"), [(None,), ("",), ("a",)], "x string") == ["d", "d", "a"]
    assert evaluated(spark, S.or_else(F.col("x"), F.lit(2)), [(None,), (0,), (5,)], "x int") == [2, 2, 5]
    assert evaluated(spark, S.or_else(S.trimmed(F.col("x")), "New Node"), [("\t \n",), (" a﻿",)], "x string") == ["New Node", "a"]
    assert evaluated(spark, S.joined(F.col("x"), ", ", "none"), [(["a", None],), ([],), (None,)], "x array<string>") == ["a, ", "none", "none"]


def test_text_functions(spark):
    one = [("root-node",)]
    assert evaluated(spark, S.code_sum(F.col("x")), one, "x string") == [919]
    assert evaluated(spark, S.capitalised(F.col("x")), [("editor role",)], "x string") == ["Editor role"]
    assert evaluated(spark, S.looks_like_email(F.col("x")), [("a@b.c",), ("a b",), ("x a@b.c y",)], "x string") == [True, False, True]
    assert evaluated(spark, S.without_fences(F.col("x")), [('```json\n{"a":1}\n```',)], "x string") == ['{"a":1}']
    long = "x" * 100
    assert evaluated(spark, S.base64_of(F.encode("x", "utf-8")), [(long,)], "x string")[0].count("\n") == 0
    assert evaluated(spark, S.initial(F.col("n"), F.col("e")), [("", "zoe@x.y"), (None, None)], "n string, e string") == ["Z", "?"]


def test_updates_ignore_null_conditions(spark):
    df = spark.createDataFrame([(1, None), (2, True), (3, False)], "id int, read boolean")
    assert [r.read for r in M.updated(df, F.col("read") == F.lit(False), read=True).orderBy("id").collect()] == [None, True, True]
    assert M.deleted(df, F.col("read")).count() == 2


def test_accept_is_idempotent(spark):
    notes = spark.createDataFrame([(1, 10, 5, "pending"), (2, 10, 5, "pending"), (3, 10, 6, "rejected"), (4, 11, 5, "pending")], "id long, map_id long, to_user long, status string")
    members = spark.createDataFrame([(11, 5, "editor")], "map_id long, user_id long, role string")
    once = M.accepted(notes, members)
    assert {tuple(r) for r in once.collect()} == {(11, 5, "editor"), (10, 5, "viewer")}
    assert {tuple(r) for r in M.accepted(notes, once).collect()} == {tuple(r) for r in once.collect()}


def test_owner_who_also_collaborates_is_listed_once(spark):
    maps = spark.createDataFrame([(1, 7)], "id long, owner_id long")
    members = spark.createDataFrame([(1, 7, "viewer"), (1, 8, "viewer"), (2, 9, "editor")], "map_id long, user_id long, role string")
    assert {tuple(r) for r in R.access(maps, members).collect()} == {(7, 1, "owner", "owner"), (8, 1, "viewer", None)}


def test_presence_limits(spark):
    now = datetime.datetime(2024, 1, 1, 0, 0, 20)
    states = [(1, None), (2, now - datetime.timedelta(seconds=10)), (3, now - datetime.timedelta(milliseconds=10_001)), (4, now)]
    df = spark.createDataFrame(states, "client_id long, last_updated timestamp_ntz")
    assert {r.client_id for r in R.present(df, 4, F.lit(now).cast("timestamp_ntz")).collect()} == {1, 2}


def test_updates_exactly_a_gap_apart_share_a_session(spark):
    start = datetime.datetime(2024, 1, 1)
    rows = [("d", start), ("d", start + datetime.timedelta(seconds=10)), ("d", start + datetime.timedelta(seconds=20, milliseconds=1))]
    found = R.quiet_groups(spark.createDataFrame(rows, "k string, ts timestamp_ntz"), "k", "ts", "10 seconds")
    assert sorted(r.n for r in found.collect()) == [1, 2]


def test_drop_target_takes_the_first_near_point(spark):
    import random

    rnd = random.Random(1)
    points = [(i, rnd.uniform(-200, 200), rnd.uniform(-200, 200)) for i in range(150)] + [(900, 5000.0, 0.0)]
    near = lambda p: min((q[0] for q in points if q[0] != p[0] and ((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2) ** 0.5 < 50), default=None)
    want = {p[0]: near(p) for p in points if near(p) is not None}
    assert {r.id: r.target for r in R.drop_targets(spark.createDataFrame(points, "id long, x double, y double")).collect()} == want


def test_stream_merge_is_order_insensitive(spark, tmp_path):
    rows = [(1, c, f"u{c % 2}", "k", f"v{c}") for c in range(6)]
    schema = "doc_id long, clock long, client string, key string, value string"
    for name, part in (("a", rows[3:]), ("b", rows[:3])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "log.parquet" / name))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "log.parquet"))
    assert [tuple(r) for r in E.merged_state(stream).collect()] == [(1, "k", "v5", 5)]


def test_store_replaces_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "state")
    M.store(spark.createDataFrame([(1, "a"), (2, "b")], "doc long, v string"), path, "doc")
    M.store(spark.createDataFrame([(2, "c")], "doc long, v string"), path, "doc")
    assert {(r.doc, r.v) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "c")}


def test_tables_are_views(spark):
    tables = Tables(spark, "/root/testdata/sf0.001")
    assert tables.nodes().where("doc_id = 0").count() == 1 + 5 + 25 + 150
    assert tables.nodes().where("id = 'root-node'").count() == 1 + 150
    assert tables.nodes().groupBy("doc_id", "id").count().where("count > 1").count() == 0
    assert tables.collaborators().groupBy("map_id", "user_id").count().where("count > 1").count() == 0


def test_saves_are_idempotent_and_resume(spark, tmp_path):
    schema, log = "doc_id long, clock long, value string", str(tmp_path / "log")
    spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], schema).write.parquet(log)
    stream = lambda: spark.readStream.schema(schema).parquet(log)
    E.saved(stream(), str(tmp_path / "history"), str(tmp_path / "check"))
    E.saved(stream(), str(tmp_path / "history"), str(tmp_path / "check"))
    spark.createDataFrame([(2, 5, "d")], schema).write.mode("append").parquet(log)
    E.saved(stream(), str(tmp_path / "history"), str(tmp_path / "check"))
    history = spark.read.parquet(str(tmp_path / "history"))
    assert history.count() == 3
    assert {tuple(r) for r in E.current_state(history).collect()} == {(1, 2, "b"), (2, 5, "d")}


def test_uploads_and_bodies(spark, tmp_path):
    from treeline.sources import files

    (tmp_path / "up").mkdir()
    for name, size in (("a.png", 10), ("b.JPG", 20), ("c.txt", 10), ("big.png", 200)):
        (tmp_path / "up" / name).write_bytes(b"x" * size)
    found = files.uploads(spark, str(tmp_path / "up"), most_bytes=100).collect()
    assert {(r.path.rpartition("/")[2], r.mime, len(r.content)) for r in found} == {("a.png", "image/png", 10), ("b.JPG", "image/jpeg", 20)}
    (tmp_path / "bodies.json").write_text('{"title":"t"}\nnot json\n{"title":"' + "y" * 500 + '"}\n')
    rows = files.bodies(spark, str(tmp_path / "bodies.json"), "title string", most_bytes=100).collect()
    assert [r.title for r in rows] == ["t", None]
    assert files.kept(spark.range(3).toDF("id"), "three").count() == spark.sql("SELECT * FROM three").count() == 3


@pytest.mark.parametrize("version,state", [(2, "x"), (1, ""), (1, None), (None, "x")])
def test_wrong_envelopes_raise_or_fail_the_test(spark, version, state):
    df = spark.createDataFrame([(version, state)], "v int, s string").select(F.struct(F.col("v").alias("schemaVersion"), F.col("s").alias("encodedState")).alias("e"))
    assert df.select(S.valid_envelope(F.col("e"))).first()[0] is False
    with pytest.raises(Exception, match="Unsupported schema version|Missing encoded state"):
        df.select(S.checked_envelope(F.col("e"))).collect()


def test_backup_only_of_maps_with_a_snapshot(spark):
    maps = spark.createDataFrame([(1, 7, bytearray(b"abc")), (2, 7, None), (3, 8, bytearray(b"z"))], "id long, owner_id long, snapshot binary")
    versions = spark.createDataFrame([], "map_id long, user_id long, type string, size long")
    left, backups = M.removed_maps(maps, versions, F.col("id") < 3)
    assert [r.id for r in left.collect()] == [3] and [tuple(r) for r in backups.collect()] == [(1, 7, "delete-backup", 3)]


def test_latest_rows_by_ids_of_any_type(spark):
    rows = [("m", "b", "2024-01-02", 1), ("m", "a", "2024-01-02", 2), ("m", "c", "2024-01-01", 3), ("n", "z", None, 4), ("n", "y", None, 5), ("n", "x", "2020-01-01", 6)]
    for kind in ("timestamp", "timestamp_ntz", "date"):
        df = spark.createDataFrame(rows, "map_id string, id string, created_at string, size int").withColumn("created_at", F.col("created_at").cast(kind))
        assert {(r.map_id, r.id, r["size"]) for r in R.latest_each(df, "map_id").collect()} == {("m", "a", 2), ("n", "x", 6)}


def test_restores_compare_states_not_sizes(spark):
    state = lambda text: base64.b64encode(text.encode()).decode()
    versions = spark.createDataFrame([("v1", 1, state("one")), ("v2", 1, state("two")), ("v3", 2, state("abc"))], "id string, map_id long, encoded string").withColumn("created_at", F.lit("2024-01-02 03:04:05").cast("timestamp"))
    live = spark.createDataFrame([(1, state("two")), (2, state("abc"))], "map_id long, encoded string")
    chosen = spark.createDataFrame([(1, "v1"), (2, "v3"), (3, "v1")], "map_id long, version_id string")
    got = sorted((r.map_id, r.step, r.type, base64.b64decode(r.encoded).decode()) for r in M.restore_plan(versions, live, chosen).collect())
    # of equal size but another state: backed up; the same state: not; another map's version: not found
    assert got == [(1, 1, "auto", "two"), (1, 2, "current", "one"), (1, 3, "restore", "one"), (2, 2, "current", "abc"), (2, 3, "restore", "abc")]


def test_an_edit_reaches_a_second_client_after_a_reload(spark, tmp_path):
    """Edit, save, reload: the first client's title is what the second one loads, also after a restart of the saver."""
    schema, log = "doc_id long, clock long, client string, key string, value string", str(tmp_path / "log")

    def edit(*rows):
        spark.createDataFrame(list(rows), schema).write.mode("append").parquet(log)

    def save():
        E.saved(spark.readStream.schema(schema).parquet(log).select("doc_id", "clock", "value"), str(tmp_path / "history"), str(tmp_path / "check"))
        return {r.doc_id: r.value for r in E.current_state(spark.read.parquet(str(tmp_path / "history"))).collect()}

    edit((1, 1, "A", "title", "Hello from A"))
    assert save() == {1: "Hello from A"}
    edit((1, 2, "B", "title", "Hello from B"), (2, 1, "B", "title", "Another"))
    assert save() == {1: "Hello from B", 2: "Another"}
    # the live state of both clients, by a stream that goes on where it stopped
    live = lambda: {(r.doc_id, r.key): r.value for r in E.merged_state(spark.readStream.schema(schema).parquet(log), str(tmp_path / "live")).collect()}
    assert live() == {(1, "title"): "Hello from B", (2, "title"): "Another"}
    edit((1, 3, "A", "title", "Last"))
    assert live() == {(1, "title"): "Last", (2, "title"): "Another"}


def test_evictions_wait_for_the_last_client(spark, tmp_path):
    at = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    rows = [
        (1, "a", "join", at(0), 0), (1, "b", "join", at(5), 1), (1, "a", "leave", at(10), 2), (1, "b", "leave", at(20), 3),  # gone at 50
        (2, "a", "join", at(0), 0), (2, "a", "leave", at(10), 1), (2, "b", "join", at(39), 2), (2, "c", "leave", at(60), 3),  # came back in time
        (3, "a", "join", at(0), 0), (3, "a", "leave", at(10), 1), (3, "a", "join", at(40), 2), (3, "a", "leave", at(100), 3),  # gone at 40 and 130
        (9, "x", "join", at(900), 0),
    ]
    path = str(tmp_path / "visits.parquet")
    spark.createDataFrame(rows, "doc_id long, client string, kind string, ts string, nth long").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(path)
    found = E.appended(E.evicted(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)))
    assert sorted((r.doc_id, str(r.evicted_at)[11:]) for r in found.collect()) == [(1, "00:00:50"), (3, "00:00:40"), (3, "00:02:10")]


def test_a_cluster_needs_a_shared_folder():
    from treeline import session as T

    class Session:
        class sparkContext:
            master, getCheckpointDir = "yarn", staticmethod(lambda: None)

        class conf:
            get = staticmethod(lambda name, default: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        T.shared_folder(Session())


def test_code_units_beyond_the_first_plane(spark):
    texts = ["", "abc", "é漢", "😀x"]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    units = lambda x: sum(int.from_bytes(x.encode("utf-16-be")[i : i + 2], "big") for i in range(0, len(x.encode("utf-16-be")), 2))
    assert [r[0] for r in df.select(S.code_sum(F.col("t"))).collect()] == list(map(units, texts))


def test_stored_states_by_their_form(spark):
    rows = [(b'{"schemaVersion":1,"encodedState":"QQ=="}', "QQ=="), (b'{"meta":{}}', None), (b"\xff\x00", "/wA="), (b"", ""), (b"{not json", base64.b64encode(b"{not json").decode())]
    df = spark.createDataFrame([(bytearray(a),) for a, _ in rows], "s binary")
    assert [r[0] for r in df.select(S.stored_state(F.col("s"))).collect()] == [want for _, want in rows]


def test_a_crowded_cell_of_points(spark):
    """All in one place and a ring of others: the same targets, root never one."""
    rnd = __import__("random").Random(3)
    points = [(i, rnd.uniform(0, 3), rnd.uniform(0, 3)) for i in range(1, 300)] + [(1000 + i, 40.0 + i, 0.0) for i in range(30)] + [(0, 1.0, 1.0)]
    near = lambda p: min((q[0] for q in points if q[0] not in (0, p[0]) and ((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2) ** 0.5 < 50), default=None)
    df = spark.createDataFrame(points, "id long, x double, y double")
    got = {r.id: r.target for r in R.drop_targets(df, roots=df.where("id = 0")).collect()}
    assert got == {p[0]: near(p) for p in points if near(p) is not None}


def test_presence_skips_clients_without_a_user_and_keeps_those_never_updated(spark):
    from treeline.operators.relational import present

    rows = [(1, "2024-01-01 00:00:00", "a"), (2, "2024-01-01 00:00:00", None), (3, "1970-01-01 00:00:00", "c"), (4, None, "d"), (5, "2023-12-31 23:59:00", "e"), (7, "2024-01-01 00:00:00", "me")]
    states = spark.createDataFrame(rows, "client_id long, last_updated string, user string").withColumn("last_updated", F.col("last_updated").cast("timestamp_ntz"))
    now = F.lit("2024-01-01 00:00:05").cast("timestamp_ntz")
    assert {r.client_id for r in present(states, 7, now).collect()} == {1, 3, 4}
    assert {r.client_id for r in present(states.drop("user"), 7, now).collect()} == {1, 2, 3, 4}


def test_the_sum_of_a_long_text_grows_with_its_length(spark):
    """Each unit is read once: 200,000 letters would take minutes if every one of them made the whole text again."""
    df = spark.range(1).select(F.repeat(F.lit("ab"), 100_000).alias("t"))
    none = df.select(S.code_sum(F.lit(None).cast("string")).alias("n"), S.code_sum(F.col("t")).alias("s")).first()
    assert (none.n, none.s) == (0, 100_000 * (97 + 98))


def test_ends_of_edges_are_not_counted_before_the_shuffle(spark):
    plan = catalog.queries()["edge_incidence"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "partial_count_if" not in plan.split("REPARTITION_BY_COL")[1] and "REPARTITION_BY_COL" in plan
