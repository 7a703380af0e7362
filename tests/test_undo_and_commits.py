"""Undo and redo against a replay with two stacks; commits over several relations with deaths and rivals between the writes."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from treeline.operators import commits as C
from treeline.operators import undo as U

LOG = "doc_id long, client string, seq long, ts timestamp, kind string, key string, value string"


def random_log(seed, docs=3, n=120):
    rnd, rows, clock = random.Random(seed), [], 0
    for doc in range(docs):
        for seq in range(n):
            clock += rnd.choice([100, 400, 500, 3000])
            kind = rnd.choices(["edit", "undo", "redo"], [4, 4, 3])[0]
            client = rnd.choice(["a", "b", None])
            edits = (rnd.choice("xyz"), f"v{seq}") if kind == "edit" else (None, None)
            rows.append((doc, client, seq, clock, kind, *edits))
    return rows


def as_log(spark, rows):
    return spark.createDataFrame(rows, LOG.replace("ts timestamp", "ts long")).withColumn("ts", F.timestamp_millis("ts"))


def replayed(rows):
    """(doc, key) -> (value, seq), by a stack of steps to undo and one of steps to redo for each client."""
    undo, redo, last = defaultdict(list), defaultdict(list), {}
    for doc, client, seq, ts, kind, key, value in sorted(rows, key=lambda r: (r[0], r[2])):
        me = doc, client
        if kind == "edit":
            if me in last and ts - last[me] < 500:
                undo[me][-1].append((seq, key, value))
            else:
                undo[me].append([(seq, key, value)])
            redo[me].clear()
            last[me] = ts
            continue
        last.pop(me, None)
        source, target = (undo, redo) if kind == "undo" else (redo, undo)
        if source[me]:
            target[me].append(source[me].pop())
    out = {}
    for (doc, _), steps in undo.items():
        for seq, key, value in (w for step in steps for w in step):
            if (doc, key) not in out or out[doc, key][1] < seq:
                out[doc, key] = value, seq
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_state_equals_a_replay_with_stacks(spark, seed):
    rows = random_log(seed)
    log = as_log(spark, rows)
    for at in (None, 70):
        want = replayed([r for r in rows if at is None or r[2] <= at])
        assert {(r.doc_id, r.key): (r.value, r.seq) for r in U.state(log, at=at).collect()} == want


def test_a_new_edit_drops_what_could_be_redone(spark):
    kinds = ["edit", "edit", "undo", "undo", "undo", "redo", "edit", "redo", "undo"]
    rows = [(1, "a", i, i * 1000, k, "x" if k == "edit" else None, f"v{i}" if k == "edit" else None) for i, k in enumerate(kinds)]
    log = as_log(spark, rows)
    assert [tuple(r) for r in U.state(log).collect()] == [(1, "x", "v0", 0)]
    assert sorted((r.step, r.since, r.until) for r in U.validity(log).collect()) == [(1, 0, 3), (1, 5, None), (2, 1, 2), (7, 6, 8)]


def test_awkward_logs(spark):
    assert U.state(as_log(spark, [])).count() == 0
    rows = [(None, "a", 1, 0, "edit", "x", "1"), (1, "a", None, 0, "edit", "x", "1"), (1, "a", 2, 0, "other", "x", "1"), (1, None, 3, 0, "edit", None, None), (1, None, 3, 0, "edit", None, None)]
    assert [tuple(r) for r in U.state(as_log(spark, rows).withColumn("step", F.lit(0))).collect()] == [(1, None, None, 3)]


def texts(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def states(spark, *rows):
    return spark.createDataFrame(rows, "map_id long, user_id long, label string, encoded string")


def test_a_death_between_the_writes_leaves_the_old_state(spark, tmp_path):
    ledger = C.Ledger(spark, str(tmp_path / "ledger"))
    assert C.saved_by_hand(ledger, states(spark, (1, 5, "first", "YQ=="), (2, 5, None, "Yg=="))) == 1
    broken = states(spark, (1, 5, "second", "Yw==")).withColumn("label", F.raise_error(F.lit("killed")).cast("string"))
    with pytest.raises(Exception, match="killed"):
        C.saved_by_hand(ledger, broken)
    late = C.Ledger(spark, str(tmp_path / "ledger"))
    late._publish = lambda *_: (_ for _ in ()).throw(KeyboardInterrupt())  # all rows written, no manifest
    with pytest.raises(KeyboardInterrupt):
        C.saved_by_hand(late, states(spark, (1, 5, "third", "Yw==")))
    again = C.Ledger(spark, str(tmp_path / "ledger"))
    assert again.head() == 1
    assert texts(again.newest("current", ["map_id"]), "map_id", "encoded") == [(1, "YQ=="), (2, "Yg==")]
    assert texts(again.read("versions"), "map_id", "label", "size", "commit") == [(1, "first", 1, 1), (2, "Manual save 2", 1, 1)]
    assert C.saved_by_hand(again, states(spark, (1, 5, "third", "Yw=="))) == 2
    assert texts(again.newest("current", ["map_id"]), "map_id", "encoded") == [(1, "Yw=="), (2, "Yg==")]
    assert texts(again.newest("current", ["map_id"], 1), "map_id", "encoded") == [(1, "YQ=="), (2, "Yg==")]
    assert [(r.map_id, r.detail) for r in again.read("audit").where("commit = 2").collect()] == [(1, {"label": "third"})]


def test_of_two_writers_on_one_base_one_loses(spark, tmp_path):
    ledger = C.Ledger(spark, str(tmp_path / "ledger"))
    one = spark.createDataFrame([(1, "a")], "map_id long, encoded string")
    assert ledger.commit(0, current=one) == 1
    rival = spark.createDataFrame([(1, "b")], "map_id long, encoded string")
    with pytest.raises(C.Moved):
        ledger.commit(0, current=rival)
    with pytest.raises(ValueError, match="current has"):
        ledger.commit(1, current=rival.withColumn("more", F.lit(1)))
    assert texts(ledger.read("current"), "map_id", "encoded") == [(1, "a")]
    assert [f.name for f in (tmp_path / "ledger/commits").iterdir() if f.name.startswith("draft")] == []


def test_compaction_bounds_what_is_read(spark, tmp_path):
    ledger = C.Ledger(spark, str(tmp_path / "ledger"))
    for n in range(5):
        ledger.commit(n, current=spark.createDataFrame([(n % 2, f"v{n}")], "map_id long, encoded string"))
    ledger.compacted("current", ["map_id"])
    assert texts(ledger.read("current"), "map_id", "encoded", "commit") == [(0, "v4", 6), (1, "v3", 6)]
    assert len(ledger.manifest()["current"]["parts"]) == 1
    assert texts(ledger.newest("current", ["map_id"], 4), "map_id", "encoded") == [(0, "v2"), (1, "v3")]


def test_a_restore_is_one_commit(spark, tmp_path):
    ledger = C.Ledger(spark, str(tmp_path / "ledger"))
    C.saved_by_hand(ledger, states(spark, (1, 5, "now", "YQ=="), (2, 5, "same", "Yg=="), (3, 5, "kept", "Yw==")))
    versions = spark.sql("SELECT 10L AS id, 1L AS map_id, TIMESTAMP_NTZ'2024-01-02 03:04:05' AS created_at, 'Yg==' AS encoded UNION ALL SELECT 20, 2, TIMESTAMP_NTZ'2024-01-03 00:00:00', 'Yg=='")
    chosen = spark.createDataFrame([(1, 10, 7), (2, 20, 7), (3, 10, 7)], "map_id long, version_id long, user_id long")
    assert C.restored(ledger, versions, chosen) == 2
    assert texts(ledger.newest("current", ["map_id"]), "map_id", "encoded") == [(1, "Yg=="), (2, "Yg=="), (3, "Yw==")]
    assert texts(ledger.read("versions").where("commit = 2"), "map_id", "type", "encoded", "user_id") == [(1, "auto", "YQ==", 7), (1, "restore", "Yg==", 7), (2, "restore", "Yg==", 7)]
    assert sorted((r.map_id, r.action, r.detail["versionId"]) for r in ledger.read("audit").where("commit = 2").collect()) == [(1, "restore-version", "10"), (2, "restore-version", "20")]
