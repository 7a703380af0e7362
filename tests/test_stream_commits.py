"""Streams that commit: micro-batches that run again, deaths in between, merged parts, polling."""

import random
import time

import pytest
from pyspark.sql import functions as F

from treeline.operators import commits as C
from treeline.streaming import edits as E

LOG = "doc_id long, clock long, client string, key string, value string"


def arrive(spark, path, rows):
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(path)


def replayed(rows):
    out = {}
    for doc, clock, client, key, value in rows:
        out[doc, key] = max(out.get((doc, key), (-1, "", "")), (clock, client, value))
    return sorted((*k, v[2], v[0]) for k, v in out.items())


def test_reading_costs_the_state_not_the_history(spark, tmp_path):
    rnd, path, rows = random.Random(3), str(tmp_path / "log"), []
    for n in range(10):
        part = [(rnd.randrange(3), n * 20 + i, "a", rnd.choice("xyz"), f"v{n}-{i}") for i in range(20)]
        rows += part
        arrive(spark, path, part)
    log = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(path)
    folder = str(tmp_path / "out")
    state = E.merged_state(log, folder)
    assert sorted(tuple(r) for r in state.collect()) == replayed(rows)
    ledger = C.Ledger(spark, f"{folder}/ledger")
    entry = ledger.manifest()["rows"]
    # ten parts: eight became one of the next size
    assert (entry["levels"], entry["upto"]) == ([1, 0, 0], 9)
    assert ledger.read("rows").count() <= 9 * 3
    assert len([f for f in (tmp_path / "out/ledger/commits").iterdir() if f.name.isdigit()]) == 2
    arrive(spark, path, [(9, 1, "b", "new", "late")])
    assert sorted(tuple(r) for r in E.merged_state(log, folder).collect()) == replayed(rows + [(9, 1, "b", "new", "late")])


def both(batch):
    last = batch.groupBy("doc_id").agg(F.max("clock").alias("clock"), F.max_by("value", "clock").alias("value"))
    return {"current": last, "versions": last}


def test_a_death_between_commit_and_checkpoint_commits_once(spark, tmp_path):
    path, ledger = str(tmp_path / "log"), C.Ledger(spark, str(tmp_path / "ledger"))
    arrive(spark, path, [(1, 1, "a", "x", "one"), (2, 1, "a", "x", "two")])
    log = spark.readStream.schema(LOG).parquet(path)
    clean = ledger.cleaned
    ledger.cleaned = lambda: (_ for _ in ()).throw(RuntimeError("dies"))  # committed, but the stream never hears of it
    with pytest.raises(Exception, match="dies"):
        E.committed(log, ledger, both, str(tmp_path / "checkpoint"), {"current": ["doc_id"]})
    ledger.cleaned = clean
    assert ledger.head() == 1
    arrive(spark, path, [(1, 2, "a", "x", "three")])
    E.committed(log, ledger, both, str(tmp_path / "checkpoint"), {"current": ["doc_id"]})
    assert ledger.head() == 2
    assert sorted((r.doc_id, r.value) for r in ledger.newest("current", ["doc_id"]).collect()) == [(1, "three"), (2, "two")]
    assert sorted((r.doc_id, r.value) for r in ledger.read("versions").collect()) == [(1, "one"), (1, "three"), (2, "two")]


def test_a_checkpoint_that_starts_anew_is_refused(spark, tmp_path):
    path, ledger = str(tmp_path / "log"), C.Ledger(spark, str(tmp_path / "ledger"))
    for n in range(2):
        arrive(spark, path, [(1, n, "a", "x", f"v{n}")])
        E.committed(spark.readStream.schema(LOG).parquet(path), ledger, both, str(tmp_path / "checkpoint"), {"current": ["doc_id"]})
    with pytest.raises(Exception, match="starts again at 0"):
        E.committed(spark.readStream.schema(LOG).parquet(path), ledger, both, str(tmp_path / "other"), {"current": ["doc_id"]})
    assert ledger.head() == 2


def test_polling_goes_on_until_it_is_stopped(spark, tmp_path):
    path, history = str(tmp_path / "log"), str(tmp_path / "history")
    arrive(spark, path, [(1, 1, "a", "x", "one")])
    query = E.saved(spark.readStream.schema(LOG).parquet(path), history, str(tmp_path / "checkpoint"), every="1 second")
    try:
        arrive(spark, path, [(1, 2, "a", "x", "two")])
        end = time.time() + 60
        while time.time() < end and not any(p["numInputRows"] for p in query.recentProgress[1:]) and sum(p["numInputRows"] for p in query.recentProgress) < 2:
            time.sleep(0.5)
        assert query.isActive
    finally:
        query.stop()
    assert [tuple(r) for r in E.current_state(spark.read.parquet(history)).collect()] == [(1, 2, "two")]


def test_a_file_is_read_without_its_neighbours(spark, tmp_path):
    for name in ("log.parquet", "log.parquet2"):
        arrive(spark, str(tmp_path / "made" / name), [(1, 1, "a", "x", name)])
        made = next((tmp_path / "made" / name).glob("*.parquet"))
        made.rename(tmp_path / name)
    rows = E.appended(E.read_log(spark, str(tmp_path / "log.parquet")))
    assert [r.value for r in rows.collect()] == ["log.parquet"]


def test_a_stream_without_rows(spark, tmp_path):
    arrive(spark, str(tmp_path / "log"), [])
    assert E.merged_state(E.read_log(spark, str(tmp_path / "log"))).count() == 0
