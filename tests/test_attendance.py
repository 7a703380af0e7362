"""Presence by state and timers against a replay; the stream stops and goes on in between."""

import random

from pyspark.sql import functions as F

from treeline.streaming import attendance as A
from treeline.streaming import edits as E

VISITS = "doc_id long, client string, kind string, ts long, nth long"


def replayed(rows, limit, end):
    """(doc, client, here, at) of every coming and going that is known once the clock is past ``end``."""
    out, last = [], {}
    for doc, client, kind, ts, _ in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[3], r[4])):
        me = doc, client
        if me in last and ts - last[me] > limit:
            out.append((*me, False, last.pop(me) + limit))
        if kind != "leave":
            if me not in last:
                out.append((*me, True, ts))
            last[me] = ts
        elif me in last:
            del last[me]
            out.append((*me, False, ts))
    return sorted(out + [(*me, False, at + limit) for me, at in last.items() if at + limit < end])


def test_clients_come_leave_fall_silent_and_return_over_a_restart(spark, tmp_path):
    rnd, rows = random.Random(4), []
    for n in range(200):
        rows.append((rnd.randrange(2), rnd.choice(["a", "b", "c"]), rnd.choice(["move", "move", "leave", None]), n * 2 + rnd.randrange(2), n))
    rows.append((0, None, "move", 100, 500))
    path, folder = str(tmp_path / "visits"), str(tmp_path / "out")

    def arrive(part):
        spark.createDataFrame(part, VISITS).withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
        with A.rocksdb(spark):
            return E.appended(A.attendance(stream, 10), folder)

    arrive(rows[:70])
    found = arrive(rows[70:])
    moves = found.withColumn("at", F.unix_seconds("at"))
    assert sorted(tuple(r) for r in moves.collect()) == replayed(rows, 10, max(r[3] for r in rows))
    went = replayed(rows, 10, max(r[3] for r in rows))
    last = {(d, c): h for d, c, h, _ in sorted(went, key=lambda r: (r[3], r[2]))}
    assert {(r.doc_id, r.client) for r in A.here(found).collect()} == {k for k, h in last.items() if h}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) != A._ROCKSDB
