"""Who comes and goes, as a stream: a leave ends a client's presence at once, silence ends it by a timer."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: The store that ``transformWithState`` needs.
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams started here keep their state in RocksDB; the session's own setting comes back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def _move(key: tuple, is_here: bool, at: int) -> Row:
    return Row(doc_id=key[0], client=key[1], here=is_here, at=at)


class _Client(StatefulProcessor):
    """One client of one document; its state is when it was last heard, and nothing while it is away."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.heard = handle.getValueState("heard", StructType([StructField("at", LongType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        last = self.heard.get()[0] if self.heard.exists() else None
        for row in sorted(rows, key=lambda r: (r.at, r.nth)):
            if last is not None and row.at - last > self.limit:
                yield _move(key, False, last + self.limit)
                last = None
            if row.kind != "leave":
                if last is None:
                    yield _move(key, True, row.at)
                last = row.at if last is None else max(last, row.at)
            elif last is not None:
                yield _move(key, False, row.at)
                last = None
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if last is None:
            self.heard.clear()
        else:
            self.heard.update((last,))
            # in milliseconds, never before the limit is over
            self.handle.registerTimer((last + self.limit) // 1000 + 1)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.heard.exists():
            yield _move(key, False, self.heard.get()[0] + self.limit)
            self.heard.clear()

    def close(self) -> None:
        pass


def attendance(stream: DataFrame, seconds: int = 10, late: str = "0 seconds") -> DataFrame:
    """(doc_id, client, here, at): when each client comes and goes, from (doc_id, client, kind, ts, nth).

    ``kind`` "leave" ends presence at ``ts``; any other kind begins or keeps it; silence of more than ``seconds`` ends it that long after the
    last sign. ``nth`` orders events of one time. A leave of a client that is not there changes nothing. Rows without a document, client, time or ``nth``
    are left out. The key is a document's client, so a crowded document is as many keys as it has clients; of a
    client only the events of one micro-batch are held. Start it within ``rocksdb``.
    """
    known = stream.where("doc_id IS NOT NULL AND client IS NOT NULL AND ts IS NOT NULL AND nth IS NOT NULL")
    timed = known.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    events = timed.select("doc_id", "client", F.coalesce("kind", F.lit("")).alias("kind"), "nth", F.unix_micros("ts").alias("at"), "ts")
    fields = ", ".join(f"{c} {events.schema[c].dataType.simpleString()}" for c in ("doc_id", "client"))
    moves = events.groupBy("doc_id", "client").transformWithState(_Client(seconds * 1_000_000), f"{fields}, here boolean, at long", "append", "eventTime")
    return moves.withColumn("at", F.timestamp_micros("at"))


def here(moves: DataFrame) -> DataFrame:
    """(doc_id, client, at): who is there at the end of ``attendance``'s rows, and since when."""
    last = moves.groupBy("doc_id", "client").agg(F.max_by("here", F.struct("at", "here")).alias("here"), F.max("at").alias("at"))
    return last.where("here").drop("here")
