"""Edit streams: debounced saves, last-writer-wins state, presence and eviction, on file-based op logs.

Each has a batch twin in ``operators.relational``; over a finished log with ``availableNow`` both
give the same rows, except that what is still open at the watermark is not emitted yet. State lives in
Spark's state store, keyed and checkpointed in the shared folder; what a stream emits is written there as Parquet. No rows
gather on the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..operators.commits import Ledger
from ..operators.mutations import store
from ..operators.relational import quiet_groups
from ..session import removed, shared_folder


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A stream over a Parquet file or folder; the schema is the stored one's."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        # streams read folders: its own, and of that nothing else
        return reader.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())
    return reader.parquet(path)


def debounced(stream: DataFrame, key: str, time: str, gap: str, late: str = "0 seconds") -> DataFrame:
    """A streaming ``quiet_groups``: a row when a key has been silent for ``gap``."""
    zoned = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return quiet_groups(zoned, key, time, gap)


def _folder(spark: SparkSession) -> str:
    """A folder that goes when the session ends."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    removed(spark, folder, at_exit=True)
    return folder


def appended(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """What a stream that only appends emits over all that is there now, kept as Parquet in a shared folder."""
    folder = folder or _folder(stream.sparkSession)
    query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def committed(stream: DataFrame, ledger: Ledger, make: Callable[[DataFrame], dict[str, DataFrame]], checkpoint: str, states: dict[str, list[str]], every: str | None = None) -> StreamingQuery:
    """Each micro-batch as one commit over the relations that ``make`` gives for it: all of its rows are seen, or none.

    ``states`` names the relations whose rows replace earlier ones, with their keys; their parts are merged as they come together and
    commits before the last two deleted, so they cost what the state costs. A micro-batch that runs again after a death is not committed twice; a
    ledger belongs to one checkpoint, and one that starts anew beside later batches raises an error. Others may
    not write to the ledger meanwhile: the stream then fails with ``Moved``, and goes on when it is started again. Ends with what is there now, or goes on with a
    batch ``every`` so often until the query is stopped.
    """

    def save(batch: DataFrame, number: int) -> None:
        done = ledger.upto()
        if number < done:
            raise RuntimeError(f"{checkpoint} starts again at {number}, but {ledger.folder} has batch {done}")
        if number == done:
            return
        rows = make(batch)
        try:
            if len(rows) > 1:
                batch.persist()
            ledger.commit(ledger.head(), upto=number, **rows)
        finally:
            batch.unpersist()
        for name, keys in states.items():
            ledger.merged(name, keys)
        ledger.cleaned()

    return _started(stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint), every)


def _started(writer: DataStreamWriter, every: str | None) -> StreamingQuery:
    query = (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    if not every:
        query.awaitTermination()
    return query


def latest(stream: DataFrame, keys: list[str], folder: str | None = None) -> DataFrame:
    """The last row that a stream of changing rows emits for each key, over all that is there now.

    Each micro-batch commits only the rows it changed. With a ``folder`` the stream goes on where it stopped before.
    """
    spark, folder = stream.sparkSession, folder or _folder(stream.sparkSession)
    ledger = Ledger(spark, f"{folder}/ledger")
    committed(stream, ledger, lambda rows: {"rows": rows}, f"{folder}/checkpoint", {"rows": keys})
    # a stream without rows has committed nothing
    return ledger.newest("rows", keys) if ledger.head() else spark.createDataFrame([], stream.schema)


def merged_state(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """(doc_id, key, value, clock): the last-writer-wins state after a log stream (doc_id, clock, client, key, value).

    A keyed aggregation in the state store: a micro-batch reads and writes only the keys it touches, and replaying
    one changes nothing.
    """
    best = F.max_by(F.struct("value", "clock"), F.struct("clock", "client")).alias("w")
    state = stream.groupBy("doc_id", "key").agg(best).select("doc_id", "key", "w.value", "w.clock")
    return latest(state, ["doc_id", "key"], folder)


def last_seen(stream: DataFrame, key: str, time: str) -> DataFrame:
    """(key, last_updated): a running maximum per client."""
    return stream.groupBy(key).agg(F.max(time).alias("last_updated"))


def evicted(stream: DataFrame, seconds: int = 30) -> DataFrame:
    """(doc_id, evicted_at): documents that nobody has held for so long, from (doc_id, client, kind, ts, nth).

    ``kind`` is "join" or "leave", ``nth`` orders events of one time. When the last client leaves, a
    timer starts; a join stops it. A leave of a client that is not there changes nothing. The clients of a document are
    its state; a document without clients has none after its eviction.
    """

    def step(key: tuple, frames: Iterator, state) -> Iterator:
        import pandas as pd

        linger, out = pd.Timedelta(seconds=seconds), []
        clients, since = state.get if state.exists else ([], None)
        clients = set(clients)
        if state.hasTimedOut:
            out.append(since + linger)
            state.remove()
        else:
            events = pd.concat(list(frames)).sort_values(["ts", "nth"])
            for client, kind, ts in zip(events["client"], events["kind"], events["ts"], strict=True):
                if since is not None and ts - since >= linger:
                    out.append(since + linger)
                    since = None
                if kind == "join":
                    clients.add(client)
                    since = None
                elif client in clients:
                    clients.remove(client)
                    since = None if clients else ts
            if since is not None and (since + linger).timestamp() * 1000 <= state.getCurrentWatermarkMs():
                out.append(since + linger)
                since = None
            if clients or since is not None:
                state.update((sorted(clients), since))
                if since is not None:
                    state.setTimeoutTimestamp(int((since + linger).timestamp() * 1000))
            elif state.exists:
                state.remove()
        yield pd.DataFrame({"doc_id": [key[0]] * len(out), "evicted_at": pd.Series(out, dtype="datetime64[ns]")})

    zoned = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "0 seconds")
    return zoned.groupBy("doc_id").applyInPandasWithState(step, "doc_id long, evicted_at timestamp", "clients array<string>, since timestamp", "append", "EventTimeTimeout")


def saved(stream: DataFrame, history: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Appends each micro-batch's last write per document (doc_id, clock, value) to a history.

    A batch owns a partition that it overwrites, so a batch that runs again after a failure
    leaves the history as it was. The current state is ``current_state`` of the history. Ends with what is there now, or
    goes on with a batch ``every`` so often ("10 seconds") until the query is stopped.
    """

    def save(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("doc_id").agg(F.max("clock").alias("clock"), F.max_by("value", "clock").alias("value"))
        store(last.withColumn("batch", F.lit(number)), history, "batch")

    return _started(stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint), every)


def current_state(history: DataFrame) -> DataFrame:
    """(doc_id, clock, value): the newest version of each document."""
    return history.groupBy("doc_id").agg(F.max("clock").alias("clock"), F.max_by("value", "clock").alias("value"))
