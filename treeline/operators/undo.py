"""Undo and redo over edit logs: which writes stand after any mix of edits, undos and redos.

A log has (doc_id, client, seq, ts, kind, key, value); ``kind`` is "edit", "undo" or "redo", ``seq`` orders the log of a
document. Each client of a document has a history of its own, as an editor's session has. Edits less than ``gap`` apart
are one step, unless an undo or redo came between; undo takes back the newest step that stands, redo brings back the last one
taken back, a new edit drops what could be redone. An undo or redo with nothing to do changes nothing. A write that was taken
back lets the newest write of its key that still stands show through, whoever made it.

Rows without a document, a seq or a known kind are left out; a null client or key is one like any other; rows that share a
client's seq are taken in the order of kind, key and value. An empty log has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_OF = ["doc_id", "client"]


def numbered(log: DataFrame, gap: str = "500 milliseconds") -> DataFrame:
    """The log with ``step``, from 1 in each client's history."""
    known = log.where("doc_id IS NOT NULL AND seq IS NOT NULL AND kind IN ('edit', 'undo', 'redo')")
    mine = Window.partitionBy(_OF).orderBy("seq", "kind", "key", "value")
    before = F.lag(F.struct("kind", "ts")).over(mine)
    joins = (F.col("kind") == "edit") & (before["kind"] == "edit") & (F.col("ts") < before["ts"] + F.expr(f"INTERVAL {gap}"))
    starts = known.withColumn("starts", F.when(joins, 0).otherwise(1))
    return starts.withColumn("step", F.sum("starts").over(mine.rowsBetween(Window.unboundedPreceding, 0))).drop("starts")


def placed(steps: DataFrame) -> DataFrame:
    """Steps (doc_id, client, step, kind, seq) with ``slot``: the place in the client's history that each one fills, empties or fills again.

    A pass over sorted partitions that keeps two numbers: how many steps stand, and how many there are with those that can be
    redone. A history lies in one partition, as a person's session can; it is never gathered in memory.
    """

    def walk(batches: Iterator) -> Iterator:
        import pyarrow as pa

        stands = top = 0
        for batch in batches:
            out = []
            for kind, step in zip(batch["kind"].to_pylist(), batch["step"].to_pylist(), strict=True):
                if step == 1:
                    stands = top = 0
                slot = None
                if kind == "edit":
                    slot, stands = stands, stands + 1
                    top = stands
                elif kind == "undo" and stands:
                    slot = stands = stands - 1
                elif kind == "redo" and stands < top:
                    slot, stands = stands, stands + 1
                out.append(slot)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "slot"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in steps.schema)
    return steps.repartition(*_OF).sortWithinPartitions(*_OF, "step").mapInArrow(walk, f"{fields}, slot long")


def validity(log: DataFrame, gap: str = "500 milliseconds") -> DataFrame:
    """(doc_id, client, step, since, until): the stretches of seq in which each step of edits stands; ``until`` is null where it stands at the end."""
    return _validity(numbered(log, gap))


def _validity(numbered_log: DataFrame) -> DataFrame:
    steps = numbered_log.groupBy(*_OF, "step").agg(F.min("kind").alias("kind"), F.min("seq").alias("seq"))
    at_slot = Window.partitionBy(*_OF, "slot").orderBy("step")
    # in a slot, an edit or a redo is followed by an undo, and an undo by a redo or by a new edit
    turns = placed(steps).where("slot IS NOT NULL").withColumn("until", F.lead("seq").over(at_slot))
    owner = F.last(F.when(F.col("kind") == "edit", F.col("step")), ignorenulls=True).over(at_slot)
    return turns.withColumn("owner", owner).where("kind <> 'undo'").select(*_OF, F.col("owner").alias("step"), F.col("seq").alias("since"), "until")


def state(log: DataFrame, gap: str = "500 milliseconds", at: int | None = None) -> DataFrame:
    """(doc_id, key, value, seq): per key the newest write that stands at the end, or after all rows up to seq ``at``."""
    steps = numbered(log if at is None else log.where(F.col("seq") <= at), gap)
    standing = _validity(steps).where("until IS NULL").select(*(F.col(c).alias(f"_{c}") for c in (*_OF, "step")))
    same = (F.col("doc_id") == F.col("_doc_id")) & F.col("client").eqNullSafe(F.col("_client")) & (F.col("step") == F.col("_step"))
    writes = steps.where("kind = 'edit'").join(standing, same, "left_semi")
    best = F.max_by(F.struct("value", "seq"), F.struct("seq", "client", "value")).alias("w")
    return writes.groupBy("doc_id", "key").agg(best).select("doc_id", "key", "w.value", "w.seq")
