"""Storage helpers shared by the iterative operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_caches: dict[str, dict] = {}
_running: list[str] = []


def worker_cache(operator: str) -> dict:
    """What an operator keeps in a Python worker between tasks, and only until another one runs there.

    Workers are reused by later stages; without this, each operator's memory would stay.
    """
    if _running != [operator]:
        _running[:] = [operator]
        for name, cache in _caches.items():
            if name != operator:
                cache.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library has it
            ctypes.CDLL(None).malloc_trim(0)
    return _caches.setdefault(operator, {})


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, where that path exists for them."""
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = [x for x in environment.get("PYTHONPATH", "").split(os.pathsep) if x]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *known])


#: Rows of an Arrow batch at most: texts can be long, and a batch is held on both sides.
_BATCH_ROWS = 1_000


def id_and_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of documents for a pass in Python, in small batches."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows of an Arrow batch, where they are more."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= _BATCH_ROWS:
        spark.conf.set(name, str(_BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only where none is set and all runs on this machine."""
    context, named = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return named or context.getCheckpointDir()


def removed(spark: SparkSession, folder: str, at_exit: bool = False) -> None:
    """Deletes a folder in any store that Spark reads, now or when the session's store is closed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if at_exit:
        store.mkdirs(path)
        store.deleteOnExit(path)
    else:
        store.delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the reliable checkpoint folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """``df``, marked for broadcast where it has at most so many rows.

    The rows are counted, so ``df`` should be checkpointed; a larger table keeps the planner's
    shuffled join, whose skewed partitions the adaptive planner can split.
    """
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


#: Rows of one key that a single task may read in ``met``.
HOT = 1 << 21


def met(rows: DataFrame, table: DataFrame, key: str, size: str, most: int, hot: int = HOT, how: str = "inner") -> DataFrame:
    """``rows`` joined, "inner" or "left", with the one row a key of ``table``, whose column ``size`` says how many rows have it.

    No key has more than ``most`` rows; where that is above ``hot``, keys with more than ``hot`` rows are at most one in ``hot`` rows: only they are broadcast, and their rows are joined
    where they lie, so that no task gathers a hot key; all others are shuffled.
    """
    if most <= hot:
        return rows.join(table.drop(size), key, how)
    table = checkpointed(table)
    large = table.where(F.col(size) > hot).drop(size)
    if not large.take(1):
        return rows.join(table.drop(size), key, how)
    rest = rows.join(F.broadcast(large.select(key)), key, "left_anti").join(table.drop(size), key, how)
    return rest.unionByName(rows.join(F.broadcast(large), key))


def quoted(name: str) -> Column:
    """The column of this very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")
