"""Sessions, and cutting the lineage of iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "treeline", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC timestamps; ``conf`` adds or overrides settings."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # checkpoints go when nothing refers to them any more
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only where none is set and all runs on this machine."""
    context, named = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return named or context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """``df`` in the reliable checkpoint folder of the session, so that loops do not nest plans."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def removed(spark: SparkSession, folder: str, at_exit: bool = False) -> None:
    """Deletes a folder in any store that Spark reads, now or when the session's store is closed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if at_exit:
        store.mkdirs(path)
        store.deleteOnExit(path)
    else:
        store.delete(path, True)


class Rounds:
    """The state of a loop, written as a table in the shared folder after each round; the one before goes.

    Unlike a checkpoint, a table read again has the size that it has: estimates do not multiply from round to round, and small states
    are broadcast. The last state stays until the session ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.done = spark, f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}", 0
        removed(spark, self.folder, at_exit=True)

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.done}"
        df.write.parquet(path)
        if self.done:
            removed(self.spark, f"{self.folder}/{self.done - 1}")
        self.done += 1
        return self.spark.read.schema(df.schema).parquet(path)
