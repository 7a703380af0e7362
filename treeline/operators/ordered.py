"""Sums over everything before a row of its group, where one group may hold most rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Rounds


def group_starts(columns: list[pa.Array], before: tuple | None) -> np.ndarray:
    """Which rows differ from the row before them in ``columns``; ``before`` is what comes before the first, None for nothing."""
    starts = np.zeros(len(columns[0]), bool)
    for c in columns:
        codes = pc.fill_null(c.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        starts[1:] |= codes[1:] != codes[:-1]
    starts[0] = tuple(c[0].as_py() for c in columns) != before
    return starts


def _running(by: list[str], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in the order of a range, each value made the sum over the rows of its group that come before in the range."""
        before, carried = None, dict.fromkeys(names, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch[c] for c in by]
            begins = np.flatnonzero(group_starts(keys, before))
            out = {c: batch[c] for c in batch.schema.names}
            for c in names:
                value = batch[c].to_numpy(zero_copy_only=False)
                sums = carried[c] + np.cumsum(value) - value
                # what stands before a group begins does not count in it
                base = np.zeros(len(value), np.int64)
                base[begins] = np.diff(sums[begins], prepend=0)
                out[f"{c}_own"] = pa.array(sums - np.cumsum(base))
                carried[c] = int(out[f"{c}_own"][-1].as_py() + value[-1])
            before = tuple(c[-1].as_py() for c in keys)
            yield pa.RecordBatch.from_pydict(out)

    return run


def sums_before(rows: DataFrame, by: list[str], order: list[str], **values: Column) -> DataFrame:
    """``rows`` with columns ``values``, each the sum of an expression over the rows of the group ``by`` that come before in ``order``; 0 for the first.

    A window over the group would be one task for it. Here rows are sorted in ranges, a range sums its own, and what earlier ranges of
    a group hold is added: one row a range, for the group that goes on in the next. The order must be total, or rows alike may change places.
    """
    spark, names = rows.sparkSession, {name: f"__{name}" for name in values}
    # a null sum would hide later rows
    flat = rows.withColumns({names[n]: F.coalesce(v, F.lit(0)).cast("long") for n, v in values.items()})
    ranged = flat.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("__range", F.spark_partition_id())
    schema = T.StructType(list(ranged.schema.fields))
    for c in names.values():
        schema = schema.add(f"{c}_own", "long")
    # written once, since all uses must see the same ranges
    own = Rounds(spark)(ranged.mapInArrow(_running(by, list(names.values())), schema))
    key = F.struct(*by)
    ends = own.groupBy("__range").agg(F.min(key).alias("low"), F.max(key).alias("high"))
    on = ends.select("__range", F.explode(F.array("low", "high")).alias("__by")).distinct().groupBy("__by").count().where("count > 1").select("__by")
    # groups in several ranges, at most one a range and its next; written, so that their size is known
    on = Rounds(spark)(on.select(*(F.col(f"__by.{c}").alias(f"__by{i}") for i, c in enumerate(by))))
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    groups = [f"__by{i}" for i in range(len(by))]
    totals = own.join(on, same).groupBy(*groups, F.col("__range").alias("__at")).agg(*(F.sum(c).alias(f"{c}_all") for c in names.values()))
    earlier = Window.partitionBy(*groups).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    carried = Rounds(spark)(totals.select(*groups, "__at", *(F.coalesce(F.sum(f"{c}_all").over(earlier), F.lit(0)).alias(f"{c}_more") for c in names.values())))
    found = own.join(carried, same & (F.col("__range") == F.col("__at")), "left")
    return found.select(*rows.columns, *((F.col(f"{c}_own") + F.coalesce(F.col(f"{c}_more"), F.lit(0))).alias(n) for n, c in names.items()))
