"""Lists under concurrent edits: one order for one set of operations, whatever order they arrive in.

Operations are (doc_id, kind, id, after, clock, client, value). An "insert" names the element ``id`` that it makes and the one that
it follows, none for the start of the list; a "delete" names the element that it removes. What follows an element is a tree, and
the list is that tree depth first: of several elements behind one, the one with the highest clock comes first, then the
least client, then the least id. A client's clock must be higher than those of the elements it has seen. Deleted elements stay as tombstones, so
what follows them keeps its place.

Repeated operations count once; of insertions that share an id the one least in (clock, client, after, value) counts. Rows without a document, an id or a
known kind are left out; a null clock is before all others, a null client is one of its own. Elements behind one that has not arrived yet are not
listed until it has; ``waiting`` has them. Deletions of elements that have not arrived wait too. No operations give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tours import places
from ..session import Rounds
from .ordered import sums_before

_KEY = ["doc_id", "id"]


def _elements(ops: DataFrame) -> DataFrame:
    """(doc_id, id, after, value, ord, deleted), one an inserted element."""
    clock = F.coalesce("clock", F.lit(-(2**63)))
    rows = ops.where("kind IN ('insert', 'delete') AND doc_id IS NOT NULL AND id IS NOT NULL")
    least = F.min(F.when(F.col("kind") == "insert", F.struct(clock.alias("clock"), "client", F.coalesce("after", F.lit("")).alias("after"), "value")))
    made = rows.groupBy(_KEY).agg(least.alias("e"), F.bool_or(F.col("kind") == "delete").alias("deleted")).where("e IS NOT NULL")
    # the complement of a clock falls where it rises, and never overflows
    found = made.select(*_KEY, "e.after", "e.value", F.struct(F.bitwise_not("e.clock").alias("newest"), F.col("e.client").alias("client")).alias("ord"), "deleted")
    return Rounds(ops.sparkSession)(found)


def _placed(elements: DataFrame) -> DataFrame:
    return places(elements.select(*_KEY, F.col("after").alias("parent_id"), "ord"))


def placed(ops: DataFrame) -> DataFrame:
    """(doc_id, id, value, position, deleted): every element that has arrived with all it follows; ``position`` counts the elements before it that are not deleted."""
    elements = _elements(ops)
    marked = _placed(elements).join(elements.select(*_KEY, "value", "deleted"), _KEY).withColumn("first", -F.col("back")).drop("back")
    found = sums_before(marked, ["doc_id"], ["first"], position=F.when(F.col("deleted"), 0).otherwise(1))
    return found.select(*_KEY, "value", "position", "deleted")


def listed(ops: DataFrame) -> DataFrame:
    """(doc_id, position, id, value): the lists, from position 0."""
    return placed(ops).where("NOT deleted").select("doc_id", "position", "id", "value")


def waiting(ops: DataFrame) -> DataFrame:
    """(doc_id, id, after, value): elements behind one that has not arrived."""
    elements = _elements(ops)
    return elements.join(_placed(elements), _KEY, "left_anti").select(*_KEY, "after", "value")


def inserted_at(lists: DataFrame, rows: DataFrame) -> DataFrame:
    """Operations that insert ``rows`` (doc_id, index, id, clock, client, value) into ``lists`` (doc_id, position, id) as somebody sees them.

    An index past the end means the end. Rows at one index are concurrent: the highest clock comes first.
    """
    size = lists.groupBy("doc_id").agg(F.count("*").alias("__n"))
    at = rows.join(size, "doc_id", "left").withColumn("__at", F.least("index", F.coalesce("__n", F.lit(0))) - 1)
    there = lists.select("doc_id", F.col("position").alias("__at"), F.col("id").alias("after"))
    return at.join(there, ["doc_id", "__at"], "left").select("doc_id", F.lit("insert").alias("kind"), "id", "after", "clock", "client", "value")


def deleted_ranges(lists: DataFrame, ranges: DataFrame) -> DataFrame:
    """Operations that delete ``ranges`` (doc_id, start, count, clock, client) of ``lists`` as somebody sees them; what is past the end is not there to delete.

    Ranges meet positions by number, one row for each deleted place, so a long list is not compared with every range of its document.
    """
    size = lists.groupBy("doc_id").agg(F.count("*").alias("__n"))
    until = F.least(F.col("start") + F.col("count"), F.col("__n")) - 1
    begin = F.greatest("start", F.lit(0))
    each = ranges.join(size, "doc_id").where(until >= begin).select("doc_id", "clock", "client", F.explode(F.sequence(begin.cast("long"), until.cast("long"))).alias("position"))
    none = F.lit(None).cast("string")
    return each.join(lists.select("doc_id", "position", "id"), ["doc_id", "position"]).select("doc_id", F.lit("delete").alias("kind"), "id", none.alias("after"), "clock", "client", none.alias("value"))
