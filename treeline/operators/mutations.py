"""Changes as DataFrame to DataFrame transformations, and sinks that store their results.

Nothing is updated in place: a changed relation is a new one, to be written beside the old.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import handles, payload_size
from .relational import latest_each


def updated(df: DataFrame, condition: Column, **values) -> DataFrame:
    """``df`` with columns set where a condition holds; null conditions change nothing."""
    hit = F.coalesce(condition, F.lit(False))
    return df.withColumns({c: F.when(hit, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def deleted(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(~F.coalesce(condition, F.lit(False)))


def all_read(notifications: DataFrame, user: int) -> DataFrame:
    return updated(notifications, (F.col("to_user") == user) & (F.col("read") == F.lit(False)), read=True)


def accepted(notifications: DataFrame, collaborators: DataFrame, default_role: str = "viewer") -> DataFrame:
    """The collaborators after all pending invitations are taken; who takes part already stays as is."""
    new = notifications.where("status = 'pending'").select("map_id", F.col("to_user").alias("user_id")).distinct()
    new = new.join(collaborators.select("map_id", "user_id"), ["map_id", "user_id"], "left_anti")
    return collaborators.select("map_id", "user_id", "role").unionByName(new.withColumn("role", F.lit(default_role)))


def removed_maps(maps: DataFrame, versions: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """(maps, versions) after maps go: those with a snapshot leave a backup version."""
    gone = maps.where(condition & F.col("snapshot").isNotNull())
    backup = gone.select(F.col("id").alias("map_id"), F.col("owner_id").alias("user_id"), F.lit("delete-backup").alias("type"), F.octet_length("snapshot").cast("long").alias("size"))
    return deleted(maps, condition), versions.select("map_id", "user_id", "type", "size").unionByName(backup)


def restore_plan(versions: DataFrame, live: DataFrame, chosen: DataFrame) -> DataFrame:
    """(map_id, step, type, label, encoded, size): what restoring a chosen version writes.

    ``versions`` (id, map_id, created_at, encoded), ``live`` states (map_id, encoded), ``chosen`` (map_id, version_id). A
    version that is not one of the map's is not found and writes nothing. The live state is backed up
    first where it is another state, then the chosen one becomes current, and the restore is recorded.
    """
    known = chosen.join(versions.select(F.col("id").alias("version_id"), "map_id", "created_at", F.col("encoded").alias("restored")), ["map_id", "version_id"])
    both = known.join(live.select("map_id", F.col("encoded").alias("now")), "map_id", "left")
    label = F.concat(F.lit("Restored from "), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))

    def row(step: int, kind: str, text: Column, state: Column) -> Column:
        return F.struct(F.lit(step).cast("long").alias("step"), F.lit(kind).alias("type"), text.alias("label"), state.alias("encoded"))

    differs = F.col("now").isNotNull() & (F.col("now") != F.col("restored"))
    backup = F.when(differs, row(1, "auto", F.lit("Auto-backup before restore"), F.col("now")))
    steps = F.array(backup, row(2, "current", F.lit(None).cast("string"), F.col("restored")), row(3, "restore", label, F.col("restored")))
    found = both.select("map_id", F.explode(F.filter(steps, lambda s: s.isNotNull())).alias("s")).select("map_id", "s.*")
    return found.withColumn("size", payload_size(F.col("encoded")))


def loaded_states(maps: DataFrame, versions: DataFrame) -> DataFrame:
    """(map_id, encoded, source): a map's own snapshot, else its newest version's; no row where there is neither."""
    newest = latest_each(versions.select("id", "map_id", "created_at", "encoded"), "map_id").select("map_id", F.col("encoded").alias("version_state"))
    found = maps.select(F.col("id").alias("map_id"), "snapshot").join(newest, "map_id", "left")
    own = F.col("snapshot").isNotNull()
    return found.where(own | F.col("version_state").isNotNull()).select("map_id", F.coalesce("snapshot", "version_state").alias("encoded"), F.when(own, "map").otherwise("version").alias("source"))


def autosaved(states: DataFrame, reason: str = "auto") -> DataFrame:
    """Version rows of document states (doc_id, encoded, node_count); empty documents are not saved."""
    return states.where("node_count > 0").select("doc_id", F.lit(reason).alias("type"), "encoded", payload_size(F.col("encoded")).alias("size"))


def audited(rows: DataFrame, action: str, **detail: Column) -> DataFrame:
    """Audit rows (map_id, user_id, action, detail) for rows (map_id, user_id)."""
    pairs = [x for name, value in detail.items() for x in (F.lit(name), value.cast("string"))]
    return rows.select("map_id", "user_id", F.lit(action).alias("action"), F.create_map(*pairs).alias("detail"))


def with_handles(edges: DataFrame, side: Column) -> DataFrame:
    source, target = handles(side)
    return edges.withColumns({"source_handle": source, "target_handle": target})


def replaced(current: DataFrame, restored: DataFrame, keys: list[str]) -> DataFrame:
    """The state after whole documents are replaced: other documents stay, restored rows stand instead."""
    return current.join(restored.select(keys).distinct(), keys, "left_anti").unionByName(restored)


def store(df: DataFrame, path: str, *by: str) -> None:
    """Appends, or with ``by`` replaces just the partitions that ``df`` has."""
    writer = df.write.mode("overwrite" if by else "append").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def upserted(df: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with ``rows`` in the place of those with the same keys, new ones added."""
    return df.join(rows.select(keys).distinct(), keys, "left_anti").unionByName(rows)


def spliced(edges: DataFrame, key: str, rows: DataFrame) -> DataFrame:
    """An ordered relation (ord) with rows replaced at their own places; others keep theirs."""
    places = edges.select(key, "ord")
    return edges.join(rows.select(key), key, "left_anti").unionByName(rows.drop("ord").join(places, key).select(edges.columns))


def loaded(documents: DataFrame, snapshots: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents with their stored state; one without a snapshot starts empty."""
    return documents.join(snapshots, key, "left").withColumn("state", F.coalesce("state", F.lit("")))


def manual_version(states: DataFrame, label: Column) -> DataFrame:
    """Version rows saved by hand, with the label or a default."""
    default = F.concat(F.lit("Manual save "), F.col("doc_id").cast("string"))
    return states.select("doc_id", F.lit("manual").alias("type"), F.when(label.isNull() | (label == ""), default).otherwise(label).alias("label"), payload_size(F.col("encoded")).alias("size"))
