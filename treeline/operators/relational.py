"""Lookups, listings, counts and rankings over the domain's relations.

Joins leave the strategy to the planner: dimension sides are narrowed first, so small ones are
broadcast by their size and large ones shuffled. Rankings per key that only need the first row are aggregations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_key(df: DataFrame, key: str, value) -> DataFrame:
    """The row with a key, or none."""
    return df.where(F.col(key) == value).limit(1)


def first_match(df: DataFrame, condition: Column, order: str) -> DataFrame:
    """The first row in key order that meets a condition."""
    return df.where(condition).orderBy(order).limit(1)


def reachable(maps: DataFrame, collaborators: DataFrame) -> DataFrame:
    """(user_id, map_id, place): the maps of each user, once; place 0 owned, 1 edited, 2 viewed."""
    owned = maps.select(F.col("owner_id").alias("user_id"), F.col("id").alias("map_id"), F.lit(0).alias("place"))
    shared = collaborators.select("user_id", "map_id", F.when(F.col("role") == "editor", 1).otherwise(2).alias("place"))
    shared = shared.join(maps.select(F.col("id").alias("map_id")), "map_id", "left_semi")
    return owned.unionByName(shared).groupBy("user_id", "map_id").agg(F.min("place").alias("place"))


def listed_maps(maps: DataFrame, collaborators: DataFrame, users: DataFrame) -> DataFrame:
    """Every user's maps with bucket, owner and their place newest first, ties by id."""
    found = reachable(maps, collaborators).join(maps.select(F.col("id").alias("map_id"), "title", "updated_at", "owner_id"), "map_id")
    found = found.join(users.select(F.col("id").alias("owner_id"), F.col("name").alias("owner_name")), "owner_id", "left")
    newest = Window.partitionBy("user_id").orderBy(F.col("updated_at").desc_nulls_last(), "map_id")
    bucket = F.when(F.col("place") == 0, "my").otherwise("shared")
    return found.select("user_id", "map_id", "title", "updated_at", "owner_name", bucket.alias("bucket"), F.row_number().over(newest).cast("long").alias("recency"))


def access(maps: DataFrame, collaborators: DataFrame) -> DataFrame:
    """(user_id, map_id, read_role, write_role): owner and editor for both, viewer to read only."""
    role = F.element_at(F.array(F.lit("owner"), F.lit("editor"), F.lit("viewer")), F.col("place") + 1)
    found = reachable(maps, collaborators)
    return found.select("user_id", "map_id", role.alias("read_role"), F.when(F.col("place") < 2, role).alias("write_role"))


def populated(left: DataFrame, users: DataFrame, key: str, prefix: str) -> DataFrame:
    """``left`` with the name and email of the user in ``key``; rows without one stay."""
    found = users.select(F.col("id").alias("__id"), F.col("name").alias(f"{prefix}_name"), F.col("email").alias(f"{prefix}_email"))
    return left.join(found, F.col(key) == F.col("__id"), "left").drop("__id")


def newest(df: DataFrame, count: int, time: str = "created_at", key: str = "id") -> DataFrame:
    """The newest rows: one bounded heap a task, no full sort."""
    return df.orderBy(F.col(time).desc_nulls_last(), key).limit(count)


def latest_each(df: DataFrame, key: str, time: str = "created_at", tie: str = "id") -> DataFrame:
    """The latest row of every key, of equal times the one with the least ``tie`` of any type; a partial aggregation, no window."""
    kind = df.schema[time].dataType.typeName()
    age = {"date": F.datediff(F.lit("1970-01-01").cast("date"), time)}.get(kind, -F.col(time)) if not kind.startswith("timestamp") else F.timestamp_diff("MICROSECOND", F.col(time), F.lit("1970-01-01").cast(df.schema[time].dataType))
    rest = [c for c in df.columns if c != key]
    best = F.min_by(F.struct(*rest), F.struct(age.isNull(), age, F.col(tie))).alias("best")
    return df.groupBy(key).agg(best).select(key, *(f"best.{c}" for c in rest))


def guarded_invites(notifications: DataFrame, users: DataFrame, collaborators: DataFrame) -> DataFrame:
    """Invitations to existing users who do not take part in the map yet."""
    known = notifications.join(users.select(F.col("id").alias("to_user")), "to_user", "left_semi")
    return known.join(collaborators.select("map_id", F.col("user_id").alias("to_user")), ["map_id", "to_user"], "left_anti")


def orphans(versions: DataFrame, maps: DataFrame) -> DataFrame:
    """Versions of maps that no longer exist."""
    return versions.join(maps.select(F.col("id").alias("map_id")), "map_id", "left_anti")


def drop_targets(points: DataFrame, radius: float = 50.0, roots: DataFrame | None = None) -> DataFrame:
    """(id, target): the first other point, by id, nearer than ``radius``; none of the ``roots`` (id) is a target.

    Points meet through grid cells whose diagonal is under the radius. The least other id of
    a point's own cell is near for certain, so of the cells around only ids below that are candidates. A cell
    first gives up what no cell around can want, the ids from the greatest of those bounds on: a crowded cell, all of
    whose neighbours are crowded, keeps few. The first of all is an aggregation.
    """
    side = radius / 1.5
    cell = points.select("id", "x", "y", F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy"))
    goals = cell.join(roots.select("id"), "id", "left_anti") if roots is not None else cell
    first = goals.groupBy("cx", "cy").agg(F.min("id").alias("first"))
    second = goals.join(first, ["cx", "cy"]).where("id <> first").groupBy("cx", "cy").agg(F.min("id").alias("second"))
    sure = first.join(second, ["cx", "cy"], "left")
    bound = cell.join(sure, ["cx", "cy"], "left")
    most = F.lit((1 << 63) - 1)
    bound = bound.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), "cx", "cy", F.when(F.col("id") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("sure"))
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3) if (i, j) != (0, 0)))

    def spread(rows: DataFrame) -> DataFrame:
        moved = rows.withColumn("d", F.explode(around))
        return moved.withColumns({"cx": F.col("cx") + F.col("d.i"), "cy": F.col("cy") + F.col("d.j")}).drop("d")

    # the greatest bound of the cells around: nothing from it on is wanted
    wanted = spread(bound.groupBy("cx", "cy").agg(F.max(F.coalesce("sure", most)).alias("wanted"))).groupBy("cx", "cy").agg(F.max("wanted").alias("wanted"))
    candidates = goals.join(wanted, ["cx", "cy"]).where("id < wanted").drop("wanted")
    asked = spread(bound)
    dx, dy = F.col("x") - F.col("ax"), F.col("y") - F.col("ay")
    near = asked.join(candidates, ["cx", "cy"]).where((F.col("id") < F.coalesce("sure", most)) & (F.sqrt(dx * dx + dy * dy) < radius))
    found = near.select(F.col("a").alias("id"), F.col("id").alias("target")).unionAll(bound.where("sure IS NOT NULL").select("a", "sure"))
    return found.groupBy("id").agg(F.min("target").alias("target"))


def last_writes(log: DataFrame) -> DataFrame:
    """(doc_id, key, value, clock): per key the write of the highest (clock, client)."""
    best = F.max_by(F.struct("value", "clock"), F.struct("clock", "client")).alias("w")
    return log.groupBy("doc_id", "key").agg(best).select("doc_id", "key", "w.value", "w.clock")


def quiet_groups(events: DataFrame, key: str, time: str, gap: str) -> DataFrame:
    """(key, start, stop, n): runs of a key's events no further apart than ``gap``.

    ``stop`` is when the run ends, ``gap`` after its last event: a trailing debounce fires then.
    """
    window = F.session_window(time, gap)
    grouped = events.groupBy(key, window.alias("w")).agg(F.count("*").cast("long").alias("n"))
    return grouped.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def present(states: DataFrame, me: int, now: Column, limit_ms: int = 10_000) -> DataFrame:
    """Other clients not silent for longer than ``limit_ms``; one never seen, or at the epoch's start, counts as here.

    Where the states have a ``user``, clients without one are left out.
    """
    seen = F.col("last_updated") > F.lit("1970-01-01 00:00:00").cast(states.schema["last_updated"].dataType)
    silent = seen & (F.timestamp_diff("MICROSECOND", F.col("last_updated"), now) > limit_ms * 1000)
    here = states.where((F.col("client_id") != me) & ~F.coalesce(silent, F.lit(False)))
    return here.where("user IS NOT NULL") if "user" in states.columns else here
