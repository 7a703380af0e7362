"""Connected components as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import HOT, checkpointed, met


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, rounds: int = 60, hot: int = HOT) -> DataFrame:
    """(id, component) of every node of ``edges`` (a, b): the smallest id it can reach.

    Alternates large-star and small-star contractions, which end in a logarithmic number of
    rounds with one star per component. A round is two min-aggregations, combined map-side,
    and two joins on the node; links of a node with more than ``hot`` are joined where they lie, not in
    one task. Only a count and a fingerprint of the edges reach the driver. Self-links and null ends are ignored,
    repeated links count once, and no links give no rows.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct()
    edges = checkpointed(edges)
    state = _fingerprint(edges)
    for _ in range(rounds):
        if not state[0]:
            break
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("links")).select("a", F.least("a", "m").alias("m"), "links")
        most = 2 * state[0]
        joined = both.where("b > a")
        large = met(joined, least, "a", "links", most, hot).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = checkpointed(large) if most > hot else large
        # every link of ``large`` points from a larger to a smaller id
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("links"))
        small = met(large, least, "a", "links", most, hot)
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = checkpointed(small.unionAll(least.select("a", F.col("m").alias("b"))).distinct())
        before, state = state, _fingerprint(edges)
        if before == state:
            break
    else:
        raise RuntimeError("connected components did not settle")
    links = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return links.unionAll(links.select(F.col("component").alias("id"), "component")).distinct()
