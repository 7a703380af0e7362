"""Boilerplate lines by their frequency within a site, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import HOT, broadcast_if_small, checkpointed, met, quoted

#: A line on more than this share of a site's pages, and on at least so many of them, goes.
RATIO, LEAST_PAGES = 0.05, 3
#: A line is known by 64 + 32 bits of hashes; so many of all sites' lines may be broadcast.
_BROADCAST_LINES = 200_000
#: Lines that share a slot of a site's table, about.
_SLOT = 4


def _mark(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("h"), F.hash(line).alias("g"))


def boilerplate_lines(docs: DataFrame, host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(site, pages, n, slots): per site with boilerplate, the hashes of its lines on more than ``ratio`` of its pages.

    Only hashes leave the scan. A page counts once for a line; counts are combined map-side, so
    neither a hot site nor a hot line gathers in one task. A site's list has at most
    lines-per-page / ``ratio`` entries. They lie in slots by their hash, so that a line is looked up among
    a few, not among all: slot i of a table of k slots holds those whose hash is i modulo k.
    """
    lines = F.array_distinct(F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != ""))
    pages = docs.select(quoted(host).cast("string").alias("site"), F.col("text").cast("string").alias("text")).where("site IS NOT NULL")
    marks = pages.select("site", F.explode(F.transform(lines, _mark)).alias("mark"))
    on = marks.groupBy("site", "mark").agg(F.count("*").alias("on"))
    total = pages.groupBy("site").agg(F.count("*").alias("pages"))
    common = checkpointed(on.where(F.col("on") >= least_pages).join(total, "site").where(F.col("on") > F.lit(ratio) * F.col("pages")).select("site", "mark", "pages"))
    sites = common.groupBy("site").agg(F.first("pages").alias("pages"), F.count("*").alias("n"))
    sites = checkpointed(sites.withColumn("k", F.ceil(F.col("n") / _SLOT)))
    placed = common.select("site", "mark").join(sites.select("site", "k"), "site").select("site", F.pmod("mark.h", "k").alias("slot"), "mark")
    filled = placed.groupBy("site", "slot").agg(F.collect_list("mark").alias("marks"))
    slots = sites.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("slot")).join(filled, ["site", "slot"], "left")
    listed = slots.groupBy("site", "pages", "n").agg(F.array_sort(F.collect_list(F.struct("slot", "marks"))).alias("all"))
    return listed.select("site", "pages", "n", F.col("all.marks").alias("slots"))


def without_boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES, broadcast_lines: int = _BROADCAST_LINES, hot: int = HOT) -> DataFrame:
    """``docs`` with boilerplate lines cut from ``text``, plus ``n_lines`` and ``n_dropped``.

    A line's frequency is the number of the site's pages that contain it over the number of the
    site's pages; every occurrence of a line above ``ratio`` goes. Blank lines never count as
    boilerplate. Pages without a site keep all lines, a null text stays null (0 lines), a text
    all of whose lines go becomes empty, and rows that repeat count as pages of their own. Texts
    are whole, whatever their length.
    All columns of ``docs`` stay, but ``n_lines`` and ``n_dropped`` of its own, which give way; ``n_chars``, where there is one, is
    counted anew where lines went. No rows give no rows.

    The sites' lines are broadcast where they are at most ``broadcast_lines``; else pages meet them by
    site, and only the lines of sites with more than ``hot`` pages are broadcast.
    """
    listed = checkpointed(boilerplate_lines(docs, host, ratio, least_pages))
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(F.struct(*map(quoted, names)).alias("row"), quoted(host).cast("string").alias("site"), F.col("text").cast("string").alias("text"))
    if (listed.agg(F.sum("n")).first()[0] or 0) <= broadcast_lines:
        joined = rows.join(F.broadcast(listed.select("site", "slots")), "site", "left")
    else:
        most = listed.agg(F.max("pages")).first()[0]
        joined = met(rows, listed.select("site", "pages", "slots"), "site", "pages", most, hot, "left")
    split = F.split("text", "\n", -1)

    def stays(line: Column) -> Column:
        slot = F.get("slots", F.pmod(F.xxhash64(line), F.size("slots").cast("long")).cast("int"))
        return (F.trim(line) == "") | ~F.coalesce(F.array_contains(slot, _mark(line)), F.lit(False))

    kept = F.when(F.col("slots").isNull(), split).otherwise(F.filter(split, stays))
    cut = joined.select("row", "text", F.greatest(F.size(split), F.lit(0)).cast("long").alias("n_lines"), kept.alias("kept"))
    dropped = F.col("n_lines") - F.greatest(F.size("kept"), F.lit(0))
    cut = cut.select("row", F.array_join("kept", "\n").alias("text"), "n_lines", dropped.cast("long").alias("n_dropped"))

    def column(name: str) -> Column:
        own = F.col("row")[name]
        if name == "text":
            return F.col("text")
        if name == "n_chars":
            return F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema[name].dataType)).otherwise(own).alias(name)
        return own.alias(name)

    return cut.select(*map(column, names), "n_lines", "n_dropped")


#: The same over ``documents`` with ``source`` as the site.
ORACLE_SQL = f"""
WITH lines AS (SELECT doc_id, source, text, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM documents WHERE source IS NOT NULL),
total AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source),
common AS (SELECT l.source, list(l.line) AS bad FROM (SELECT source, line, count(*) AS c FROM lines WHERE trim(line) <> '' GROUP BY source, line) l
  JOIN total t ON t.source = l.source WHERE l.c >= {LEAST_PAGES} AND l.c > {RATIO} * t.n GROUP BY l.source),
cut AS (SELECT d.doc_id, string_split(d.text, chr(10)) AS every, coalesce(c.bad, []) AS bad FROM documents d LEFT JOIN common c ON c.source = d.source)
SELECT doc_id, array_to_string(list_filter(every, lambda x: NOT list_contains(bad, x)), chr(10)) AS text,
  CAST(coalesce(len(every), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(len(every), 0) - coalesce(len(list_filter(every, lambda x: NOT list_contains(bad, x))), 0) AS BIGINT) AS n_dropped
FROM cut
"""
