"""Mixing sources to target weights by Sainte-Lague apportionment, with DataFrame functions only.

Targets come from weights by water filling; blocks of equally many words go to sources, and then
to each source's shards, by the highest quotients votes / (2 j - 1); inside a shard the blocks
are laid over its documents in a seeded order, twice over, and the first ones up to the
quota are taken. All quotas have a closed form around the fair share, so no step depends on
the number of blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import broadcast_if_small, checkpointed, quoted

WEIGHTS, SHARE, MOST_TIMES, SEED = (3, 1, 2), 1.5, 2, 20240601
#: Blocks that the smallest source has at least, where it has as many words; most words of a block.
LEAST_BLOCKS, MOST_BLOCK = 64, 256
#: Words in a shard, about: the unit that one window partition orders.
SHARD_WORDS = 1 << 20
_WORD = r"[^\x20\x09-\x0D]+"
#: Tables of at most so many rows may be broadcast.
_BROADCAST_SOURCES, _BROADCAST_ROWS = 10_000, 500_000
#: Copies of one row that one task writes out.
_TOGETHER = 1 << 16


def _level(total: Column, cap: Column, votes: Column, group: str) -> Column:
    """The level at which min(cap, level * votes) adds up to ``total`` in a group; null where all caps fall short."""
    filling = Window.partitionBy(group).orderBy((cap / votes).asc_nulls_last())
    everyone = Window.partitionBy(group)
    full = F.coalesce(F.sum(cap).over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum(votes).over(filling.rowsBetween(0, Window.unboundedFollowing))
    own = F.greatest((total - full) / left, F.lit(0.0))
    # right at the first unit that it leaves under its cap, lower at those behind it
    return F.max(F.when(cap / votes >= own, own)).over(everyone)


def apportion(units: DataFrame, group: str, seats: str, votes: str, cap: str, order: str, out: str) -> DataFrame:
    """``units`` with their seats in ``out``: the ``seats`` of a group by the highest quotients.

    The j-th seat of a unit has the quotient votes / (2 j - 1); no unit gets more than ``cap`` seats or seats
    without votes, and what caps leave over goes to the next quotients. At a level l, seats with a quotient of 1 / (2 l)
    at least are min(cap, l votes) a unit, give or take a half. So the levels that share out n / 2 seats less and
    more bound the last quotient, and only the seats between them are ranked, about three a unit; ties go to the
    unit first in ``order``. The windows run over a group's units.
    """
    everyone, inside = Window.partitionBy(group), Window.partitionBy("__group")
    fair = units.withColumns({"__group": F.col(group), "__votes": F.col(votes).cast("double"), "__cap": F.when(F.col(votes) > 0, F.greatest(F.col(cap), F.lit(0))).otherwise(0).cast("double")})
    fair = fair.withColumns({"__votes": F.when(F.col("__cap") > 0, F.col("__votes")), "__slack": F.count("*").over(everyone) / 2 + 1})
    low, high = (_level(F.col(seats) + sign * F.col("__slack"), F.col("__cap"), F.col("__votes"), "__group") for sign in (-1, 1))
    fair = fair.withColumns({"__low": low, "__high": high})
    at = lambda level: F.floor(F.coalesce(F.col(level) * F.col("__votes"), F.when(F.col("__votes").isNotNull(), F.col("__cap")), F.lit(0.0)) + 0.5)
    fair = fair.withColumn("__base", F.least(F.greatest(at("__low") - 1, F.lit(0)), F.col("__cap").cast("long")))
    fair = fair.withColumn("__open", F.col(seats) - F.sum("__base").over(inside))
    last = F.least(at("__high") + 1, F.col("__cap").cast("long"))
    # the j of a null sequence (none open) is null and ranks last
    tried = F.when(last > F.col("__base"), F.sequence(F.col("__base") + 1, last))
    each = fair.withColumn("__j", F.explode_outer(tried))
    quotient = F.col("__votes") / (2 * F.col("__j") - 1)
    ranked = each.withColumn("__rank", F.row_number().over(inside.orderBy(F.col("__j").isNull(), quotient.desc(), F.col(order).asc_nulls_last(), "__j")))
    won = F.sum(F.when(F.col("__j").isNotNull() & (F.col("__rank") <= F.col("__open")), 1).otherwise(0))
    return ranked.groupBy(*units.columns).agg((F.max("__base") + won).cast("long").alias(out))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most_times: float = MOST_TIMES) -> DataFrame:
    """(source, source_size, target, place) of every source of ``sizes`` (source, size).

    Sources in code-point order, null last, weigh ``weights`` in turn. Together they
    get ``share`` of all words; none gets more than ``most_times`` its own, and what is cut
    off is reshared by weight: target = min(cap, level * weight) for the one level that adds
    up. The windows run over one row a source.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    sources = sources.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    turn = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    sources = sources.withColumns({"weight": turn, "cap": F.col("source_size") * float(most_times)})
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    everyone = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sources = sources.withColumns({
        "__full": F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "__left": F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)),
        "__all": F.sum("source_size").over(everyone) * share,
    })
    sources = sources.withColumn("__level", (F.col("__all") - F.col("__full")) / F.col("__left"))
    level = F.min(F.when(F.col("cap") / F.col("weight") >= F.col("__level"), F.struct(F.col("cap") / F.col("weight"), "place", "__level"))).over(everyone)["__level"]
    target = F.least("cap", F.coalesce(level, F.col("cap") / F.col("weight")) * F.col("weight"))
    return sources.select("source", "source_size", target.alias("target"), "place")


def mixed(docs: DataFrame, block_words: int | None = None, shard_words: int = SHARD_WORDS, seed: int = SEED, weights=WEIGHTS, share: float = SHARE, most_times: int = MOST_TIMES) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, key, nth), one row per row of ``docs``.

    ``taken`` is the number of the document's words in the mix: its whole text so many
    times, then its first words once more. No document gives more than ``most_times`` its
    size. A source comes within half a block of its target, and a block less a shard where it
    takes all it may. Unless given, a block has 1/64 of the words of the smallest source that has
    any, at least 1 and at most 256, so that small sources meet their targets too.

    A null or blank text has size 0 and gives nothing; a null source is a source, last in order; a
    null doc_id counts as a document, ordered by its text. Rows that repeat are documents of their own; alike in id,
    source and size, they are counted before they are shuffled. The result
    depends on the rows and the seed alone. No rows give no rows; texts are whole, other columns are ignored.
    One row a source, and one a shard of a source, pass through one task, never documents. ``key`` and ``nth`` tell rows of
    one id apart.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    # rows alike in id, source and size are one unit of so many copies until the end
    rows = rows.select("doc_id", "source", size.alias("size"), _key().alias("key"))
    rows = checkpointed(rows.groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("copies")).withColumn("all", F.col("size") * F.col("copies")))
    sources = source_targets(rows.select("source", F.col("all").alias("size")), weights, share, most_times)
    everyone = Window.partitionBy("one")
    sources = sources.withColumn("one", F.lit(1))
    smallest = F.min(F.when(F.col("source_size") > 0, F.col("source_size"))).over(everyone)
    block = F.lit(block_words) if block_words else F.coalesce(F.greatest(F.lit(1), F.least(F.lit(MOST_BLOCK), F.floor(smallest / LEAST_BLOCKS))), F.lit(1))
    sources = sources.withColumn("block", block.cast("long")).withColumns({
        "blocks": F.round(F.sum("target").over(everyone) / F.col("block")).cast("long"),
        "cap": F.floor(F.col("source_size") * most_times / F.col("block")),
    })
    sources = apportion(sources, "one", "blocks", "target", "cap", "place", "source_blocks")
    shards = F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1))
    sources = checkpointed(sources.select("source", "source_size", "target", "place", "source_blocks", "block", shards.alias("n_shards")))
    by = broadcast_if_small(sources, _BROADCAST_SOURCES).withColumnRenamed("source", "__source")
    dealt = rows.join(by, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    dealt = dealt.withColumn("mark", F.md5(F.concat(F.lit(f"{seed}:"), "key").cast("binary")))
    dealt = dealt.withColumn("shard", F.conv(F.substring("mark", 1, 8), 16, 10).cast("long") % F.col("n_shards"))
    quotas = dealt.groupBy("place", "shard", "source_blocks", "block").agg(F.sum("all").cast("long").alias("words"))
    quotas = quotas.withColumn("cap", F.floor(F.col("words") * most_times / F.col("block")))
    quotas = apportion(quotas, "place", "source_blocks", "words", "cap", "shard", "quota").select("place", "shard", "words", "quota")
    dealt = dealt.join(quotas, ["place", "shard"])
    stream = Window.partitionBy("place", "shard").orderBy("mark", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = dealt.withColumns({"before": F.sum("all").over(stream) - F.col("all"), "q": F.col("quota") * F.col("block")})
    dealt = _copies(dealt, bool(rows.where(F.col("copies") > _TOGETHER).take(1)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("q") % F.col("words") - F.col("before") - F.col("nth") * F.col("size")))
    taken = F.when(F.col("words") > 0, F.floor(F.col("q") / F.col("words")) * F.col("size") + part).otherwise(0)
    return dealt.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "key", "nth")


def _key() -> Column:
    """What rows of documents (doc_id, text) are ordered by: the id, or the text where it is null."""
    return F.coalesce(F.col("doc_id").cast("long").cast("string"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))


def _copies(units: DataFrame, large: bool) -> DataFrame:
    """A row with its number ``nth``, from 0, for each of a unit's ``copies``; where some are ``large``, in several tasks."""
    if not large:
        return units.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    few, part = units.where(F.col("copies") <= _TOGETHER), F.sequence(F.lit(0).cast("long"), F.ceil(F.col("copies") / _TOGETHER) - 1)
    many = units.where(F.col("copies") > _TOGETHER).withColumn("part", F.explode(part))
    from_, to = F.col("part") * _TOGETHER, F.least(F.col("copies"), (F.col("part") + 1) * _TOGETHER) - 1
    many = many.repartition("mark", "part").withColumn("nth", F.explode(F.sequence(from_, to))).drop("part")
    return few.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).unionByName(many)


def mixed_documents(docs: DataFrame, broadcast_rows: int = _BROADCAST_ROWS, **options) -> DataFrame:
    """The texts of the mix, in the columns of ``docs``: whole copies, then a cut one.

    A document taken 1.4 times is a row with its text and a row with the first 40 % of its
    words, spacing kept; ``n_chars``, where there is one, is counted anew in cut rows. Rows that take
    nothing go, and all columns stay. Rows that share an id, source and size are numbered by their text.
    The plan is broadcast where it has at most ``broadcast_rows`` rows, else shuffled by id.
    """
    plan = checkpointed(mixed(docs, **options).select("key", "nth", "source", "size", "taken"))
    rows = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), _key().alias("key"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    if plan.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").take(1):
        # rows that share an id are told apart
        rows = rows.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long"))
        same = Window.partitionBy("key", "source", "size").orderBy(F.col("text").asc_nulls_last())
        of = F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))  # a null source is one too
        rows = rows.withColumns({"nth": (F.row_number().over(same) - 1).cast("long"), "of": of}).drop("source")
        chosen = plan.where("taken > 0").withColumn("of", of).drop("source")
        joined = rows.join(broadcast_if_small(chosen, broadcast_rows), ["key", "of", "size", "nth"])
    else:
        joined = rows.drop("source").join(broadcast_if_small(plan.where("taken > 0").drop("source", "nth"), broadcast_rows), "key")
    whole = F.floor(F.col("taken") / F.col("size")).cast("int")
    rest = (F.col("taken") % F.col("size")).cast("int")
    copies = F.concat(F.array_repeat(F.lit(-1), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    cut = joined.select("row", "text", F.explode(copies).alias("words"))
    # a piece is a word with the white space before it
    pieces = F.split(F.col("text"), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", -1)
    first = F.array_join(F.slice(pieces, F.lit(1), F.greatest("words", F.lit(1))), "")
    cut = cut.select("row", "words", F.when(F.col("words") < 0, F.col("text")).otherwise(first).alias("text"))

    def column(name: str) -> Column:
        own = F.col("row")[name]
        if name == "text":
            return F.col("text")
        if name == "n_chars":
            return F.when(F.col("words") < 0, own).otherwise(F.length("text").cast(docs.schema[name].dataType)).alias(name)
        return own.alias(name)

    return cut.select(*map(column, docs.columns))


#: The same over ``documents``, with every seat's quotient written out, for small tables.
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS mark FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
f AS (SELECT *, CAST([{', '.join(map(str, WEIGHTS))}][(place - 1) % {len(WEIGHTS)} + 1] AS DOUBLE) AS weight, source_size * {MOST_TIMES}::DOUBLE AS cap FROM s),
o AS (SELECT *, (sum(source_size) OVER () * {SHARE}::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
t AS (SELECT source, source_size, place, least(cap, weight * (SELECT arg_min(level, (cap / weight, place)) FROM o WHERE cap / weight >= level)) AS target FROM o),
k AS (SELECT CAST(coalesce(greatest(1, least({MOST_BLOCK}, floor(min(source_size) FILTER (source_size > 0) / {LEAST_BLOCKS}))), 1) AS BIGINT) AS block FROM s),
seat AS (SELECT place, unnest(range(1, CAST(floor(source_size * {MOST_TIMES} / (SELECT block FROM k)) AS BIGINT) + 1)) AS j, target FROM t WHERE target > 0),
won AS (SELECT place, count(*) AS quota FROM (SELECT place FROM seat QUALIFY row_number() OVER (ORDER BY target / (2 * j - 1) DESC, place, j) <= (SELECT round(sum(target) / (SELECT block FROM k)) FROM t)) GROUP BY place),
p AS (SELECT d.*, t.source_size, t.target, t.place, CAST('0x' || substr(mark, 1, 8) AS BIGINT) % CAST(greatest(ceil(t.source_size / {SHARD_WORDS}.0), 1) AS BIGINT) AS shard FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
h AS (SELECT place, shard, CAST(sum(size) AS BIGINT) AS words FROM p GROUP BY ALL),
hseat AS (SELECT place, shard, words, unnest(range(1, CAST(floor(words * {MOST_TIMES} / (SELECT block FROM k)) AS BIGINT) + 1)) AS j FROM h WHERE words > 0),
hwon AS (SELECT place, shard, count(*) AS quota FROM (SELECT x.place, x.shard, row_number() OVER (PARTITION BY x.place ORDER BY words / (2 * j - 1) DESC, x.shard, j) AS nth, quota FROM hseat x JOIN won USING (place)) WHERE nth <= quota GROUP BY ALL),
q AS (SELECT p.*, coalesce(hwon.quota, 0) * (SELECT block FROM k) AS quota, words, sum(size) OVER (PARTITION BY p.place, p.shard ORDER BY mark, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
  FROM p JOIN h ON h.place = p.place AND h.shard = p.shard LEFT JOIN hwon ON hwon.place = p.place AND hwon.shard = p.shard)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN words = 0 THEN 0 ELSE quota // words * size + greatest(0, least(size, quota % words - before)) END AS BIGINT) AS taken FROM q
"""
