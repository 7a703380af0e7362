"""How a language's sources diverge in their words, by a two-pass vocabulary automaton.

The first pass adds up, in each task, in how many documents a language's terms are; the sums are exact document frequencies, and
terms in enough documents are kept. The second pass counts every occurrence of the kept terms with automata (Aho-Corasick), one a language, of terms padded with a
delimiter on both sides. Kept terms are numbered in their order and dealt out in shards of bounded size: a worker holds one shard's automata at a
time, and a shard passes over the texts of its languages only. One shard is the rule; a larger vocabulary takes more passes.

Counts become smoothed shares p, in billionths, and two groups compare by f = floor((p - q)^2 / q). Pairs of sources need f for
all kept terms, also those that neither has. They come from sparse postings: a term that only one has depends on its count alone, so
histograms of counts give these sums; terms that both have are met in blocks of terms; the rest is a number of equal addends.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import broadcast_if_small, checkpointed, small_batches, worker_cache

LEAST_DOCUMENTS, TOP, SCALE = 3, 200, 1_000_000_000
#: Characters of the padded terms in a shard, about (12 bytes of memory each); counts that a task holds at once.
SHARD, _HELD = 16 << 20, 1 << 20
#: Postings in a block of terms, at least and at most; between them as many as there are pairs of sources.
LEAST_BLOCK, MOST_BLOCK = 1 << 14, 1 << 20
#: Groups that may be broadcast.
_BROADCAST_GROUPS = 20_000
#: A-Z lower-cased, and a space for every ASCII character that is no letter.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    langs = batch.column("lang")
    for lang in pc.unique(langs).to_pylist():
        yield lang, batch.filter(pc.equal(langs, lang))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, documents) of the task's terms, once or more."""
    on: dict[str, Counter] = {}

    def listed() -> Iterator[pa.RecordBatch]:
        for lang, counts in on.items():
            terms = pa.array([x.decode() for x in counts], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), terms, pa.array(list(counts.values()), pa.int64())], names=["lang", "term", "documents"])
        on.clear()

    for batch in batches:
        for lang, rows in _by_lang(batch):
            counts = on.setdefault(lang, Counter())
            for text in rows.column("text").cast(pa.binary()):
                counts.update(set(text.as_py().translate(_TERMS).split()))
        if sum(map(len, on.values())) > _HELD:
            yield from listed()
    yield from listed()


class _Vocabulary:
    """One shard's terms, frequent ones first, and their numbers, by language."""

    def __init__(self, table: pa.Table):
        self.name, self.terms = uuid.uuid4().hex, {}
        table = table.sort_by([("documents", "descending"), ("number", "ascending")])
        for lang in pc.unique(table.column("lang")).to_pylist():
            own = table.filter(pc.equal(table.column("lang"), lang))
            self.terms[lang] = " ".join(own.column("term").to_pylist()), own.column("number").to_numpy()

    def automaton(self, lang: str) -> ahocorasick.Automaton:
        """Of a language's terms, made once a worker."""
        held = worker_cache("divergence")
        if held.get("name") != self.name:
            held.clear()
            held["name"] = self.name
        if lang not in held:
            made = ahocorasick.Automaton()
            for i, term in enumerate(self.terms[lang][0].split(" ")):
                made.add_word(f" {term} ", i)
            made.make_automaton()
            held[lang] = made
        return held[lang]


def _recounted(texts: DataFrame, shard: pa.Table) -> DataFrame:
    """(lang, source, number, n): all occurrences of a shard's terms, added up in each task."""
    shared = texts.sparkSession.sparkContext.broadcast(_Vocabulary(shard))
    langs = pc.unique(shard.column("lang")).to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], Counter] = {}

        def listed() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in found.items():
                at = np.fromiter(counts.keys(), np.int64, len(counts))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array([source] * len(at), pa.string()), pa.array(shared.value.terms[lang][1][at]), pa.array(list(counts.values()), pa.int64())], names=["lang", "source", "number", "n"])
            found.clear()

        for batch in batches:
            for lang, rows in _by_lang(batch):
                automaton = shared.value.automaton(lang)
                for source, text in zip(rows.column("source").to_pylist(), rows.column("text").cast(pa.binary()), strict=True):
                    # neighbours share the delimiter between them
                    padded = f" {text.as_py().translate(_TERMS).decode()} "
                    found.setdefault((lang, source), Counter()).update(map(itemgetter(1), automaton.iter(padded)))
            if sum(map(len, found.values())) > _HELD:
                yield from listed()
        yield from listed()

    return texts.where(F.col("lang").isin(langs)).mapInArrow(run, "lang string, source string, number long, n long")


def postings(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(lang, term, number) of the kept terms, and (lang, source, number, n, n_lang) of those that a source has.

    A term counts once for a row of ``docs`` (text, lang, source); null is ''. Numbers follow the order of (lang, term). Both tables are
    written. A shard has about ``shard`` characters; only one at a time is on the driver, and only of its terms.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    marks = texts.select("lang", "text").mapInArrow(_frequencies, "lang string, term string, documents long")
    kept = marks.groupBy("lang", "term").agg(F.sum("documents").alias("documents")).where(F.col("documents") >= least_documents)
    kept = checkpointed(kept)
    characters = kept.agg(F.sum(F.length("term") + 2)).first()[0] or 0
    ranges = max(16, 4 * -(-characters // shard))
    kept = kept.repartitionByRange(ranges, "lang", "term").sortWithinPartitions("lang", "term")
    kept = checkpointed(kept.withColumn("number", F.monotonically_increasing_id()))
    # consecutive ranges are a shard: a row a range
    sizes = kept.groupBy(F.shiftright("number", 33).alias("range")).agg(F.sum(F.length("term") + 2).alias("characters")).orderBy("range").collect()
    shards: list[list[int]] = []
    filled = shard
    for row in sizes:
        if filled + row.characters > shard:
            shards.append([row.range, row.range])
            filled = 0
        shards[-1][1], filled = row.range, filled + row.characters
    whole = [_recounted(texts, kept.where(F.shiftright("number", 33).between(*some)).toArrow()) for some in shards]
    nothing = kept.sparkSession.createDataFrame([], "lang string, source string, number long, n long")
    each = reduce(DataFrame.unionAll, whole, nothing).groupBy("lang", "source", "number").agg(F.sum("n").alias("n"))
    # a term has a row a source at most
    return kept.drop("documents"), checkpointed(each.withColumn("n_lang", F.sum("n").over(Window.partitionBy("number"))))


def _share(n: str | Column, total: str, scale: int) -> Column:
    """1 + floor(scale (n + 1) / total), whatever the counts."""
    n = F.col(n) if isinstance(n, str) else n
    small = n < (1 << 62) // scale
    inside = F.when(small, n).otherwise(0)
    quotient = lambda x, kind: F.call_function("div", (F.lit(scale).cast(kind) * (x + 1).cast(kind)), F.col(total).cast(kind))
    return (F.lit(1) + F.when(small, quotient(inside, "long")).otherwise(quotient(n, "decimal(38,0)"))).cast("long")


def _gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def _common(table: pa.Table) -> pa.Table:
    """(lang, a, b, value, common): what the block's terms that both sources have add beyond what each adds alone, and how many they are."""
    order = pc.sort_indices(table, sort_keys=[("source", "ascending")])
    table = table.take(order)
    names = table.column("source").combine_chunks().dictionary_encode()
    source = names.indices.to_numpy(zero_copy_only=False)
    _, term = np.unique(table.column("number").to_numpy(), return_inverse=True)
    p, none = table.column("p").to_numpy(), table.column("p_none").to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], source[1:] != source[:-1]]))
    stops = np.concatenate([starts[1:], [len(source)]])
    of = np.zeros(term.max() + 1, np.int64)
    a, b, value, common = [], [], [], []
    for i, (start, stop) in enumerate(zip(starts, stops, strict=True)):
        of[term[start:stop]] = p[start:stop]
        x, mine = of[term], none[start]
        both = x > 0
        both[start:stop] = False
        gain = np.where(both, (x - p) ** 2 // p - (x - none) ** 2 // none - (mine - p) ** 2 // p, 0)
        sums, numbers = np.add.reduceat(gain, starts), np.add.reduceat(both.astype(np.int64), starts)
        at = np.flatnonzero(numbers)
        a += [i] * len(at)
        b += at.tolist()
        value.append(sums[at])
        common.append(numbers[at])
        of[term[start:stop]] = 0
    named = names.dictionary.take(pa.array(source[starts]))
    lang = table.column("lang").combine_chunks().take(pa.array(np.zeros(len(a), np.int64)))
    return pa.table({"lang": lang, "a": named.take(pa.array(a, pa.int64())), "b": named.take(pa.array(b, pa.int64())), "value": pa.array(np.concatenate(value)), "common": pa.array(np.concatenate(common))})


def source_divergence(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP, scale: int = SCALE, shard: int = SHARD, least_block: int = LEAST_BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source of ``docs`` (text, lang, source) diverges from the others of its language.

    A language keeps the terms (runs of letters and non-ASCII characters, only A-Z lower-cased) in at least ``least_documents`` of its
    documents. With count occurrences of a kept term, N of all and V kept terms, p = 1 + floor(scale (count + 1) / (N + V)). Part "pair" has every
    other source of the language, its value f summed over all kept terms with the item's p as q; part "term" the ``top`` kept terms
    that the source has a larger p of than its language as a whole. Ranks go by value, descending, then by item in UTF-8 order.

    Null text, lang and source are ''; each row is a document, repeats too. A source without terms has pairs, a language with one source none; no
    kept terms give values of 0. Texts are whole, of any length; no rows give no rows; other columns are ignored.
    """
    kept, found = postings(docs, least_documents, shard)
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    sizes = found.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("own"))
    vocabulary = kept.groupBy("lang").agg(F.count("*").alias("v"))
    groups = groups.join(sizes, ["lang", "source"], "left").join(vocabulary, "lang", "left").na.fill(0, ["n", "own", "v"])
    groups = checkpointed(groups.withColumn("total", F.nullif(F.col("n") + F.col("v"), F.lit(0))))
    groups = groups.withColumn("p_none", _share(F.lit(0).cast("long"), "total", scale))
    langs = groups.groupBy("lang").agg((F.sum("n") + F.max("v")).alias("lang_total"), (F.count("*") * F.count("*")).alias("pairs"))
    known = checkpointed(groups.join(langs, "lang"))
    few = broadcast_if_small(known, _BROADCAST_GROUPS)

    placed = found.join(few.select("lang", "source", "total", "lang_total", "p_none", "pairs"), ["lang", "source"]).withColumn("p", _share("n", "total", scale))
    terms = placed.withColumn("q", _share("n_lang", "lang_total", scale)).where("p > q").select("lang", "source", "number", _gap(F.col("p"), F.col("q")).alias("value"))
    best = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "number"))
    terms = terms.withColumn("rank", best).where(F.col("rank") <= top).join(kept.select("number", "term"), "number")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")

    # terms that only one of two sources has: their p depends on the count alone
    counts = found.groupBy("lang", "source", "n").agg(F.count("*").alias("k"))
    counts = counts.join(few.select("lang", "source", "total"), ["lang", "source"]).withColumn("p", _share("n", "total", scale)).select("lang", F.col("source").alias("one"), "p", "k")
    met = counts.join(few.select("lang", F.col("source").alias("other"), F.col("p_none").alias("none")), "lang").where("one <> other")
    wide = "decimal(38,0)"
    sides = met.groupBy("lang", "one", "other").agg(F.sum((F.col("k") * _gap(F.col("p"), F.col("none"))).cast(wide)).alias("from_one"), F.sum((F.col("k") * _gap(F.col("none"), F.col("p"))).cast(wide)).alias("to_one"))
    alone = sides.select("lang", F.explode(F.array(F.struct(F.col("one").alias("a"), F.col("other").alias("b"), F.col("from_one").alias("value")), F.struct(F.col("other").alias("a"), F.col("one").alias("b"), F.col("to_one").alias("value")))).alias("x"))
    alone = alone.select("lang", "x.a", "x.b", "x.value", F.lit(0).cast("long").alias("common"))

    # terms that both have, block by block
    per_block = F.least(F.greatest(F.col("pairs"), F.lit(least_block)), F.lit(MOST_BLOCK))
    blocks = found.groupBy("lang").agg(F.count("*").alias("rows")).join(known.select("lang", "pairs").distinct(), "lang")
    blocks = broadcast_if_small(checkpointed(blocks.select("lang", F.ceil(F.col("rows") / per_block).alias("blocks"))), _BROADCAST_GROUPS)
    dealt = placed.join(blocks, "lang").select("lang", F.pmod(F.xxhash64("number"), "blocks").alias("block"), "number", "source", "p", "p_none")
    both = dealt.groupBy("lang", "block").applyInArrow(lambda _, table: _common(table), "lang string, a string, b string, value long, common long")
    both = both.select("lang", "a", "b", F.col("value").cast(wide).alias("value"), "common")

    pair = ["lang", "a", "b"]
    summed = alone.unionByName(both).groupBy(*pair).agg(F.sum("value").alias("value"), F.sum("common").alias("common"))
    one = few.select("lang", F.col("source").alias("a"), F.col("own").alias("own_a"), F.col("p_none").alias("p"), "v")
    two = few.select("lang", F.col("source").alias("b"), F.col("own").alias("own_b"), F.col("p_none").alias("q"))
    pairs = one.join(two, "lang").where("a <> b").join(summed, pair, "left")
    neither = F.col("v") - F.col("own_a") - F.col("own_b") + F.coalesce("common", F.lit(0))
    value = F.coalesce("value", F.lit(0).cast(wide)) + neither * F.coalesce(_gap(F.col("p"), F.col("q")), F.lit(0))
    pairs = pairs.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), value.cast("long").alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return pairs.withColumn("rank", rank).unionByName(terms)


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words FROM documents),
t AS (SELECT r, lang, source, unnest(words) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCUMENTS}),
g AS (SELECT DISTINCT lang, source FROM d), v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
n AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
c AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN n USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + {SCALE}::HUGEINT * (n + 1) // (sum(n) OVER (PARTITION BY lang, source) + v) AS p FROM c JOIN v USING (lang)),
q AS (SELECT lang, term, 1 + {SCALE}::HUGEINT * (n + 1) // (sum(n) OVER (PARTITION BY lang) + v) AS q FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term) JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every) WHERE part = 'pair' OR rank <= {TOP}
"""
