"""Near-duplicate documents by ProbMinHash over weighted word shingles.

A document is the multiset of its five-word shingles; a shingle's weight is its number of
occurrences. Two documents are linked when their probability Jaccard similarity

    J_P(x, y) = sum over shared i of 1 / sum over all j of max(x_j / x_i, y_j / y_i)

is at least 0.8; with equal weights this is the ordinary Jaccard similarity. Each shingle emits a
Poisson process of arrivals at a rate equal to its weight, every arrival falling in a random
register; a register keeps the shingle that arrives first, so two signatures agree in a register
with probability J_P. A shingle is left as soon as its next arrival is later than the
latest register (early termination).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp
from .graph import connected_components
from .shared import HOT, broadcast_if_small, checkpointed, id_and_text, met, quoted, worker_cache

_U = np.uint64
SHINGLE_WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 28, 6
#: A pair goes to exact verification when its signatures agree in this share of registers, about
#: five standard deviations below the threshold.
ESTIMATE_MARGIN = 0.15
#: A bucket with more than so many open pairs a row is compared in blocks of so many rows. Where those are more than
#: ``_FURTHER``, so many further pivots come first, which cost a pass each and leave fewer rows apart.
_DENSE, _BLOCK, _FURTHER, _PIVOTS = 4, 512, 16, 2
#: Rows of a bucket that meet the few outside its largest component in one place.
_MEETING = 1 << 16
#: Pairs of one node that are verified in one place, about.
_PART = 128
_BROADCAST_IDS = 500_000
_PIECE_BYTES, _PIECE_ROWS = 1 << 20, 4096


def prob_minhash(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """Signatures (n, m) of n weighted sets given as rows (owner, element, weight) in owner order."""
    arrival, winner = np.full((n, m), np.inf), np.zeros(n * m, _U)
    flat, clock = arrival.reshape(-1), np.zeros(len(owner))
    live, turn = np.arange(len(owner)), 0
    while len(live):
        turn += 1
        bits = textnp.splitmix(element[live] ^ textnp.splitmix(np.full(1, turn, _U)))
        clock[live] -= np.log(((bits >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[live]
        whose = owner[live]
        first = np.ones(len(whose), bool)
        first[1:] = whose[1:] != whose[:-1]
        latest = arrival[whose[first]].max(axis=1)[np.cumsum(first) - 1]
        early = clock[live] < latest
        live = live[early]
        at = whose[early] * m + (textnp.splitmix(bits[early]) % _U(m)).astype(np.int64)
        when = clock[live]
        np.minimum.at(flat, at, when)
        won = flat[at] == when
        winner[at[won]] = element[live[won]]
    return winner.reshape(n, m)


def _signed(texts: pa.Array, k: int, bands: int, rows: int) -> Iterator[tuple]:
    raw, offsets = textnp.packed(texts)
    m = bands * rows
    for start, stop in textnp.pieces(offsets, _PIECE_BYTES, _PIECE_ROWS):
        part, at = raw[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
        hashes, counts = textnp.word_hashes(part, at)
        key_a, key_b = textnp.sequence_keys(hashes, counts)
        for i in np.flatnonzero(counts == 0):  # no words: only the same text is a copy
            digest = hashlib.blake2b(part[at[i] : at[i + 1]].tobytes(), digest_size=16).digest()
            key_a[i], key_b[i] = np.frombuffer(digest, _U)
        signature = prob_minhash(*textnp.weighted(*textnp.shingles(hashes, counts, k)), stop - start, m)
        grouped = signature.reshape(stop - start, bands, rows)
        band = np.tile(textnp.splitmix(np.arange(bands, dtype=_U) + _U(77)), (stop - start, 1))
        for r in range(rows):
            band = textnp.splitmix(band ^ grouped[:, :, r])
        sketch = (textnp.splitmix(signature) >> _U(56)).astype(np.uint8)
        yield start, stop, key_a, key_b, band, sketch, counts > 0


def signatures(docs: DataFrame, k: int = SHINGLE_WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, key_a, key_b, bands, sketch): word-sequence keys, band keys and one byte per register."""
    m = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("minhash")
        for batch in batches:
            for start, stop, key_a, key_b, band, sketch, worded in _signed(batch.column("text"), k, bands, rows):
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(worded * bands)]), pa.int32()),
                    pa.array(band[worded].reshape(-1).view(np.int64)),
                )
                sketches = pa.array([sketch[i].tobytes() for i in range(stop - start)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, stop - start), pa.array(key_a.view(np.int64)), pa.array(key_b.view(np.int64)), lists, sketches],
                    names=["doc_id", "key_a", "key_b", "bands", "sketch"],
                )

    assert m < 1 << 16
    narrow = id_and_text(docs)
    return narrow.mapInArrow(run, "doc_id long, key_a long, key_b long, bands array<long>, sketch binary")


def probability_jaccard(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """J_P of two weighted sets, each (sorted elements, counts)."""
    shared, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    if not len(shared):
        return 0.0
    xs, ys = x[1].astype(np.float64), y[1].astype(np.float64)
    ratio, total = xs[i] / ys[j], 0.0
    only_x, only_y = xs.sum() - xs[i].sum(), ys.sum() - ys[j].sum()
    for value in np.unique(ratio):
        scale = only_x + value * only_y + np.maximum(xs[i], value * ys[j]).sum()
        total += xs[i][ratio == value].sum() / scale
    return float(total)


def _sets(texts: pa.Array, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    raw, offsets = textnp.packed(texts)
    out = []
    for start, stop in textnp.pieces(offsets, _PIECE_BYTES, _PIECE_ROWS):
        part, at = raw[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
        owner, element, count = textnp.weighted(*textnp.shingles(*textnp.word_hashes(part, at), k))
        edges = np.searchsorted(owner, np.arange(stop - start + 1))
        out += [(element[a:b], count[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return out


def _alike(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sketches agree in at least the given share of registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sketch_a", "sketch_b"))
            yield batch.filter(pa.array((x == y).mean(axis=1) >= least)).select(["a", "b"])

    sketch = nodes.select("id", "sketch")
    both = pairs.join(sketch.select(F.col("id").alias("b"), F.col("sketch").alias("sketch_b")), "b")
    both = both.join(sketch.select(F.col("id").alias("a"), F.col("sketch").alias("sketch_a")), "a")
    return both.select("a", "b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, least: float, broadcast_ids: int) -> DataFrame:
    """The pairs (a, b) whose exact similarity reaches the threshold, with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x, y = _sets(part.column("text_a"), k), _sets(part.column("text_b"), k)
                score = pa.array([probability_jaccard(p, q) for p, q in zip(x, y, strict=True)], pa.float64())
                good = pa.array(np.asarray(score) >= least - 1e-12)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), score], names=["a", "b", "similarity"]).filter(good)

    # a node with many pairs is dealt out in parts, its own text to each of them
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / _PART).cast("int").alias("parts")).where("parts > 1")
    many = broadcast_if_small(checkpointed(many), broadcast_ids)
    parts = F.coalesce("parts", F.lit(1))
    both = pairs.join(many, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"))
    both = both.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    own = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")).join(many, "a", "left")
    own = own.select("a", "text_a", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    both = both.join(own, ["a", "part"])
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, similarity double")


def _mixed_buckets(members: DataFrame, component: DataFrame, most: int, hot: int) -> DataFrame:
    """The members (bucket, id, component, n, main, blocks) of buckets that lie in several components.

    ``n`` is the bucket's rows and ``main`` its largest component; ``blocks`` is 0 where the pairs across components are few for the rows.
    """
    placed = members.select("id", "bucket").join(component, "id", "left").select("id", "bucket", F.coalesce("component", "id").alias("component"))
    placed = checkpointed(placed) if most > hot else placed
    sizes = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("inside"), F.max(F.struct("n", "component"))["component"].alias("main"))
    across = (F.col("n") * F.col("n") - F.col("inside")) / 2
    blocks = F.when(across > _DENSE * F.col("n"), F.ceil(F.col("n") / _BLOCK)).otherwise(0)
    mixed = sizes.where(across > 0).select("bucket", "n", "main", blocks.alias("blocks"), F.col("n").alias("rows"))
    return checkpointed(met(placed, mixed, "bucket", "rows", most, hot))


def _few_pairs(placed: DataFrame) -> DataFrame:
    """The pairs (a, b) across components of buckets with few.

    Rows outside a bucket's largest component meet all its rows, which are at most twice the pairs
    wanted; the rows of a large bucket are dealt out in parts, the few to each.
    """
    parts = F.ceil(F.col("n") / _MEETING)
    outside = placed.where("component <> main").select("bucket", F.col("id").alias("x"), F.col("component").alias("in_x"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    every = placed.select("bucket", F.pmod(F.xxhash64("id"), parts).alias("part"), F.col("id").alias("y"), F.col("component").alias("in_y"))
    pairs = outside.join(every, ["bucket", "part"]).where("in_x <> in_y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _joining(ids: np.ndarray, components: np.ndarray, texts: pa.Array, k: int, least: float) -> list[tuple[int, int, float]]:
    """One link (a, b, similarity) for each two components that a pair of these rows joins."""
    sets, n = _sets(texts, k), len(ids)
    element, at = np.unique(np.concatenate([x[0] for x in sets]), return_inverse=True)
    row = np.repeat(np.arange(n), [len(x[0]) for x in sets])
    count = np.concatenate([x[1] for x in sets]).astype(np.float32)
    shared = np.bincount(at, minlength=len(element)) > 1
    column = np.cumsum(shared) - 1
    row, count, at = row[shared[at]], count[shared[at]], column[at[shared[at]]]
    order = np.argsort(at, kind="stable")
    row, count, at = row[order], count[order], at[order]
    both, mass = np.zeros((n, n), np.float32), np.zeros((n, n), np.float32)
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, 4096):
        here = slice(*np.searchsorted(at, [low, low + 4096]))
        weights = np.zeros((n, 4096), np.float32)
        weights[row[here], at[here] - low] = count[here]
        present = (weights > 0).astype(np.float32)
        both += present @ present.T
        mass += weights @ present.T
    size = np.array([x[1].sum() for x in sets], np.float64)
    plain = size == np.array([len(x[0]) for x in sets])
    score = both / np.maximum(size[:, None] + size[None, :] - both, 1)
    # J_P is at most the share of either document's weight that lies on shared shingles
    bound = np.minimum(mass / size[:, None], (mass / size[:, None]).T)
    easy = plain[:, None] & plain[None, :]
    apart = (components[:, None] != components[None, :]) & (ids[:, None] < ids[None, :])
    out: dict[tuple[int, int], tuple[int, int, float]] = {}
    for x, y in np.argwhere(apart & np.where(easy, score >= least - 1e-6, bound >= least - 1e-6)):
        joined = (min(components[x], components[y]), max(components[x], components[y]))
        if joined not in out and (exact := probability_jaccard(sets[x], sets[y])) >= least - 1e-12:
            out[joined] = (int(ids[x]), int(ids[y]), exact)
    return list(out.values())


def _block_links(placed: DataFrame, texts: DataFrame, k: int, least: float) -> DataFrame:
    """Links (a, b, similarity) across components in dense buckets, block against block."""

    def run(table: pa.Table) -> pa.Table:
        found = _joining(*(table.column(c).to_numpy() for c in ("id", "component")), table.column("text"), k, least)
        columns = zip(*found, strict=True) if found else ([], [], [])
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["a", "b", "similarity"])

    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    rows = placed.select("id", "component", "bucket", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("id", "component", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return rows.join(texts, "id").groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long, similarity double")


def near_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, hot: int = HOT, broadcast_ids: int = _BROADCAST_IDS) -> DataFrame:
    """(doc_id, class_id, kept): one row per row of ``docs`` (doc_id, text).

    ``class_id`` is the smallest doc_id that links of similarity >= ``similarity`` reach, and ``kept``
    marks that document.

    1. Signatures and keys of whole word sequences, one pass; copies with equal words share one node.
    2. Per band bucket, every node is verified against the smallest one, and the links are
       contracted to components. Groups of any size cost links in proportion to their size. Where
       very many pairs stay open, further pivots follow among the rows outside the largest component.
    3. Every pair of a bucket that still lies in two components is verified: one by one where a
       bucket has few such pairs for its rows, else block against block, with one matrix product
       for all pairs of two blocks, which gives one link for each two components it joins. So no
       two classes that a link joins stay apart, and no links are looked for inside a class.

    Texts of one to four words are one shingle. A null text is empty; texts without words
    are copies only of the same text. Rows with a null doc_id get a null class and are not kept.
    Rows that repeat a doc_id are one document, with the least of their texts, null last. Texts are whole, whatever their length. A pair of exactly
    ``similarity`` is linked. Other columns are ignored; no rows give no rows. No task gathers a bucket or a component
    with more than ``hot`` rows for a join; at most ``broadcast_ids`` ids are broadcast, more are shuffled.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    repeated = checkpointed(given.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if repeated.take(1):
        # one text an id, whatever the order of rows; an aggregation, as one id may have very many
        few = broadcast_if_small(repeated, broadcast_ids)
        least = given.join(few, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("text", F.struct(F.col("text").isNull(), "text")).alias("text"))
        once = given.join(few, "doc_id", "left_anti").unionByName(least)
        found = near_duplicates(once, k, similarity, bands, rows, hot, broadcast_ids)
        some = broadcast_if_small(checkpointed(found.join(few, "doc_id", "left_semi").withColumnRenamed("doc_id", "id")), broadcast_ids)
        copies = given.select("doc_id").join(some, F.col("doc_id") == F.col("id")).drop("id")
        return found.join(few, "doc_id", "left_anti").unionByName(copies)
    signed = checkpointed(signatures(given, k, bands, rows))
    nodes = signed.where("doc_id IS NOT NULL").groupBy("key_a", "key_b").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = checkpointed(nodes)
    most = nodes.count()  # a bucket holds a node once
    places = nodes.select("id", F.explode("bands").alias("bucket"))
    buckets = places.groupBy("bucket").agg(F.min("id").alias("pivot"), F.max("id").alias("last"), F.count("*").alias("rows")).where("pivot < last")
    members = checkpointed(met(places, buckets.drop("last"), "bucket", "rows", most, hot).distinct())
    documents = given.withColumnRenamed("doc_id", "id")

    def texts_of(ids: DataFrame) -> DataFrame:
        named = documents.join(broadcast_if_small(checkpointed(ids.distinct()), broadcast_ids), "id", "left_semi")
        return named.groupBy("id").agg(F.first("text").alias("text"))

    def links(pairs: DataFrame) -> DataFrame:
        close = checkpointed(_alike(pairs, nodes.select("id", "sketch"), similarity - ESTIMATE_MARGIN))
        return _verified(close, texts_of(close.select(F.explode(F.array("a", "b")).alias("id"))), k, similarity, broadcast_ids)

    tried = members.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    tried = checkpointed(tried)
    found = checkpointed(links(tried))
    for turn in range(_PIVOTS + 1):
        placed = _mixed_buckets(members, connected_components(found.select("a", "b"), hot=hot), most, hot)
        many = placed.where("blocks > 0")
        large = many.where(F.col("blocks") > _FURTHER)
        if turn == _PIVOTS or not large.take(1):
            break
        # another pivot: the smallest row outside the largest component, against the others outside it
        outside = large.where("component <> main")
        pivots = outside.groupBy("bucket").agg(F.min(F.struct("id", "component")).alias("p"), F.count("*").alias("rows"))
        pairs = met(outside, pivots, "bucket", "rows", most, hot).where("component <> p.component")
        pairs = pairs.select(F.col("p.id").alias("a"), F.col("id").alias("b")).distinct()
        pairs = checkpointed(pairs.join(tried, ["a", "b"], "left_anti"))
        tried = tried.unionAll(pairs)
        found = checkpointed(found.unionAll(links(pairs)))
    found = found.unionAll(links(_few_pairs(placed.where("blocks = 0")).join(tried, ["a", "b"], "left_anti")))
    if many.take(1):
        found = found.unionAll(_block_links(many, texts_of(many.select("id")), k, similarity))
    component = connected_components(found.select("a", "b"), hot=hot)
    node = nodes.select("key_a", "key_b", "id").join(component, "id", "left")
    node = node.select("key_a", "key_b", F.coalesce("component", "id").alias("class_id"))
    rows_out = signed.select("doc_id", "key_a", "key_b").join(node, ["key_a", "key_b"], "left")
    known = F.col("doc_id").isNotNull()
    return rows_out.select(
        "doc_id",
        F.when(known, F.col("class_id")).alias("class_id"),
        F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)).alias("kept"),
    )


def keep_one_of_each(docs: DataFrame, broadcast_ids: int = _BROADCAST_IDS, **options) -> DataFrame:
    """``docs`` without the documents of which ``near_duplicates`` keeps another one.

    All columns stay. Rows with a null doc_id stay; of rows that repeat a doc_id, the one with the least text stays, null
    last. Null and empty texts are one class; no rows give no rows.
    """
    dropped = near_duplicates(docs, broadcast_ids=broadcast_ids, **options).where("doc_id IS NOT NULL AND NOT kept").select("doc_id").distinct()
    dropped = broadcast_if_small(checkpointed(dropped), broadcast_ids)
    left = docs.join(dropped, "doc_id", "left_anti").select(docs.columns)
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    repeated = checkpointed(repeated)
    if not repeated.take(1):
        return left
    repeated = broadcast_if_small(repeated, broadcast_ids)
    # an aggregation, combined before the shuffle: one id may have very many rows
    row, order = F.struct(*map(quoted, docs.columns)), F.struct(F.col("text").isNull(), "text")
    least = left.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, order).alias("row"))
    return left.join(repeated, "doc_id", "left_anti").unionByName(least.select("row.*"))


#: All pairs over ``documents``, for small tables.
ORACLE_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) < {SHINGLE_WORDS} THEN list_filter([array_to_string(ws, ' ')], lambda x: x <> '')
  ELSE list_transform(range(1, len(ws) - {SHINGLE_WORDS - 2}), lambda i: array_to_string(ws[i:i + {SHINGLE_WORDS - 1}], ' ')) END) AS g FROM w),
c AS (SELECT doc_id, g, count(*) AS n FROM s GROUP BY ALL), z AS (SELECT doc_id, sum(n) AS n FROM c GROUP BY 1),
m AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(x.n) AS p, sum(y.n) AS q FROM c x JOIN c y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
near AS (SELECT a, b FROM m JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE p >= {SIMILARITY} * x.n - 1e-9 AND q >= {SIMILARITY} * y.n - 1e-9),
u AS (SELECT a, b, g, sum(n) FILTER (doc_id = a) AS x, sum(n) FILTER (doc_id = b) AS y FROM near JOIN c ON c.doc_id = a OR c.doc_id = b GROUP BY ALL),
v AS (SELECT i.a, i.b, i.g, 1 / sum(greatest(coalesce(k.x, 0) / i.x, coalesce(k.y, 0) / i.y)) AS part FROM u i JOIN u k ON k.a = i.a AND k.b = i.b WHERE i.x > 0 AND i.y > 0 GROUP BY ALL),
l AS (SELECT a, b FROM v GROUP BY ALL HAVING sum(part) >= {SIMILARITY} - 1e-9 UNION SELECT x.doc_id, y.doc_id FROM w x JOIN w y ON x.t = y.t AND x.doc_id < y.doc_id),
way AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(id, top) AS (SELECT doc_id, doc_id FROM documents UNION SELECT way.b, r.top FROM r JOIN way ON way.a = r.id)
SELECT id AS doc_id, min(top) AS class_id, id = min(top) AS kept FROM r GROUP BY id
"""
