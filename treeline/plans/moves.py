"""Replaying logs of moves on trees that change with every move.

A move is refused if, at its moment, the node is its new parent or above it. Only nodes that are ever moved can change what
is above a node, so each tree is cut above them: its pieces, named by their topmost node, are all that a replay
looks at, however large the tree. Documents that lie whole in a block of sorted rows are cut and replayed there, nodes and moves together
(``blocks``). Of the others, those with few moves are replayed one after the other inside sorted partitions. In one with
many, all moves are tried at once, each climbing from piece to piece along the parents valid at its moment, under a guess of
which earlier ones were made. A verdict is right if the verdicts before it were guessed right, so guessing the last verdicts again for the moves
behind the first wrong one settles at the replay's, after as many rounds as refusals hang on each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Rounds, settled
from . import blocks
from .hierarchy import KEY
from .intervals import climbed

_LOG = ["doc_id", "seq", "id", "new_parent"]
#: Moves of a document that one task replays one by one.
SMALL = 100_000


def _stepwise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, seq, accepted) of rows (doc_id, seq, id, goal) sorted by document and moment; those without a moment place a piece."""
    doc, above = None, {}
    for batch in batches:
        docs, seqs, verdicts = [], [], []
        for row_doc, seq, node, goal in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row_doc != doc:
                doc, above = row_doc, {}
            if seq is None:
                above[node] = goal
                continue
            seen, at = set(), goal
            while at is not None and at != node and at not in seen:
                seen.add(at)
                at = above.get(at)
            if at is None:
                above[node] = goal
            docs.append(doc)
            seqs.append(seq)
            verdicts.append(at is None)
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(seqs, pa.int64()), pa.array(verdicts, pa.bool_())], names=["doc_id", "seq", "accepted"])


def _climbs(asked: DataFrame, versions: DataFrame) -> DataFrame:
    """(doc_id, seq, loops) of each of ``asked`` (doc_id, seq, id, goal): whether its way up from ``goal`` meets the node.

    ``versions`` (doc_id, at, since, above) has the piece above a piece from a moment on. A way that goes round, as only a
    wrong guess makes possible, counts as one that meets the node; it is noticed where it comes back to a mark that is set at every power of two steps.
    """
    ways = asked.select("doc_id", "seq", "id", F.col("goal").alias("at"), F.lit(None).cast("string").alias("mark"))
    done, turn, kept, ends = None, 0, Rounds(asked.sparkSession), Rounds(asked.sparkSession)
    while True:
        met = F.coalesce((F.col("at") == F.col("id")) | (F.col("at") == F.col("mark")), F.lit(False))
        ended = ways.where(met | F.col("at").isNull()).select("doc_id", "seq", met.alias("loops"))
        done = ends(ended if done is None else done.unionByName(ended))
        ways = ways.where(~met & F.col("at").isNotNull())
        if turn and not ways.take(1):
            return done
        turn += 1
        known = versions.select("doc_id", "at", F.col("since").alias("time"), F.lit(1).alias("kind"), F.struct("above").alias("version"))
        open_ = ways.select("doc_id", "at", F.col("seq").alias("time"), F.lit(0).alias("kind"), F.lit(None).cast("struct<above:string>").alias("version"), "seq", "id", "mark")
        # the version before a move's own moment; those of one piece lie together, those of a document do not
        before = Window.partitionBy("doc_id", "at").orderBy("time", "kind").rowsBetween(Window.unboundedPreceding, -1)
        both = open_.unionByName(known, allowMissingColumns=True).withColumn("found", F.last("version", ignorenulls=True).over(before)).where("kind = 0")
        mark = F.col("at") if turn & (turn - 1) == 0 else F.col("mark")
        ways = kept(both.select("doc_id", "seq", "id", F.col("found.above").alias("at"), mark.alias("mark")))


def _guessed(first: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc_id, seq, accepted) of ``asked`` (doc_id, seq, id, goal), all tried at once, again and again."""
    kept, trials, parents = (Rounds(asked.sparkSession) for _ in range(3))
    state = kept(asked.select("doc_id", "seq", "id", "goal", F.lit(True).alias("accepted"), F.lit(False).alias("sure")))
    while state.where("NOT sure").take(1):
        made = state.where("accepted").select("doc_id", F.col("id").alias("at"), F.col("seq").alias("since"), F.col("goal").alias("above"))
        loops = _climbs(state.where("NOT sure").drop("accepted", "sure"), parents(first.unionByName(made)))
        tried = trials(state.join(loops, ["doc_id", "seq"], "left").withColumn("verdict", F.coalesce(~F.col("loops"), F.col("accepted"))))
        wrong = tried.where("verdict <> accepted").groupBy("doc_id").agg(F.min("seq").alias("wrong"))
        sure = F.col("wrong").isNull() | (F.col("seq") <= F.col("wrong"))
        state = kept(tried.join(wrong, "doc_id", "left").select("doc_id", "seq", "id", "goal", F.col("verdict").alias("accepted"), sure.alias("sure")))
    return state.select("doc_id", "seq", "accepted")


def _pieces(cut: np.ndarray, largest: int) -> np.ndarray:
    """The topmost row above each row along the parents ``cut`` (-1: none); a row on or below a cycle stands for itself."""
    jump, top = cut.copy(), np.arange(len(cut))
    for _ in range(largest.bit_length() + 1):
        o = np.flatnonzero(jump >= 0)
        if not len(o):
            break
        j = jump[o]
        jump[o], top[o] = jump[j], top[j]
    return np.where(jump >= 0, np.arange(len(cut)), top)


def _replayed(table: pa.Table, small: int) -> Iterator[pa.RecordBatch]:
    """Rows of whole documents, nodes and then moves by moment, with ``accepted`` of each move and ``to_parent`` of each node, the last parent it got."""
    rows = table.combine_chunks()
    ids, ups, n = rows["id"].combine_chunks(), rows["up"].combine_chunks(), len(rows)
    is_move = rows["is_move"].to_numpy()
    docs = pc.fill_null(rows["doc_id"].combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    codes = pc.fill_null(pa.concat_arrays([ids, ups]).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    keys, named = docs * (2 * n) + codes[:n], docs * (2 * n) + codes[n:]
    nodes = np.flatnonzero(~is_move)
    order = nodes[np.argsort(keys[nodes], kind="stable")]
    ranked = keys[order]

    def row_of(key: np.ndarray, known: np.ndarray) -> np.ndarray:
        if not len(ranked):
            return np.full(n, -1)
        at = np.minimum(np.searchsorted(ranked, key), len(ranked) - 1)
        return np.where((ranked[at] == key) & known, order[at], -1)

    # an empty parent is none, an empty goal is an id like any other
    given = is_move | pc.fill_null(pc.not_equal(ups, ""), False).to_numpy(zero_copy_only=False)
    node, goal = row_of(keys, codes[:n] >= 0), row_of(named, given & (codes[n:] >= 0))
    odd = np.where(is_move, pc.is_null(rows["seq"].combine_chunks()).to_numpy(zero_copy_only=False), codes[:n] < 0)
    odd[order[np.flatnonzero(ranked[1:] == ranked[:-1])]] = True
    hard = np.bincount(docs, is_move) > small
    hard[docs[odd]] = hard[0] = True
    moved = np.zeros(n, bool)
    moved[node[is_move & (node >= 0)]] = True
    piece = _pieces(np.where(is_move | moved, -1, goal), int(np.bincount(docs).max()))
    asked = np.flatnonzero(is_move & (node >= 0) & (goal >= 0) & ~hard[docs])
    above, last, fine = np.where(moved & (goal >= 0), piece[goal], -1).tolist(), np.full(n, -1), np.zeros(n, bool)
    for move, what, parent, onto in zip(asked.tolist(), node[asked].tolist(), goal[asked].tolist(), piece[goal[asked]].tolist(), strict=True):
        seen, at = set(), onto
        while at >= 0 and at != what and at not in seen:
            seen.add(at)
            at = above[at]
        if at < 0:
            above[what], last[what], fine[move] = onto, parent, True
    made = {"hard": pa.array(hard[docs]), "accepted": pa.array(fine, mask=~is_move), "to_parent": ids.take(pa.array(last, mask=last < 0))}
    for start in range(0, n, 10_000):
        columns = {c: rows[c].combine_chunks().slice(start, 10_000) for c in rows.column_names}
        yield pa.RecordBatch.from_pydict(columns | {c: v.slice(start, 10_000) for c, v in made.items()})


_ROWS = ["doc_id", "seq", "is_move", "id", "up"]


def _near(nodes: DataFrame, moves: DataFrame, small: int) -> tuple[DataFrame, DataFrame | None]:
    """(known, rest): nodes and moves with (accepted, to_parent) where documents could be replayed whole; the rows of those left that have moves, or None."""
    rows = nodes.select("doc_id", F.lit(None).cast("long").alias("seq"), F.lit(False).alias("is_move"), "id", F.col("parent_id").alias("up"))
    rows = rows.unionByName(moves.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("seq").cast("long").alias("seq"), F.lit(True).alias("is_move"), "id", F.col("new_parent").alias("up")))
    names = {"accepted": pa.bool_(), "to_parent": pa.string()}
    on, known = F.col("doc_id").eqNullSafe(F.col("__doc")), None
    # those that a border cuts are few, and go once more without borders
    for ranged in (True, False):
        table, left = blocks.by_document(rows, ["doc_id", "seq", "id"], partial(_replayed, small=small), names, ranged=ranged)
        # without moves a document stays as it is, however large
        left = Rounds(nodes.sparkSession)(table.where("is_move").select("doc_id").join(left, on).select("__doc", "hard").distinct())
        shown = table.join(left.select("__doc"), on, "left_anti").select(*_ROWS, *names)
        known = shown if known is None else known.unionByName(shown)
        rows = table.join(left.select("__doc"), on, "left_semi").select(_ROWS)
        if not left.where("NOT hard").take(1):
            return known, rows if left.take(1) else None
    return known, rows


def _parted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, moves) of rows of ``_near``."""
    return rows.where("NOT is_move").select(*KEY, F.col("up").alias("parent_id")), rows.where("is_move").select("doc_id", "seq", "id", F.col("up").alias("new_parent"))


def judged(nodes: DataFrame, moves: DataFrame, small: int = SMALL) -> DataFrame:
    """``moves`` (doc_id, seq, id, new_parent) with ``accepted``, as a replay in the order of ``seq`` gives it.

    ``seq`` is unique in a document, the moves any number. A move is refused if it would make a cycle at its moment, or if one of
    its nodes does not exist. ``nodes`` (doc_id, id, parent_id) are the trees before the first move. No rows give no rows. Only
    documents with at most ``small`` moves are replayed one move after the other.
    """
    known, rest = _near(nodes, moves, small)
    found = known.where("is_move").select("doc_id", "seq", "id", F.col("up").alias("new_parent"), "accepted")
    return found if rest is None else found.unionByName(_judged(*_parted(rest), small))


def after(nodes: DataFrame, moves: DataFrame, small: int = SMALL) -> DataFrame:
    """(doc_id, id, parent_id) of ``nodes`` after all moves that ``judged`` accepts, without a join for the documents that are replayed whole."""
    known, rest = _near(nodes, moves, small)
    found = known.where("NOT is_move").select(*KEY, F.coalesce("to_parent", "up").alias("parent_id"))
    if rest is None:
        return found
    left, log = _parted(rest)
    return found.unionByName(replayed(left, _judged(left, log, small)))


def _judged(nodes: DataFrame, moves: DataFrame, small: int) -> DataFrame:
    """``judged`` for documents that are not replayed whole."""
    moves = settled(moves.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("seq").cast("long").alias("seq"), "id", "new_parent"))
    moved = settled(nodes.select(*KEY, "parent_id").join(moves.select(KEY).distinct(), KEY, "left_semi"))
    cut = nodes.select(*KEY, "parent_id").join(moved.select(*KEY, F.lit(True).alias("__cut")), KEY, "left")
    pieces = climbed(cut.withColumn("parent_id", F.when(F.col("__cut").isNull(), F.col("parent_id"))))
    pieces = pieces.select("doc_id", F.col("id").alias("new_parent"), F.coalesce("top", "id").alias("goal"))
    wanted = moves.select("doc_id", "new_parent").unionByName(moved.select("doc_id", F.col("parent_id").alias("new_parent"))).distinct()
    pieces = settled(pieces.join(wanted, ["doc_id", "new_parent"], "left_semi"))
    first = settled(moved.withColumnRenamed("parent_id", "new_parent").join(pieces, ["doc_id", "new_parent"], "left").select(*KEY, "goal"))
    asked = moves.join(moved.select(KEY), KEY, "left_semi").join(pieces, ["doc_id", "new_parent"]).select("doc_id", "seq", "id", "goal")
    asked = settled(asked.join(asked.groupBy("doc_id").agg((F.count("*") > small).alias("many")), "doc_id"))

    rows = first.join(asked.where("NOT many").select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.lit(None).cast("long").alias("seq"), "id", "goal")
    rows = rows.unionByName(asked.where("NOT many").drop("many"))
    verdicts = rows.repartition("doc_id").sortWithinPartitions("doc_id", "seq").mapInArrow(_stepwise, "doc_id long, seq long, accepted boolean")
    many = asked.where("many").drop("many")
    if many.take(1):
        versions = first.join(many.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.col("id").alias("at"), F.lit(-(1 << 63)).cast("long").alias("since"), F.col("goal").alias("above"))
        verdicts = verdicts.unionByName(_guessed(versions, many))
    return moves.join(verdicts, ["doc_id", "seq"], "left").select(*_LOG, F.coalesce("accepted", F.lit(False)).alias("accepted"))


def replayed(nodes: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``nodes`` after the accepted moves of ``judged``: each moved node below the last parent it got, aligned again."""
    last = verdicts.where("accepted").groupBy(KEY).agg(F.max_by("new_parent", "seq").alias("__parent"))
    found = nodes.join(last, KEY, "left")
    hit = F.col("__parent").isNotNull()
    changed = {"parent_id": F.coalesce("__parent", "parent_id")}
    if "auto_align" in nodes.columns:
        changed["auto_align"] = F.when(hit, True).otherwise(F.col("auto_align"))
    return found.withColumns(changed).select(nodes.columns)
