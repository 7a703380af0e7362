"""Trees of small documents resolved where they lie: rows are sorted by document in ranges, and a task walks the documents of a block at once.

Most documents are far smaller than a block, so one shuffle of the nodes takes the place of one for each round of jumps. Documents that a range
border cuts, that are larger than a block, or that repeat an id or have none are left to the jumps of ``intervals`` and ``hierarchy``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Rounds

#: Rows that a task walks at once, and the most that a document may have to be walked whole.
BLOCK = 1 << 17
#: Ids in the paths of one Arrow batch.
IDS = 1 << 20
#: Whether a row is asked for, by its level and the parent it names: an expression of two columns, of Spark or of Arrow.
Wanted = Callable[[Any, Any], Any]

_LABELS = {"top": pa.string(), "branch": pa.string(), "level": pa.int64(), "dangling": pa.bool_()}
_NUMBERS = {name: pa.int64() for name in ("first", "last", "leaf", "leaves", "children")}
_TYPES = {pa.string(): T.StringType(), pa.int64(): T.LongType(), pa.bool_(): T.BooleanType()}


def _parents(docs: np.ndarray, ids: pa.Array, ups: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each row's parent among the rows of its document, -1 for none; and which rows share their id with another or have none."""
    n = len(ids)
    codes = pc.fill_null(pa.concat_arrays([ids, ups]).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    keys, wanted = docs * (2 * n) + codes[:n], docs * (2 * n) + codes[n:]
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    at = np.minimum(np.searchsorted(ranked, wanted), n - 1)
    parent = np.where((ranked[at] == wanted) & (codes[n:] >= 0), order[at], -1)
    odd = codes[:n] < 0
    twice = np.flatnonzero(ranked[1:] == ranked[:-1])
    odd[order[twice]] = True
    return parent, odd


def _walked(docs: np.ndarray, parent: np.ndarray) -> dict[str, np.ndarray]:
    """What the jumps of ``intervals`` find, for rows in the order of (document, ord, id); ``open`` on and below cycles."""
    n = len(parent)
    jump, far, below, steps = parent.copy(), np.arange(n), np.full(n, -1), np.zeros(n, np.int64)
    inner = np.zeros(n, bool)
    inner[parent[parent >= 0]] = True
    size, leaves = np.ones(n, np.int64), (~inner).astype(np.int64)
    # a way of as many steps as the largest document has nodes goes round a cycle
    for _ in range(int(np.bincount(docs).max()).bit_length() + 1):
        o = np.flatnonzero(jump >= 0)
        if not len(o):
            break
        j = jump[o]
        more = [np.bincount(j, v[o], n).astype(np.int64) for v in (size, leaves)]
        new = jump[j], far[j], np.where(below[j] >= 0, below[j], far[o]), steps[o] + 1 + steps[j]
        jump[o], far[o], below[o], steps[o] = new
        size, leaves = size + more[0], leaves + more[1]
    loops = jump >= 0
    # siblings in the order of their rows, topmost nodes as siblings of a document
    group = np.where(parent >= 0, parent, n + docs)
    order = np.argsort(group, kind="stable")
    begins = np.flatnonzero(np.diff(group[order], prepend=-1))
    first, leaf = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for out, value in ((first, size), (leaf, leaves)):
        before = np.cumsum(np.where(loops, 0, value)[order]) - np.where(loops, 0, value)[order]
        out[order] = before - np.repeat(before[begins], np.diff(begins, append=n))
    first += parent >= 0
    jump = np.where(loops, -1, parent)
    while len(o := np.flatnonzero(jump >= 0)):
        j = jump[o]
        first[o], leaf[o], jump[o] = first[o] + first[j], leaf[o] + leaf[j], jump[j]
    children = np.bincount(parent[parent >= 0], minlength=n).astype(np.int64)
    return {"open": loops, "far": far, "below": below, "steps": steps, "first": first, "last": first + size - 1, "leaf": leaf, "leaves": leaves, "children": children}


def _paths(ids: pa.Array, parent: np.ndarray, found: dict[str, np.ndarray], start: int, stop: int) -> pa.Array:
    """The ids from the topmost node down to each of the rows from ``start`` to ``stop``."""
    loops = found["open"][start:stop]
    offsets = np.concatenate([[0], np.cumsum(np.where(loops, 0, found["steps"][start:stop] + 1))])
    spots, at, node = np.zeros(offsets[-1], np.int64), (offsets[1:] - 1)[~loops], np.arange(start, stop)[~loops]
    while len(node):
        spots[at] = node
        node = parent[node]
        at, node = (at - 1)[node >= 0], node[node >= 0]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), ids.take(pa.array(spots)), mask=pa.array(loops))


def _resolved(table: pa.Table, paths: bool) -> Iterator[pa.RecordBatch]:
    """The rows of whole documents with what ``intervals`` and ``hierarchy`` say of them."""
    rows = table.combine_chunks()
    ids, ups = rows["id"].combine_chunks(), rows["up"].combine_chunks()
    docs = pc.fill_null(rows["doc_id"].combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    parent, odd = _parents(docs, ids, ups)
    hard = np.zeros(docs.max() + 1, bool)
    hard[docs[odd]] = hard[0] = True
    found = _walked(docs, parent)
    far, steps, loops = found["far"], found["steps"], found["open"]
    lost = (pc.is_valid(ups).to_numpy(zero_copy_only=False) & (parent < 0))[far]
    named = lambda at: ids.take(pa.array(at, mask=loops))
    made = {"hard": pa.array(hard[docs])}
    if paths:
        made["dangling"] = pa.array(lost & ~loops)
        ends = np.cumsum(np.where(loops, 0, steps + 1))
    else:
        made |= {"top": named(far), "branch": named(np.where(lost | (steps == 0), far, found["below"])), "level": pa.array(steps + lost, mask=loops), "dangling": pa.array(lost, mask=loops)}
        made |= {name: pa.array(found[name], mask=loops) for name in _NUMBERS}
    start, size = 0, len(ids)
    while start < size:
        stop = min(size, start + 10_000)
        if paths:
            stop = max(start + 1, min(stop, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + IDS, "right"))))
        columns = {c: rows[c].combine_chunks().slice(start, stop - start) for c in rows.column_names}
        columns |= {c: v.slice(start, stop - start) for c, v in made.items()}
        if paths:
            columns["path"] = _paths(ids, parent, found, start, stop)
        yield pa.RecordBatch.from_pydict(columns)
        start = stop


def _unresolved(rows: pa.Table, names: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows of a document larger than a block."""
    for batch in rows.to_batches(max_chunksize=10_000):
        made = {"hard": pa.array(np.ones(len(batch), bool))} | {c: pa.nulls(len(batch), t) for c, t in names.items()}
        yield pa.RecordBatch.from_pydict(dict(zip(batch.schema.names, batch.columns, strict=True)) | made)


def _by_blocks(walk: Callable[[pa.Table], Iterator[pa.RecordBatch]], block: int, names: dict[str, pa.DataType], wanted: Wanted | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, large, ends = [], 0, None, []

        def shown(parts: list) -> Iterator[pa.RecordBatch]:
            """The rows that are wanted, and all of the documents that are left or that a border may cut: the first and the last."""
            for batch in chain.from_iterable(parts):
                if wanted is not None:
                    batch = batch.append_column("end", pc.is_in(batch["doc_id"], value_set=pa.array(ends, batch["doc_id"].type)))
                    batch = batch.filter(pc.field("hard") | pc.field("end") | wanted(pc.field("level"), pc.field("up")))
                yield batch

        def emitted(table: pa.Table, final: bool) -> tuple[list, pa.Table | None]:
            """What can be written, and the rows of the last document, which may go on."""
            nonlocal large
            docs = table["doc_id"].combine_chunks().dictionary_encode()
            codes = pc.fill_null(docs.indices, -1).to_numpy(zero_copy_only=False)
            out = []
            if large is not None:
                still = int(np.searchsorted(codes != codes[0], True)) if table["doc_id"][0] == large else 0
                if still:
                    out.append(_unresolved(table.slice(0, still), names))
                    table, codes = table.slice(still), codes[still:]
                if not len(codes):
                    return out, None
                large = None
            begin = int(np.flatnonzero(np.diff(codes, prepend=codes[0] - 1))[-1])
            if final:
                begin = len(codes)
            if begin:
                out.append(walk(table.slice(0, begin)))
            rest = table.slice(begin) if begin < len(codes) else None
            if rest is not None and len(rest) >= block:
                large = rest["doc_id"][0]
                out.append(_unresolved(rest, names))
                rest = None
            return out, rest

        for batch in batches:
            if batch.num_rows:
                if not ends:
                    ends.append(batch["doc_id"][0].as_py())
                held.append(batch)
                count += batch.num_rows
            if count >= block:
                out, rest = emitted(pa.Table.from_batches(held), False)
                yield from shown(out)
                held, count = (rest.to_batches(), len(rest)) if rest is not None else ([], 0)
        if held:
            ends.append(held[-1]["doc_id"][-1].as_py())
            out, _ = emitted(pa.Table.from_batches(held), True)
            yield from shown(out)

    return run


def by_document(rows: DataFrame, order: list[str], walk: Callable[[pa.Table], Iterator[pa.RecordBatch]], names: dict[str, pa.DataType], block: int | None = None, ranged: bool = True, wanted: Wanted | None = None) -> tuple[DataFrame, DataFrame]:
    """(table, left): ``rows`` with (hard, *names) as ``walk`` gives them for whole documents in ``order``, which begins with doc_id; and (__doc, hard) of the documents that are left.

    A border cuts those that are not ``hard``. Without ``ranged`` rows are sent by document and none is cut, which is for documents known to be few or small.
    Of documents walked whole only rows that are ``wanted`` by their level and parent are written, where that is given, and perhaps others.
    """
    sent = rows.repartitionByRange(*order) if ranged else rows.repartition("doc_id")
    sent = sent.sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    schema = T.StructType(sent.schema.fields + [T.StructField("hard", T.BooleanType())])
    for name, kind in names.items():
        schema = schema.add(name, T.ArrayType(T.StringType()) if name == "path" else _TYPES[kind])
    columns = [f.name for f in schema.fields]
    run = _by_blocks(walk, BLOCK if block is None else block, names, wanted)

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield batch.select(columns)

    table = Rounds(rows.sparkSession)(sent.mapInArrow(ordered, schema))
    # ranges cut at most one document a border
    border = table.groupBy("part").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    cut = border.select("part", F.explode(F.array("low", "high")).alias("doc_id")).distinct().groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(False).alias("hard"))
    hard = table.where("hard").select("doc_id", "hard").distinct()
    # written, so that its size is known
    return table, Rounds(rows.sparkSession)(cut.unionByName(hard).groupBy(F.col("doc_id").alias("__doc")).agg(F.max("hard").alias("hard")))


def resolved(nodes: DataFrame, paths: bool = False, keep: tuple[str, ...] = (), block: int | None = None, wanted: Wanted | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(known, rest): ``nodes`` (doc_id, id, parent_id, ord, perhaps ``keep``) whose documents could be walked whole, with what was found; the other rows, or None.

    Found are (path, dangling) as of ``hierarchy.rooted``, or (top, branch, level, dangling, first, last, leaf, leaves, children) as of
    ``intervals.numbered``. ``rest`` has the columns of ``nodes`` that are named here. Rows that are not ``wanted`` may be missing in ``known``, never in ``rest``.
    """
    # parent and order are there already
    keep = tuple(c for c in keep if c not in ("ord", "parent_id"))
    ord_ = F.col("ord") if "ord" in nodes.columns else F.lit(0).cast("long")
    rows = nodes.select("doc_id", "id", F.when(F.col("parent_id") != "", F.col("parent_id")).alias("up"), ord_.alias("ord"), *(F.col(c).alias(f"__{c}") for c in keep))
    names = {"path": pa.list_(pa.string()), "dangling": pa.bool_()} if paths else _LABELS | _NUMBERS
    table, left = by_document(rows, ["doc_id", "ord", "id"], partial(_resolved, paths=paths), names, block, wanted=wanted)
    on = F.col("doc_id").eqNullSafe(F.col("__doc"))
    shown = [*(F.col(f"__{c}").alias(c) for c in keep)]
    parent = F.col("up").alias("parent_id")
    known = table.join(left.select("__doc"), on, "left_anti").select("doc_id", "id", parent, "ord", *shown, *names)
    if not left.take(1):
        return table.select("doc_id", "id", parent, "ord", *shown, *names), None
    return known, table.join(left.select("__doc"), on, "left_semi").select("doc_id", "id", parent, "ord", *shown)
