"""Packing documents into sequences along a space-filling curve.

A document's tokens are counted in hashed, signed buckets; a fixed random projection takes this vector, at length 1, to few
dimensions, whose cell on a fine grid has a place on the Hilbert curve. Documents are range-sorted by that
place, so neighbours in a sequence are alike, and laid end to end: a sequence ends at its full length and the document goes on in
the next one. What is left at the end of a sorted range becomes sequences of powers of two, so that nothing is padded.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix_tokens import _byte_of
from .shared import checkpointed, id_and_text, worker_cache
from .textnp import splitmix

VOCABULARY, LENGTH, END = "byte_bpe_50k.json", 1024, 0
#: Buckets of the hashed vectors, dimensions that they are projected to, bits of the grid along each.
BUCKETS, DIMENSIONS, BITS, SEED = 256, 4, 15, 20240607
#: Tokens that one task packs, about.
RANGE_TOKENS = 1 << 23


class Encoder:
    """The ids that the tokenizers library gives for one byte-level BPE file.

    Where ids follow the order of merges, and only then, ranks say all that the file says, and tiktoken finds the same ids in a fifth of the time.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary, added = spec["model"]["vocab"], {x["content"]: x["id"] for x in spec["added_tokens"]}
        merges = ("".join(x.split(" ") if isinstance(x, str) else x) for x in spec["model"]["merges"])
        made = [vocabulary[x] for x in merges]
        plain = (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not spec.get("normalizer") and not spec["model"].get("end_of_word_suffix")
        byte_of = _byte_of() if plain else {}
        ranks = {bytes(byte_of[c] for c in piece): number for piece, number in vocabulary.items() if piece not in added} if plain else {}
        self.slow = self.fast = None
        if plain and made == sorted(set(made)) and len(ranks) == 256 + len(made) and min(made) > max(ranks[bytes([b])] for b in range(256)):
            self.fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
            self.special = set(added)
        else:
            self.slow = tokenizers.Tokenizer.from_file(path)
        self.size = 1 + max(*vocabulary.values(), *added.values())

    def ids(self, text: str) -> np.ndarray:
        if self.fast:
            return self.fast.encode_to_numpy(text, allowed_special=self.special)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def encoder(path: str) -> Encoder:
    """The encoder of a file, made once a process."""
    known = worker_cache("curve_packing")
    if path not in known:
        known[path] = Encoder(path)
    return known[path]


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The places of cells (integers below 2**bits, a row a point) on the Hilbert curve.

    By Skilling's transposed axes (AIP Conference Proceedings 707, 2004), for all points at once: at each scale a
    point is mirrored or its axes swapped, then a Gray code is undone.
    """
    x = cells.astype(np.int64).T.copy()
    top = 1 << (bits - 1)
    scale = top
    while scale > 1:
        below = scale - 1
        for axis in range(len(x)):
            mirrored = (x[axis] & scale) > 0
            swapped = np.where(mirrored, 0, (x[0] ^ x[axis]) & below)
            x[0] ^= np.where(mirrored, below, swapped)
            x[axis] ^= swapped
        scale >>= 1
    for axis in range(1, len(x)):
        x[axis] ^= x[axis - 1]
    turned = np.zeros(x.shape[1], np.int64)
    scale = top
    while scale > 1:
        turned ^= np.where(x[-1] & scale, scale - 1, 0)
        scale >>= 1
    x ^= turned
    key = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            key = key << 1 | axis >> bit & 1
    return key


class Places:
    """Where documents lie on the curve, by their ids."""

    def __init__(self, vocabulary: int, buckets: int, dimensions: int, bits: int, seed: int):
        mixed = splitmix(np.arange(vocabulary, dtype=np.uint64) + np.uint64(seed))
        self.bucket = (mixed % np.uint64(buckets)).astype(np.int64)
        # byte-level vocabularies list frequent tokens first
        self.weight = np.where(mixed >> np.uint64(63), 1.0, -1.0) * np.sqrt(np.arange(vocabulary) + 1.0)
        across = np.random.default_rng(seed).standard_normal((buckets, dimensions))
        self.across, _ = np.linalg.qr(across)
        self.buckets, self.bits = buckets, bits

    def of(self, documents: list[np.ndarray]) -> np.ndarray:
        vectors = np.stack([np.bincount(self.bucket[x], weights=self.weight[x], minlength=self.buckets) for x in documents])
        size = np.linalg.norm(vectors, axis=1, keepdims=True)
        projected = (vectors / np.where(size > 0, size, 1)) @ self.across
        cells = np.clip(np.floor((projected + 1) * (1 << self.bits - 1)), 0, (1 << self.bits) - 1)
        return hilbert(cells, self.bits)


class _Packer:
    """Pieces of documents laid end to end into sequences; the open one is held until it is full."""

    def __init__(self, length: int, first: int):
        self.length, self.sequence, self.open, self.filled = length, first, [], 0
        self.done: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, whole in pieces:
            self.done.append((doc, start, len(ids), whole, self.sequence, offset, ids.astype("<u4").tobytes()))
            offset += len(ids)
        self.sequence += 1

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        start = 0
        while start < len(ids):
            taken = min(self.length - self.filled, len(ids) - start)
            self.open.append((doc, start, ids[start : start + taken], len(ids)))
            start, self.filled = start + taken, self.filled + taken
            if self.filled == self.length:
                self._close(self.open)
                self.open, self.filled = [], 0

    def finish(self) -> None:
        """The open sequence, cut into powers of two, the largest first."""
        rest, self.open = self.open[::-1], []
        while self.filled:
            size = left = 1 << self.filled.bit_length() - 1
            pieces = []
            while left:
                doc, start, ids, whole = rest.pop()
                pieces.append((doc, start, ids[:left], whole))
                if len(ids) > left:
                    rest.append((doc, start + left, ids[left:], whole))
                left -= len(pieces[-1][2])
            self._close(pieces)
            self.filled -= size

    def taken(self) -> pa.RecordBatch:
        columns = list(zip(*self.done, strict=True)) or [[]] * 7
        self.done = []
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])


def packed(docs: DataFrame, length: int = LENGTH, path: str | None = None, end: int = END, range_tokens: int = RANGE_TOKENS) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids): the pieces of all documents in sequences of at most ``length`` tokens.

    A document is its text's ids, without special tokens added, and then ``end``; each id is in exactly one piece. ``ids``
    are the piece's, as little-endian unsigned 32-bit integers; offsets in a sequence are gapless from 0. Sequences are full but for the last few of each
    sorted range of about ``range_tokens`` tokens, which are powers of two long; where ranges end can differ between runs, and with
    it the cuts, but never the order along the curve. Equal documents are neighbours, in the order of doc_id, and a group of copies of any size is
    dealt out over ranges. A null or empty text is ``end`` alone; a null doc_id stays null; repeated rows are documents each; texts are whole,
    whatever their length; no rows give no rows; other columns are ignored.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        places = Places(encode.size, BUCKETS, DIMENSIONS, BITS, SEED)
        narrow = "<u2" if max(encode.size, end + 1) <= 1 << 16 else "<u4"
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = [encode.ids(text.as_py() or "") for text in batch.column("text")]
            raw = [np.append(x, end).astype(narrow).tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(places.of(ids)), pa.array([len(x) + 1 for x in ids], pa.int64()), pa.array(raw, pa.binary()), pa.array([narrow] * len(ids))], names=["doc_id", "place", "tokens", "ids", "kind"])

    rows = checkpointed(id_and_text(docs).mapInArrow(encoded, "doc_id long, place long, tokens long, ids binary, kind string").withColumn("row", F.monotonically_increasing_id()))
    tokens = rows.agg(F.sum("tokens")).first()[0] or 0
    order = ["place", "doc_id", F.xxhash64("ids"), "row"]
    ranged = rows.repartitionByRange(max(1, -(-tokens // range_tokens)), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(length, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for doc, ids, kind in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), batch.column("kind").to_pylist(), strict=True):
                packer.add(doc, np.frombuffer(ids.as_py(), kind))
            yield packer.taken()
        packer.finish()
        yield packer.taken()

    return ranged.select("doc_id", "ids", "kind").mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def checksums(pieces: DataFrame) -> DataFrame:
    """``pieces`` with the crc32 of their ids in the ids' place."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
