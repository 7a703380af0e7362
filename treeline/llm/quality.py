"""Document quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are its words and the trigrams of its byte shapes (case, digit, space, other script, each punctuation mark),
each hashed into buckets, and how much of its three-word sequences repeat. Square roots of the term
frequencies, weighted by their entropy over the labelled sample, are projected to a latent space
(truncated SVD); the labelled vectors are broadcast, and every document's exact cosines to all
of them are blocked matrix products. The nearest vote with their labels, weighted by similarity; of equally near
ones, those of the smaller doc_id.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp
from .shared import checkpointed, id_and_text, small_batches, worker_cache

_U = np.uint64
#: The fit's bounded sample of labelled rows, latent dimensions, voters, and power of their weights.
SAMPLE, DIMENSIONS, VOTERS, SHARPNESS = 4_000, 48, 25, 8.0
#: Buckets of shapes and of words; a term vector has both and two of repetition.
BUCKETS, WORDS, _EXTRA, _BLOCK = 1024, 2048, 2, 256
_PIECE_BYTES = 1 << 20
#: How long the words' part and the repetition's part of a term vector are, to the shapes' 1.
WORDS_WEIGHT, REPEATS_WEIGHT = 0.5, 0.7


def _shapes() -> np.ndarray:
    shape = np.arange(256, dtype=np.int64)
    shape[65:91], shape[97:123], shape[48:58], shape[128:] = 1, 2, 3, 4
    shape[[9, 11, 12, 13, 32]], shape[10] = 5, 6
    return shape


_SHAPE = _shapes()


def terms(texts: pa.Array) -> Iterator[np.ndarray]:
    """Blocks of term vectors (rows, BUCKETS + WORDS + 2), in row order; an empty text is all zeros."""
    raw, offsets = textnp.packed(texts)
    for start, stop in textnp.pieces(offsets, _PIECE_BYTES, _BLOCK):
        part, at = raw[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
        n, size = stop - start, np.diff(at)
        owner = np.repeat(np.arange(n), size)
        counts = np.zeros((n, BUCKETS))
        if len(part) > 2:
            shape = _SHAPE[part]
            gram = ((shape[:-2] << 16) | (shape[1:-1] << 8) | shape[2:]).astype(_U)
            bucket = (textnp.splitmix(gram) >> _U(54)).astype(np.int64)
            inside = owner[:-2] == owner[2:]
            counts += np.bincount((owner[:-2] * BUCKETS + bucket)[inside], minlength=n * BUCKETS).reshape(n, BUCKETS)
        hashes, words = textnp.word_hashes(part, at)
        bag = (hashes >> _U(53)).astype(np.int64) + np.repeat(np.arange(n), words) * WORDS
        lexical = np.bincount(bag, minlength=n * WORDS).reshape(n, WORDS)
        of, _, times = textnp.weighted(*textnp.shingles(hashes, words, 3))
        total, distinct = np.bincount(of, times, minlength=n), np.bincount(of, minlength=n)
        fresh = np.divide(distinct, total, out=np.ones(n), where=total > 0)
        vectors = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
        extra = REPEATS_WEIGHT * np.column_stack([np.sqrt(fresh), np.sqrt(1 - fresh)]) * (size > 0)[:, None]
        lexical = WORDS_WEIGHT * np.sqrt(lexical / np.maximum(words, 1)[:, None])
        yield np.hstack([vectors, lexical, extra]).astype(np.float32)


def _leading(rows: np.ndarray, dimensions: int) -> np.ndarray:
    """The leading right singular vectors of a matrix, by seeded subspace iteration."""
    size = min(dimensions + 16, rows.shape[1])
    basis = np.random.default_rng(1).standard_normal((rows.shape[1], size)).astype(rows.dtype)
    for _ in range(8):
        basis, _ = np.linalg.qr(rows.T @ (rows @ basis))
    image = (rows @ basis).astype(np.float64)
    values, turned = np.linalg.eigh(image.T @ image)
    return basis @ turned[:, np.argsort(-values)[:dimensions]]


class Voters:
    """The fitted model: term weights, latent axes, and the labelled vectors."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS):
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        share = vectors**2 / np.maximum((vectors**2).sum(axis=0, keepdims=True), 1e-12)
        entropy = -(share * np.log(np.maximum(share, 1e-12))).sum(axis=0) / np.log(max(len(vectors), 2))
        self.weights = np.clip(1.2 - entropy, 0.05, None).astype(np.float32)
        self.weights[-_EXTRA:] = 1
        self.axes = _leading(vectors * self.weights, dimensions).astype(np.float32)
        self.nearby = self.latent(vectors)

    def latent(self, vectors: np.ndarray) -> np.ndarray:
        projected = (vectors * self.weights) @ self.axes
        return projected / np.maximum(np.linalg.norm(projected, axis=1, keepdims=True), 1e-12)

    def scores(self, vectors: np.ndarray, voters: int = VOTERS, sharpness: float = SHARPNESS) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(vectors), self.prior)
        cosine = self.latent(vectors) @ self.nearby.T
        k = min(voters, cosine.shape[1])
        last = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k]
        # of those as near as the last, the first ones
        level = cosine == last
        chosen = (cosine > last) | level & (np.cumsum(level, axis=1) <= k - (cosine > last).sum(axis=1, keepdims=True))
        i, j = np.nonzero(chosen)  # k of each row
        nearest = j.reshape(-1, k)
        weight = np.maximum(cosine[i, j].reshape(-1, k), 0).astype(np.float64) ** sharpness
        total = weight.sum(axis=1)
        voted = (weight * self.labels[nearest]).sum(axis=1)
        return np.clip(np.divide(voted, total, out=np.full(len(vectors), self.prior), where=total > 1e-9), 0, 1)


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, held_out: bool = True) -> Voters:
    """Voters learned from at most ``sample`` labelled ids that have a text, the ones with the least hashes.

    Rows whose crc32(doc_id as text) mod 3 is 1 are never used where ``held_out``. The term vectors of the sample, of a
    fixed width, meet in one task; the fitted model, of bounded size, reaches the driver and is broadcast.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    if held_out:
        known = known.where(~_held_out())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    texts = id_and_text(docs).where("length(text) > 0")
    # only labels with a text take a place, and each id once
    known = known.join(texts.select("doc_id").distinct(), "doc_id")
    known = checkpointed(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    chosen = texts.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = list(terms(batch.column("text")))
            if blocks:
                vectors = [x.astype("<f4").tobytes() for x in np.vstack(blocks)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(vectors, pa.binary())], names=["doc_id", "quality", "vector"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["doc_id"], r["vector"], r["quality"]) for batch in batches for r in batch.to_pylist())
        vectors = np.frombuffer(b"".join(r[1] for r in rows), "<f4").reshape(len(rows), BUCKETS + WORDS + _EXTRA)
        model = pickle.dumps(Voters(vectors, np.array([r[2] for r in rows], np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    # one task for the bounded sample, where numerical libraries keep to one thread
    vectors = chosen.mapInArrow(run, "doc_id long, quality int, vector binary").repartition(1)
    found = vectors.mapInArrow(fit, "model binary").first()
    return pickle.loads(found.model) if found else Voters(np.zeros((0, BUCKETS + WORDS + _EXTRA), np.float32), np.zeros(0))


def _held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``.

    ``score`` is the similarity-weighted share of neighbours labelled 1. A null or empty text has
    no neighbours and gets the sample's share of label 1; so does every text where there
    are no labels (0.5). A null doc_id is not held out; labels without a document, null
    labels and other columns are ignored, of repeated labels the least counts, and of the texts that repeat a labelled doc_id. Repeated rows are scored alike; of
    equally near neighbours the smaller doc_id votes. Cosines are in single precision; neighbours that differ by less count as they round. Texts are whole, whatever their length; no rows give no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("quality")
        voters = model.value
        for batch in batches:
            if batch.num_rows:
                scores = np.concatenate([voters.scores(x) for x in terms(batch.column("text"))])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    texts = id_and_text(docs)
    scored = texts.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_rejected(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without those that score below 0.5; all columns stay, one pass, no shuffle.

    Null and empty texts score the sample's share of label 1 and stay or go with it, and so does everything where there are no
    labels (0.5, which stays). Rows with a null doc_id and rows that repeat are judged by their text like any other; columns
    of any name are handed on; no rows give no rows.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("quality")
        voters = model.value
        for batch in batches:
            if batch.num_rows:
                scores = np.concatenate([voters.scores(x) for x in terms(batch.column(batch.schema.get_field_index("text")))])
                yield batch.filter(pa.array(scores >= 0.5))

    return docs.mapInArrow(run, docs.schema)
