"""From raw documents to token ids: five stages over whole tables.

Every stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and
returns a DataFrame that is written as Parquet and read again as the next one's input.
All but the last return the columns of ``documents``.

Null and empty texts, texts of any length, repeated rows and null ids are handled as each operator says; columns beyond those
of ``documents`` are handed on; no rows give no rows, in every stage and in ``run``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, line_dedup, minhash, mixing, quality
from .shared import importable, quoted, removed, shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbour-vote classifier rejects go.

    Null and empty texts score the labelled sample's share of good ones; repeated rows and null ids are judged by their text.
    """
    return quality.without_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def cut_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on too large a share of their source's pages go; ``n_chars`` is counted anew.

    Null texts stay null, texts without a source stay whole, repeated rows are pages each; no document goes.
    """
    return line_dedup.without_boilerplate(docs).select(*map(quoted, docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays.

    Null and empty texts are one group; rows with a null id all stay; of rows that repeat an id one stays.
    """
    return minhash.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the last copy may be cut.

    Texts without words take no part; a null source is one of the sources; repeated rows are documents each.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text of the mix; a null text has no tokens."""
    return bpe.digests(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_good),
    ("line_dedup", cut_boilerplate),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: None: neighbour votes, weighted signatures and merges have no SQL; a chain of brute-force versions stands in, in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what stages hand on is kept in the session's shared folder.

    A stage's table is removed once the next one is written, the last one when the session ends.
    """
    importable(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}", None
    removed(spark, folder, at_exit=True)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            removed(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
