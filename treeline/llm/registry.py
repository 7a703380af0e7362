"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import pipeline as stages
from . import ball_kmeans, bpe, curve_packing, divergence, kdtree, licenses, line_dedup, minhash, mixing, nn_descent, pii, prefix_tokens, quality
from .shared import importable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents")).drop("detections")


def op4_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_tokens.token_counts(table(spark, sf_dir, "documents"))


def op5_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(table(spark, sf_dir, "documents"), key="an example key, to be replaced by a secret one")


def op6_nn_descent_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.embedding_near_duplicates(table(spark, sf_dir, "embeddings")).drop("recall")


def op7_kdtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.top_k(table(spark, sf_dir, "embeddings"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.without_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op9_recursive_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "size", "source_size", "target", "taken")
    return mixing.mixed(table(spark, sf_dir, "documents")).select(*columns)


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans.inertias(ball_kmeans.ball_kmeans(table(spark, sf_dir, "embeddings")))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op13_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve_packing.checksums(curve_packing.packed(table(spark, sf_dir, "documents")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash_near_dedup, op2_neighbour_quality, op3_license_scan, op4_prefix_token_counts, op5_feistel_pseudonyms, op6_nn_descent_links, op7_kdtree_top_k, op8_line_dedup, op9_recursive_bpe, op10_source_mix, op11_ball_kmeans, op12_source_divergence, op13_curve_packing, pipeline)}


def oracle_sql() -> dict[str, str]:
    """For the others see the brute-force tests: they have regular expressions' places, learned votes, keys or merges."""
    return {
        "op1_minhash_near_dedup": minhash.ORACLE_SQL,
        "op6_nn_descent_links": nn_descent.ORACLE_SQL,
        "op7_kdtree_top_k": kdtree.ORACLE_SQL,
        "op8_line_dedup": line_dedup.ORACLE_SQL,
        "op10_source_mix": mixing.ORACLE_SQL,
        "op11_ball_kmeans": ball_kmeans.ORACLE_SQL,
        "op12_source_divergence": divergence.ORACLE_SQL,
    }
