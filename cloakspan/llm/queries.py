"""The queries of this subpackage: one for each operator, over the whole of its table, and their SQL where there is some."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, license_scan, line_dedup, media, near_dedup, oracle, packing, quality, substring_dedup, token_output, toxicity
from .shared import new_folder


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(_table(spark, sf_dir, "documents")).drop("spans")


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the shards and reads them back: a row per sequence, with its slot and its place in the shards."""
    folder = new_folder(spark, "shards")
    n = token_output.write_shards(_table(spark, sf_dir, "documents"), tokenizer_path(), folder)
    return token_output.read_shards(spark, folder, n, with_ids=False)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without its repeated lines."""
    out = line_dedup.line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On two-word shingles."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), k=2).select("doc_id", "n_shingles", "component_id", "kept")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of a document and a benchmark item that overlap; what is in none is clean."""
    return decontaminate.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("text_hash")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_token_output, op3_line_dedup, op4_near_dedup, op5_decontamination, op6_media, op7_quality, op8_packing, op9_substring_dedup, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": license_scan.oracle(),
        "op3_line_dedup": oracle.LINE_DEDUP,
        "op4_near_dedup": oracle.NEAR_DEDUP,
        "op5_decontamination": oracle.DECONTAMINATION,
        "op9_substring_dedup": oracle.SUBSTRING_DEDUP,
    }
