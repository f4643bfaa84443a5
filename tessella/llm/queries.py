"""Queries over the driver's tables for the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, embed_join, exact_dedup, minhash, mixing, packing, pii, quality, spelling, suffix_dedup, token_counts, toxicity, warc
from .common import table


def _tokenizers():
    """The folder of public vocabulary files; only the queries know it, the operators take paths."""
    import public_tokenizers

    return public_tokenizers


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_embed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_join.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _tokenizers()
    return packing.pack(table(spark, sf_dir, "documents"), files.path("byte_bpe_50k.tiktoken"), files.PATTERN)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), _tokenizers().path("word_bpe_49k.json"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def _two_tokenizers() -> tuple[alignment.Coder, alignment.Coder]:
    files = _tokenizers()
    return alignment.byte_level(files.path("byte_bpe_50k.json")), alignment.pieces(files.path("piece_bpe_32k.model"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(table(spark, sf_dir, "documents"), _two_tokenizers)


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_minhash": op2_minhash,
        "op3_embed_join": op3_embed_join,
        "op4_toxicity": op4_toxicity,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_packing": op6_packing,
        "op7_mixing": op7_mixing,
        "op8_token_counts": op8_token_counts,
        "op9_warc": op9_warc,
        "op10_exact_dedup": op10_exact_dedup,
        "op11_spelling": op11_spelling,
        "op12_alignment": op12_alignment,
        "op13_pii": op13_pii,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_warc": warc.ORACLE, "op10_exact_dedup": exact_dedup.ORACLE}
