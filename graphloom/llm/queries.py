"""The queries opN_<name> of this subpackage: thin, each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bitplane, codes, decontaminate, htmltext, licenses, lm, merkle, mixing, neardup, quality, sentences, sharding, toxicity
from .work import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.op1(table(spark, sf_dir, "documents"))


def op2_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op2(table(spark, sf_dir, "documents"))


def op3_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.op3(table(spark, sf_dir, "documents"))


def op4_gru_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.op4(table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op5(table(spark, sf_dir, "documents"))


def op6_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op6(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op7(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op8(table(spark, sf_dir, "documents"))


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.op9(table(spark, sf_dir, "pages"))


def op10_token_ids_bitplane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplane.op10(spark, table(spark, sf_dir, "documents"), tokenizer_path())


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.op11(table(spark, sf_dir, "documents"))


def op12_vector_codes_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.op12(table(spark, sf_dir, "embeddings"))


def op13_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op13(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in sorted(globals().items()) if k.startswith("op") and k[2:3].isdigit()}
