"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .oracles import oracle_sql


__all__ = ["oracle_sql", "queries"]


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), 1024)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import report, score

    return report(score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import find, report

    return report(find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_wrappers import extract

    return extract(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import tag

    return tag(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("toxic_words")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import groups

    return groups(table(spark, sf_dir, "documents"), 3, 90)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import round_trip

    return round_trip(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=1)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), 2048)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import dedup, report

    return report(dedup(table(spark, sf_dir, "documents")))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling_variants import variants

    return variants(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit, failures

    return audit(failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import report

    return report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
