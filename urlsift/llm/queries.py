"""Registered queries of the training-data operators: ``opN_<name>`` and ``pipeline``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlsift.llm.common import table


def vocabulary(name: str) -> str:
    """Place of a public tokenizer file; another folder may be given in ``URLSIFT_TOKENIZERS``."""
    import os

    import public_tokenizers

    folder = os.environ.get("URLSIFT_TOKENIZERS")
    return os.path.join(folder, name) if folder else public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from urlsift.llm.exact_dedup import dedup_decisions

    return dedup_decisions(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from urlsift.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), split_pattern())


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from urlsift.llm.bpe_transducer import code_digests

    return code_digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), split_pattern())


def op4_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from urlsift.llm.quality_divergence import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op5_template_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from urlsift.llm.template_extract import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


def op6_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from urlsift.llm.bloom_lm import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from urlsift.llm.license_setjoin import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents")).drop("matches")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from urlsift.llm.simple8b import read_token_files, write_token_files

    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 2))


def op9_pii_weak(spark: SparkSession, sf_dir: str) -> DataFrame:
    from urlsift.llm.pii_weak import find_personal_data

    found = find_personal_data(table(spark, sf_dir, "documents"))
    return found.withColumn("base_sha256", F.sha2("base_spans", 256)).drop("base_spans")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from urlsift.llm.jaccard_groupjoin import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from urlsift.llm.spelling_groups import letter_dropped, spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"), change=letter_dropped)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from urlsift.llm.periodic_runs import cycled, periodic_runs

    return periodic_runs(table(spark, sf_dir, "documents"), change=cycled)


def op13_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from urlsift.llm.setsketch_dedup import setsketch_duplicates

    return setsketch_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_packing, op3_byte_bpe, op4_divergence_rules, op5_template_extract, op6_bloom_lm, op7_license_scan, op8_token_files,
                                  op9_pii_weak, op10_jaccard_join, op11_spelling_variants, op12_periodic_runs, op13_setsketch_dedup)}

ORACLES = {
    "op1_exact_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
     h AS (SELECT doc_id, length(t) AS n, sha256(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM d),
     g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
                  count(*) OVER (PARTITION BY text_sha256) AS group_size FROM h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
}
