"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from . import audit, decontam, licenses, mixing, ngram_join, pii, quality, repeats, sharding, spelling, sql, token_files, url_filter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The byte-level vocabulary file that is installed with the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_quality(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        *[name for name, _, _ in quality.RULES if name != "n_words"],
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    first, second = (F.get("positions", F.lit(k)).alias(n) for k, n in enumerate(("position", "second_position")))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken", first, second, "whole_words")


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_output(_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages")).drop("candidates")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(_table(spark, sf_dir, "documents"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents")).drop("text_hash")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(audit.judged_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op13_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(_table(spark, sf_dir, "documents"))


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    f.__name__: _shipped(f)
    for f in (
        op1_pii, op2_quality_rules, op3_decontamination, op4_mixing, op5_token_output,
        op6_url_filters, op7_warc, op8_license_scan, op9_ngram_join, op10_sharding,
        op11_filter_audit, op12_spelling_variants, op13_repeated_passages,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_pii": sql.PII,
    "op2_quality_rules": sql.QUALITY,
    "op3_decontamination": sql.LEAKS,
    "op4_mixing": sql.MIX,
    "op6_url_filters": sql.URLS,
    "op9_ngram_join": sql.NGRAM,
    "op10_sharding": sql.SHARDS,
    "op11_filter_audit": sql.AUDIT,
    "op12_spelling_variants": sql.SPELLING,
    "op13_repeated_passages": sql.REPEATS,
    "op7_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
        f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
        SELECT page_id, n::BIGINT AS payload_bytes, p.digest AS payload_digest,
            CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> first THEN first END AS refers_to
        FROM p LEFT JOIN f ON p.digest = f.digest AND n >= 100""",
}
