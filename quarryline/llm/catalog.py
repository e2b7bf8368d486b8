"""Queries of the training-data operators with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarryline.llm import credentials, lookalikes, mixing, parsing, provenance, splitting, tokenizing
from quarryline.session import checkpointed
from quarryline.sources.tables import table


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "source_files"), table(spark, d, "size_limits"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_pieces(spark, d).where("piece = 1").select("file_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return provenance.not_handwritten(table(spark, d, "source_files")).select("file_id")


def p3_kinds(spark: SparkSession, d: str) -> DataFrame:
    return provenance.not_handwritten(table(spark, d, "source_files"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return parsing.broken_files(table(spark, d, "source_files")).select("file_id")


def p4_files(spark: SparkSession, d: str) -> DataFrame:
    return parsing.broken_files(table(spark, d, "source_files"))


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    return parsing.broken_rates(table(spark, d, "source_files"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials.credential_lines(table(spark, d, "source_files"))


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    return credentials.redacted_files(table(spark, d, "source_files"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizing.encode_corpus(table(spark, d, "documents"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    docs = checkpointed(mixing.sized(table(spark, d, "documents")))
    return mixing.mix(docs, table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.actual_shares(p8_mix(spark, d), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.lookalike_pairs(table(spark, d, "documents"))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.lookalike_classes(table(spark, d, "documents"))


_QUERIES = {
    "p1_found": p1_found, "p1_pieces": p1_pieces, "p3_found": p3_found, "p3_kinds": p3_kinds, "p4_found": p4_found, "p4_files": p4_files, "p4_rates": p4_rates, "p6_found": p6_found, "p6_redacted": p6_redacted, "p7_ids": p7_ids, "p8_mix": p8_mix, "p8_shares": p8_shares,
    "p9_found": p9_found, "p9_classes": p9_classes,
}

_SQL = {
    "p1_found": """
        SELECT DISTINCT f.file_id FROM source_files f JOIN size_limits l ON l.language =
            CASE WHEN regexp_matches(lower(f.path), '\\.(js|mjs|cjs|jsx)$') THEN 'js' WHEN regexp_matches(lower(f.path), '\\.tsx?$') THEN 'ts'
                 WHEN regexp_matches(lower(f.path), '\\.py$') THEN 'py' ELSE 'other' END
        WHERE f.text IS NOT NULL AND strlen(f.text) > l.max_bytes""",
}


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
