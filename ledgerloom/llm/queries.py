"""Queries of the training-data problems, with SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import encodings, glyphs, labels, leakage, mixing, survivors
from ledgerloom.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "candidates")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.survivors(_candidates(spark, sf_dir), table(spark, sf_dir, "source_authority"))


def p1_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.resolve(_candidates(spark, sf_dir), table(spark, sf_dir, "source_authority"))


def p1_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.reliabilities(_candidates(spark, sf_dir), table(spark, sf_dir, "source_authority"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.mapped_candidates(_candidates(spark, sf_dir), table(spark, sf_dir, "field_labels"))


def p2_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.unmatched_labels(_candidates(spark, sf_dir), table(spark, sf_dir, "field_labels"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glyphs.changed_lines(table(spark, sf_dir, "trade_case_documents"), _candidates(spark, sf_dir))


def p5_plain_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = glyphs.trade_lines(table(spark, sf_dir, "trade_case_documents"))
    return glyphs.one_form(lines, "text", ["rec_key", "page", "line"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p6_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.remove_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encodings.garbled(table(spark, sf_dir, "documents"))


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encodings.repair(table(spark, sf_dir, "documents")).select(
        "doc_id", F.when(~F.col("lost"), F.col("restored")).alias("restored"), "chains", "lost"
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p1_found, p1_resolved, p1_sources, p2_found, p2_unmatched, p5_found, p5_plain_lines, p6_found, p6_cleaned, p7_mix, p7_shares, p8_found, p8_restored,
    )
}

SQL: dict[str, str] = {
    "p1_found": """
        WITH ranked AS (
            SELECT c.case_id, c.field, c.cand_id, c.sequence, c.confidence,
                   coalesce(c.authority_rank, o.authority_rank, a.authority_rank, z.authority_rank, 0) AS r,
                   coalesce(c.confidence BETWEEN 0 AND 1 AND NOT isnan(c.confidence)
                            AND lower(trim(c.normalized_value)) NOT IN ('', '-', 'n/a', '[blank]', '공란'), false) AS ok
            FROM candidates c
            LEFT JOIN source_authority o ON o.field = c.field AND o.document_type = coalesce(c.document_type, 'unknown')
            LEFT JOIN source_authority a ON a.field IS NULL AND a.document_type = coalesce(c.document_type, 'unknown')
            LEFT JOIN source_authority z ON z.field IS NULL AND z.document_type IS NULL
            WHERE c.field IS NOT NULL),
        rivals AS (SELECT case_id, field FROM ranked GROUP BY 1, 2 HAVING count(DISTINCT cand_id) > 1),
        ordered AS (
            SELECT r.*, row_number() OVER (PARTITION BY r.case_id, r.field ORDER BY r DESC, confidence DESC, sequence, cand_id) AS n
            FROM ranked r JOIN rivals USING (case_id, field) WHERE ok)
        SELECT case_id, field, cand_id FROM ordered WHERE n = 1""",
    "p6_found": """
        WITH plain AS (SELECT doc_id, lower(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) AS t FROM documents),
        tests AS (
            SELECT item_id, lower(regexp_replace(unnest([query, passage]), '[^\\p{L}\\p{N}]', '', 'g')) AS t FROM eval_items),
        runs AS (SELECT DISTINCT item_id, substr(t, i, 50) AS run FROM tests, unnest(range(1, length(t) - 48)) AS x(i) WHERE length(t) >= 50),
        seen AS (SELECT DISTINCT doc_id, substr(t, i, 50) AS run FROM plain, unnest(range(1, length(t) - 48)) AS x(i) WHERE length(t) >= 50)
        SELECT DISTINCT doc_id, item_id FROM seen JOIN runs USING (run)""",
}
