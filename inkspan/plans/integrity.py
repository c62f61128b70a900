"""Queries on referential integrity and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkspan.operators.orphans import orphan_references, orphans_by_month
from inkspan.sources.tables import table


def _tables(spark: SparkSession, folder: str) -> list[DataFrame]:
    return [table(spark, folder, t) for t in ("indicator_mentions", "indicators", "pdf_documents", "deleted_records")]


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every reference of a mention to a row that is deleted, missing or created later."""
    return orphan_references(*_tables(spark, folder)).select("mention_id", "ref_column", "state").distinct()


def p6_orphans_by_month(spark: SparkSession, folder: str) -> DataFrame:
    """The same references counted per referenced table, month of the mention and state."""
    return orphans_by_month(*_tables(spark, folder))


_REFS = r"""
WITH keyed AS (
  SELECT mention_id, created_at, 'indicator_id' AS ref_column, lower(trim(indicator_id, E' \t\n\r\f\v')) AS key FROM indicator_mentions
  UNION ALL
  SELECT mention_id, created_at, 'document_id', lower(trim(document_id, E' \t\n\r\f\v')) FROM indicator_mentions),
refs AS (SELECT * FROM keyed WHERE key <> ''),
targets AS (
  SELECT ref_column, key, min(created_at) AS first_created FROM (
    SELECT 'indicator_id' AS ref_column, lower(trim(indicator_id, E' \t\n\r\f\v')) AS key, created_at FROM indicators
    UNION ALL SELECT 'document_id', lower(trim(doc_id, E' \t\n\r\f\v')), created_at FROM pdf_documents) GROUP BY 1, 2),
logged AS (
  SELECT DISTINCT CASE lower(trim(table_name)) WHEN 'indicators' THEN 'indicator_id' WHEN 'pdf_documents' THEN 'document_id' END AS ref_column,
         lower(trim(record_key, E' \t\n\r\f\v')) AS key FROM deleted_records),
judged AS (
  SELECT r.mention_id, r.ref_column, r.created_at,
         CASE WHEN t.key IS NOT NULL THEN CASE WHEN t.first_created > r.created_at THEN 'late' END
              WHEN l.key IS NOT NULL THEN 'deleted' ELSE 'missing' END AS state
  FROM refs r LEFT JOIN targets t ON r.ref_column = t.ref_column AND r.key = t.key
  LEFT JOIN logged l ON r.ref_column = l.ref_column AND r.key = l.key)
"""

QUERIES = {"p6_found": p6_found, "p6_orphans_by_month": p6_orphans_by_month}

SQL = {
    "p6_found": _REFS + "SELECT DISTINCT mention_id, ref_column, state FROM judged WHERE state IS NOT NULL",
    "p6_orphans_by_month": _REFS
    + """SELECT CASE ref_column WHEN 'indicator_id' THEN 'indicators' ELSE 'pdf_documents' END AS ref_table,
        strftime(created_at, '%Y-%m') AS month, state, count(*) AS n_refs FROM judged WHERE state IS NOT NULL GROUP BY 1, 2, 3""",
}
