"""The canonical views of the domain tables, and the same views as SQL common table expressions.

Raw tables hold repeated and dirty rows; the views hold what a store with upserts would: one row per document, indicator and chunk, the last
mention of each (indicator, document, position), links with clean ends. Keys are trimmed and in lower case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.operators.upsert import latest
from inkspan.skew import key_of
from inkspan.sources.tables import table


def _only(rows: DataFrame, key: str, ids: DataFrame | None) -> DataFrame:
    """The rows whose key is in ids, a table of a few keys, before anything is shuffled."""
    return rows if ids is None else rows.join(F.broadcast(ids.select(F.col(ids.columns[0]).alias(key))), key, "left_semi")


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """One row per document; with columns, doc_id and these alone are carried along."""
    wanted = columns or ("title", "source", "file_hash", "processed_at", "total_pages", "created_at")
    needed = dict.fromkeys([*[c for c in wanted if c != "doc_id"], "processed_at", "title", "source"])
    rows = table(spark, folder, "pdf_documents").select(key_of("doc_id").alias("doc_id"), *(needed if set(wanted) - {"doc_id"} else []))
    merged = latest(rows.filter("doc_id IS NOT NULL"), ["doc_id"], ["processed_at", "title", "source"] if len(rows.columns) > 1 else [], [c for c in ("created_at",) if c in wanted], [])
    return merged.select("doc_id", *[c for c in wanted if c != "doc_id"])


def indicators(spark: SparkSession, folder: str, *columns: str, only: DataFrame | None = None) -> DataFrame:
    """One row per indicator; with columns, indicator_id and these alone are carried along; only limits them to a few ids."""
    wanted = columns or ("type", "value", "normalized_value", "first_seen", "last_seen", "occurrence_count")
    order = ["last_seen", "type", "value", "normalized_value", "first_seen", "occurrence_count"]
    plain = set(wanted) <= {"indicator_id"}
    rows = table(spark, folder, "indicators").select(key_of("indicator_id").alias("indicator_id"), *([] if plain else order)).filter("indicator_id IS NOT NULL")
    merged = latest(_only(rows, "indicator_id", only), ["indicator_id"], [] if plain else order, [c for c in ("first_seen",) if c in wanted], [], total=True)
    return merged.select("indicator_id", *[c for c in wanted if c != "indicator_id"])


def mentions(spark: SparkSession, folder: str, *columns: str, only: DataFrame | None = None) -> DataFrame:
    """The last mention of each (indicator, document, position); with columns, the keys and these alone are carried along; only limits them to a few indicators."""
    keys = ["indicator_id", "document_id", "position"]
    wanted = columns or ("mention_id", "context", "confidence", "page_number", "created_at")
    needed = dict.fromkeys([*[c for c in wanted if c not in keys], *(["created_at", "mention_id"] if set(wanted) - set(keys) else [])])
    rows = table(spark, folder, "indicator_mentions").select(key_of("indicator_id").alias("indicator_id"), key_of("document_id").alias("document_id"), "position", *needed)
    rows = _only(rows.dropna(subset=["indicator_id", "document_id"]), "indicator_id", only)
    merged = latest(rows, keys, ["created_at", "mention_id"] if needed else [], loose=["position"], total=bool(needed))
    return merged.select(*[c for c in ("mention_id", "indicator_id", "document_id", "context", "confidence", "page_number", "position", "created_at") if c in keys or c in wanted])


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "document_chunks").select("chunk_id", "document_id", "content", "chunk_index", "start_position", "end_position", "page_numbers", "language", "indicators_count", "created_at")
    return latest(rows.filter("chunk_id IS NOT NULL"), ["chunk_id"], ["created_at"], loose=[])


def relationship_type() -> F.Column:
    name = F.regexp_replace(F.upper(F.btrim("relationship_type")), r"[\s\-]+", "_")
    return F.when(name != "", name)


def links(spark: SparkSession, folder: str, kind: str | None = None) -> DataFrame:
    """(source, target, type, score): distinct links with clean ends, with their highest correlation score."""
    rows = table(spark, folder, "graph_relationships").select(
        key_of("source_id").alias("source"), key_of("target_id").alias("target"), relationship_type().alias("type"),
        F.get_json_object("properties", "$.correlation_score").try_cast("double").alias("score"),
    ).dropna(subset=["source", "target", "type"])
    if kind:
        rows = rows.filter(F.col("type") == kind)
    return rows.groupBy("source", "target", "type").agg(F.max("score").alias("score"))


_KEY = r"nullif(lower(trim({0}, E' \t\n\r\f\v')), '')"


def _key(column: str) -> str:
    return _KEY.format(column)


#: The views as common table expressions: put `WITH` and these names before a query. MATERIALIZED keeps each computed once.
VIEWS = {
    "d": f"""d AS MATERIALIZED (
  SELECT doc_id, title, source, file_hash, processed_at, total_pages, first_created AS created_at FROM (
    SELECT {_key('doc_id')} AS doc_id, title, source, file_hash, processed_at, total_pages,
      first_value(created_at IGNORE NULLS) OVER (PARTITION BY {_key('doc_id')} ORDER BY processed_at, created_at NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_created,
      row_number() OVER (PARTITION BY {_key('doc_id')} ORDER BY processed_at DESC NULLS LAST, title DESC NULLS LAST, source DESC NULLS LAST) AS rn
    FROM pdf_documents WHERE {_key('doc_id')} IS NOT NULL) WHERE rn = 1)""",
    "i": f"""i AS MATERIALIZED (
  SELECT indicator_id, type, value, normalized_value, first_first AS first_seen, last_seen, occurrence_count FROM (
    SELECT {_key('indicator_id')} AS indicator_id, type, value, normalized_value, last_seen, occurrence_count,
      first_value(first_seen IGNORE NULLS) OVER (PARTITION BY {_key('indicator_id')} ORDER BY last_seen, type, value, normalized_value, first_seen ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_first,
      row_number() OVER (PARTITION BY {_key('indicator_id')} ORDER BY last_seen DESC NULLS LAST, type DESC NULLS LAST, value DESC NULLS LAST, normalized_value DESC NULLS LAST, first_seen DESC NULLS LAST, occurrence_count DESC NULLS LAST) AS rn
    FROM indicators WHERE {_key('indicator_id')} IS NOT NULL) WHERE rn = 1)""",
    "m": f"""m AS MATERIALIZED (
  SELECT mention_id, indicator_id, document_id, context, confidence, page_number, position, created_at FROM (
    SELECT *, row_number() OVER (PARTITION BY indicator_id, document_id, position ORDER BY created_at DESC NULLS LAST, mention_id DESC) AS rn FROM (
      SELECT mention_id, {_key('indicator_id')} AS indicator_id, {_key('document_id')} AS document_id, context, confidence, page_number, position, created_at FROM indicator_mentions)
    WHERE indicator_id IS NOT NULL AND document_id IS NOT NULL) WHERE rn = 1 OR position IS NULL)""",
    "c": """c AS MATERIALIZED (
  SELECT chunk_id, document_id, content, chunk_index, start_position, end_position, page_numbers, language, indicators_count, created_at FROM (
    SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY created_at DESC NULLS LAST, document_id DESC NULLS LAST) AS rn FROM document_chunks WHERE chunk_id IS NOT NULL) WHERE rn = 1)""",
    "l": f"""l AS MATERIALIZED (
  SELECT source, target, type, max(score) AS score FROM (
    SELECT {_key('source_id')} AS source, {_key('target_id')} AS target, nullif(regexp_replace(upper(trim(relationship_type, E' \\t\\n\\r')), '[\\s\\-]+', '_', 'g'), '') AS type,
      TRY_CAST(json_extract_string(TRY_CAST(properties AS JSON), '$.correlation_score') AS DOUBLE) AS score FROM graph_relationships)
  WHERE source IS NOT NULL AND target IS NOT NULL AND type IS NOT NULL GROUP BY 1, 2, 3)""",
}


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """SQL of a query over the views named by single letters."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(VIEWS[n] for n in names) + body
