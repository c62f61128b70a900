"""Queries on validation, routing and streams, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspan.operators import validate as W
from inkspan.plans import catalog as C
from inkspan.plans import router
from inkspan.plans.catalog import with_views
from inkspan.plans.extraction import HOSTS
from inkspan.sources.tables import table
from inkspan.streaming import flows


def validate_indicators(spark, folder):
    """Valid and invalid values per indicator type."""
    rows = C.indicators(spark, folder).select("indicator_id", "type", W.indicator(F.col("type"), F.col("value"), HOSTS).alias("c"))
    return rows.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_if("c.valid").alias("valid"))


def validate_hashes(spark, folder):
    rows = C.indicators(spark, folder).filter("type IN ('md5', 'sha1', 'sha256')")
    checked = F.when(F.col("type") == "md5", W.form("md5", F.col("value"))).when(F.col("type") == "sha1", W.form("sha1", F.col("value"))).otherwise(W.form("sha256", F.col("value")))
    return rows.select("indicator_id", checked["valid"].alias("valid"), checked["value"].alias("value"))


def validate_ids(spark, folder):
    raw = table(spark, folder, "indicator_mentions")
    return raw.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(W.form("indicator_id", F.col("indicator_id"))["valid"]).alias("indicator_ids"), F.count_if(W.form("document_id", F.col("document_id"))["valid"]).alias("document_ids"),
        F.count_if(W.confidence(F.col("confidence"))).alias("confidences"),
    )


def validate_queries(spark, folder):
    """Titles as search queries: which are valid, and their sanitised text."""
    rows = table(spark, folder, "documents").filter("title IS NOT NULL").select("doc_id", W.query(F.col("title")).alias("q"))
    return rows.select("doc_id", "q.valid", "q.value")


def validate_metadata(spark, folder):
    rows = table(spark, folder, "indicators").select(W.metadata(F.col("metadata"))["valid"].alias("valid"), F.col("metadata").isNull().alias("missing"))
    return rows.groupBy("valid", "missing").agg(F.count(F.lit(1)).alias("n"))


def validate_date_range(spark, folder):
    rows = C.indicators(spark, folder).select(W.date_range(F.col("first_seen"), F.col("last_seen"), 365).alias("within_a_year"))
    return rows.groupBy("within_a_year").agg(F.count(F.lit(1)).alias("n"))


def sanitized_contexts(spark, folder):
    from inkspan.functions.text import html_escaped, sanitized

    rows = table(spark, folder, "indicator_mentions").filter("context IS NOT NULL").select("mention_id", html_escaped(sanitized(F.col("context"))).alias("context"))
    return rows.distinct()


def redacted_metadata(spark, folder):
    """Metadata of the documents as maps, with the author treated as a secret key would be."""
    pairs = F.from_json("metadata", "map<string,string>")
    renamed = F.map_from_entries(F.transform(F.map_entries(pairs), lambda e: F.struct(F.when(e["key"] == "author", "author_secret").otherwise(e["key"]), e["value"])))
    rows = table(spark, folder, "pdf_documents").filter("metadata IS NOT NULL").select("doc_id", W.redact(renamed)["author_secret"].alias("author"))
    return rows.filter("author IS NOT NULL").distinct()


def rate_window(spark, folder):
    found = W.rate_window(table(spark, folder, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "bulk")
    return found.select("event_id", "recent", "over")


def rate_admitted(spark, folder):
    """At most 3 events of a user an hour are admitted."""
    return W.rate_admitted(table(spark, folder, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 3, 3600)


def route_queries(spark, folder):
    """Titles as search queries with the way each is served."""
    titles = table(spark, folder, "documents").select("doc_id", F.col("title").alias("query"))
    return router.routed(titles).select("doc_id", "intent", "path", "indicator_type", "hops")


def stream_timeline(spark, folder):
    """Events per hour and type, by a stream over the table's files."""
    timeline = flows.event_timeline(flows.stream_table(spark, folder, "events"))
    return flows.drain(timeline, "complete").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


def stream_admitted(spark, folder):
    """Admitted and rejected events per user, by a stream with state: at most 3 an hour."""
    events = flows.stream_table(spark, folder, "events").select(F.col("user_id").cast("string").alias("client"), F.col("ts").alias("at"))
    return flows.drain(flows.admitted_stream(events, 3, 3600)).groupBy("client").agg(F.count_if("admitted").alias("admitted"), F.count_if(~F.col("admitted")).alias("rejected"))


QUERIES = {f.__name__: f for f in (
    validate_indicators, validate_hashes, validate_ids, validate_queries, validate_metadata, validate_date_range, sanitized_contexts, redacted_metadata, rate_window, rate_admitted, route_queries,
    stream_timeline, stream_admitted,
)}


def _regex(text: str, parts) -> str:
    return f"regexp_matches({text}, '{'|'.join(parts)}')"


_LOW = "lower(title)"
_INTENT = (
    f"CASE WHEN {_regex(_LOW, router.VERBS)} THEN CASE " + " ".join(f"WHEN {_regex(_LOW, p)} THEN '{n}'" for n, p in router.AFTER_VERB) + " ELSE 'semantic_search' END "
    + " ".join(f"WHEN {_regex(_LOW, p)} THEN '{n}'" for n, p in router.OTHERWISE) + " ELSE 'semantic_search' END"
)
_TYPE = "CASE " + " ".join(f"WHEN {_regex(_LOW, p)} THEN '{n}'" for n, p in router.TYPE_WORDS) + " END"
_BAD = " OR ".join("regexp_matches(v, '(?i)" + r.replace("'", "''") + "')" for r in (*W.SQL_INJECTION, *W.NOSQL_INJECTION))
_SAN = r"regexp_replace(regexp_replace(replace({0}, chr(0), ''), '^\s+|\s+$', '', 'g'), '[\x01-\x08\x0B-\x1F]', '', 'g')"

SQL = {
    "validate_hashes": with_views("i", """ , x AS (SELECT indicator_id, value, regexp_matches(value, CASE type WHEN 'md5' THEN '^[a-fA-F0-9]{32}$' WHEN 'sha1' THEN '^[a-fA-F0-9]{40}$' ELSE '^[a-fA-F0-9]{64}$' END) AS ok
      FROM i WHERE type IN ('md5', 'sha1', 'sha256')) SELECT indicator_id, coalesce(ok, false) AS valid, CASE WHEN ok THEN lower(value) END AS value FROM x"""),
    "validate_ids": """SELECT count(*) AS n, count(*) FILTER (regexp_matches(indicator_id, '^[a-fA-F0-9]{32}$')) AS indicator_ids,
      count(*) FILTER (regexp_matches(document_id, '^[a-zA-Z0-9_-]{1,255}$')) AS document_ids, count(*) FILTER (confidence BETWEEN 0 AND 1) AS confidences FROM indicator_mentions""",
    "validate_queries": f"""WITH s AS (SELECT doc_id, title, {_SAN.format('title')} AS v FROM documents WHERE title IS NOT NULL), c AS (SELECT doc_id, v, length(title) BETWEEN 1 AND 1000 AND NOT ({_BAD}) AS valid FROM s)
      SELECT doc_id, valid, CASE WHEN valid THEN v END AS value FROM c""",
    "validate_metadata": "SELECT coalesce(length(metadata) <= 10000 AND json_type(TRY_CAST(metadata AS JSON)) = 'OBJECT', false) AS valid, metadata IS NULL AS missing, count(*) AS n FROM indicators GROUP BY 1, 2",
    "validate_date_range": with_views("i", " SELECT coalesce(first_seen <= last_seen AND date_diff('day', first_seen::DATE, last_seen::DATE) <= 365, false) AS within_a_year, count(*) AS n FROM i GROUP BY 1"),
    "sanitized_contexts": f"""SELECT DISTINCT mention_id, replace(replace(replace(replace(replace({_SAN.format('context')}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS context
      FROM indicator_mentions WHERE context IS NOT NULL""",
    "redacted_metadata": """WITH a AS (SELECT doc_id, json_extract_string(TRY_CAST(metadata AS JSON), '$.author') AS v FROM pdf_documents WHERE metadata IS NOT NULL)
      SELECT DISTINCT doc_id, CASE WHEN length(v) > 4 THEN left(v, 2) || repeat('*', length(v) - 4) || right(v, 2) ELSE '****' END AS author FROM a WHERE v IS NOT NULL""",
    "rate_window": """SELECT event_id, count(*) OVER w AS recent, count(*) OVER w > 5 AS "over" FROM events
      WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW)""",
    "route_queries": f"""SELECT doc_id, {_INTENT} AS intent, CASE {_INTENT} WHEN 'indicator_lookup' THEN 'indicator' WHEN 'graph_traversal' THEN 'graph' WHEN 'pattern_analysis' THEN 'pattern' ELSE 'semantic' END AS path,
      {_TYPE} AS indicator_type, CASE WHEN regexp_matches({_LOW}, '\\d+\\s*hop') THEN coalesce(least(TRY_CAST(regexp_extract({_LOW}, '(\\d+)\\s*hop', 1) AS BIGINT), 5), 5) ELSE 2 END::INT AS hops FROM documents WHERE title IS NOT NULL""",
    "stream_timeline": "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
}
