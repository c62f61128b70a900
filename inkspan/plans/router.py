"""Routing of search queries: intent, indicator type, node id and hops, as columns and for one query on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words (as parts of the lower-case query) that decide the intent, in this order.
VERBS = ("find", "get", "show", "list")
AFTER_VERB = (
    ("indicator_lookup", ("domain", "ip", "url", "email", "indicator")),
    ("graph_traversal", ("related", "connected", "hops", "graph")),
    ("campaign_analysis", ("campaign", "actor", "threat")),
)
OTHERWISE = (("pattern_analysis", ("pattern", "cluster", "group")), ("timeline_query", ("timeline", "when", "history")))
#: Words that name an indicator type, in this order.
TYPE_WORDS = (
    ("domain", ("domain", "domains")), ("url", ("url", "urls", "link", "links")), ("ip_address", ("ip", "ips", "address", "addresses")), ("email", ("email", "emails")),
    ("phone", ("phone", "phones", "number")), ("md5", ("md5",)), ("sha1", ("sha1",)), ("sha256", ("sha256",)),
)
#: The search that serves an intent; others are served by meaning.
PATHS = {"indicator_lookup": "indicator", "semantic_search": "semantic", "graph_traversal": "graph", "pattern_analysis": "pattern"}
MOST_HOPS, DEFAULT_HOPS = 5, 2


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    return text.rlike("|".join(parts))


def intent(query: Column) -> Column:
    low = F.lower(query)
    inner = F.lit("semantic_search")
    for name, parts in reversed(AFTER_VERB):
        inner = F.when(_any(low, parts), name).otherwise(inner)
    outer = F.lit("semantic_search")
    for name, parts in reversed(OTHERWISE):
        outer = F.when(_any(low, parts), name).otherwise(outer)
    return F.when(_any(low, VERBS), inner).otherwise(outer)


def indicator_type(query: Column) -> Column:
    low = F.lower(query)
    found = F.lit(None).cast("string")
    for name, parts in reversed(TYPE_WORDS):
        found = F.when(_any(low, parts), name).otherwise(found)
    return found


def path(query: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in PATHS.items() for x in pair])
    return F.coalesce(names[intent(query)], F.lit("semantic"))


def node_id(query: Column) -> Column:
    return F.nullif(F.regexp_extract(query, r"\b([a-fA-F0-9]{32})\b", 1), F.lit(""))


def max_hops(query: Column) -> Column:
    given = F.nullif(F.regexp_extract(F.lower(query), r"(\d+)\s*hop", 1), F.lit("")).try_cast("bigint")
    return F.coalesce(F.when(given.isNotNull(), F.least(given, F.lit(MOST_HOPS))), F.when(F.lower(query).rlike(r"\d+\s*hop"), MOST_HOPS), F.lit(DEFAULT_HOPS)).cast("int")


def routed(queries: DataFrame, column: str = "query") -> DataFrame:
    q = F.col(column)
    return queries.filter(q.isNotNull()).withColumns({"intent": intent(q), "path": path(q), "indicator_type": indicator_type(q), "node_id": node_id(q), "hops": max_hops(q)})


def synthesis(results: DataFrame, limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """(best results by score, one-row summary: total_found, returned, top_score, result_types) of (score, type, id, ...) rows."""
    best = results.orderBy(F.desc("score"), "id").limit(limit)
    summary = results.agg(F.count(F.lit(1)).alias("total_found"), F.least(F.count(F.lit(1)), F.lit(limit)).alias("returned"), F.max("score").alias("top_score"), F.sort_array(F.collect_set("type")).alias("result_types"))
    return best, summary
