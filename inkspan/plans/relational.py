"""Relational queries over the canonical views and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.operators import relational as R
from inkspan.operators.upsert import linked, merge_counts
from inkspan.plans import catalog as C
from inkspan.plans.catalog import with_views
from inkspan.skew import key_of
from inkspan.sources.tables import table


def busiest(spark: SparkSession, folder: str) -> DataFrame:
    """(id): the indicator with the most mentions, as a table of one row."""
    counts = table(spark, folder, "indicator_mentions").select(key_of("indicator_id").alias("id")).dropna().groupBy("id").count()
    return counts.orderBy(F.desc("count"), "id").limit(1).select("id")


def _own(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The mentions of the busiest indicator."""
    return C.mentions(spark, folder, *columns, only=busiest(spark, folder))


def _largest_campaign(links: DataFrame) -> DataFrame:
    """(campaign): the campaign with the most members, as a table of one row."""
    counts = links.filter("type = 'PART_OF_CAMPAIGN'").groupBy(F.col("target").alias("campaign")).count()
    return counts.orderBy(F.desc("count"), "campaign").limit(1).select("campaign")


#: The same choices in SQL.
BUSIEST = f"(SELECT {C._key('indicator_id')} FROM indicator_mentions WHERE {C._key('indicator_id')} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
LARGEST = "(SELECT target FROM l WHERE type = 'PART_OF_CAMPAIGN' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


def top_indicators(spark, folder):
    return R.by_type(C.indicators(spark, folder), "domain").select("indicator_id", "value", "occurrence_count")


def indicator_search_ilike(spark, folder):
    return R.search(C.indicators(spark, folder), "ul").select("indicator_id", "type", "value", "occurrence_count")


def indicator_detail(spark, folder):
    return C.indicators(spark, folder, only=busiest(spark, folder)).select("indicator_id", "type", "value", "normalized_value", "first_seen", "last_seen", "occurrence_count")


def indicator_mentions(spark, folder):
    found = R.with_documents(_own(spark, folder, "mention_id", "confidence", "page_number"), C.documents(spark, folder, "title", "source"))
    return found.select("mention_id", "document_id", "title", "confidence", "page_number")


def related_directed(spark, folder):
    links = C.links(spark, folder, "RELATED_TO")
    return R.related_to(R.links_of(links, _hub(links)), C.indicators(spark, folder, "type", "value")).select("indicator_id", "indicator_type", "score")


def related_undirected(spark, folder):
    links = C.links(spark, folder, "RELATED_TO")
    return R.related_to(R.links_of(links, _hub(links), directed=False), C.indicators(spark, folder, "type", "value"), 10).select("indicator_id", "indicator_type", "score")


def _hub(links: DataFrame) -> DataFrame:
    """(id): the source with the most links, as a table of one row."""
    return links.groupBy(F.col("source").alias("id")).count().orderBy(F.desc("count"), "id").limit(1).select("id")


_HUB = "(SELECT source FROM l WHERE type = 'RELATED_TO' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


def indicator_campaigns(spark, folder):
    return R.campaigns_with_actors(C.links(spark, folder)).select("indicator_id", "campaign", F.array_join("actors", ",").alias("actors"))


def indicator_context_counts(spark, folder):
    return R.context_counts(C.indicators(spark, folder, "value"), C.mentions(spark, folder, "indicator_id"), C.links(spark, folder))


def store_statistics(spark, folder):
    return R.store_statistics(C.documents(spark, folder, "doc_id"), C.indicators(spark, folder, "type"), C.mentions(spark, folder, "indicator_id"), C.chunks(spark, folder))


def graph_statistics(spark, folder):
    found = R.graph_statistics(C.documents(spark, folder, "doc_id"), C.indicators(spark, folder, "type"), C.mentions(spark, folder, "indicator_id"), C.links(spark, folder))
    return found.withColumn("types", F.array_join("types", ","))


def indicator_statistics(spark, folder):
    return R.indicator_statistics(C.indicators(spark, folder, "type", "last_seen"), C.mentions(spark, folder, "confidence")).withColumn("avg_confidence", F.round("avg_confidence", 6))


def similar_indicators(spark, folder):
    found = R.sharing_documents(C.mentions(spark, folder, "indicator_id"), C.indicators(spark, folder, "type", "value"), busiest(spark, folder), 0.001)
    return found.select("indicator_id", "type", F.round("score", 6).alias("score"))


def indicator_timeline(spark, folder):
    return R.timeline(_own(spark, folder, "created_at"), None, 365).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


def mention_timeline(spark, folder):
    return R.timeline(C.mentions(spark, folder, "created_at"), None, None).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


def fulltext_and(spark, folder):
    return R.full_text(C.documents(spark, folder), "genuine review", 50).select("doc_id", "title", "rank")


def campaign_members(spark, folder):
    links = C.links(spark, folder)
    members = links.filter("type = 'PART_OF_CAMPAIGN'").join(F.broadcast(_largest_campaign(links)), F.col("target") == F.col("campaign")).select(F.col("source").alias("indicator_id"))
    return C.indicators(spark, folder, "type", "value").join(members, "indicator_id", "left_semi").select("indicator_id", "type", "value")


def filtered_mentions(spark, folder):
    joined = C.mentions(spark, folder, "mention_id", "confidence", "created_at").join(C.indicators(spark, folder, "type"), "indicator_id")
    kept = joined.filter(R.mention_filter(["domain", "email", "url"], 0.8, "2023-06-01 00:00:00", "2024-06-30 00:00:00"))
    return kept.select("mention_id", "indicator_id", "type", "confidence")


def tlp_containment(spark, folder):
    rows = table(spark, folder, "indicators").select("indicator_id", F.get_json_object("metadata", "$.tlp").alias("tlp"))
    return rows.groupBy("tlp").agg(F.count(F.lit(1)).alias("n"))


def trigram_titles(spark, folder):
    """Titles by trigram similarity to the first title in order; keeps those at 0.3 or more."""
    docs = C.documents(spark, folder, "title").filter("title IS NOT NULL")
    probe = docs.orderBy("title", "doc_id").limit(1).select(F.col("title").alias("probe"))
    scored = docs.crossJoin(F.broadcast(probe)).withColumn("similarity", F.round(R.trigram_similarity(F.col("title"), F.col("probe")), 6))  # one row
    return scored.filter("similarity >= 0.3").drop("probe")


def sighting_counts(spark, folder):
    """First and last sighting and count per indicator from its mention rows."""
    events = table(spark, folder, "indicator_mentions").select(key_of("indicator_id").alias("indicator_id"), "created_at").filter("indicator_id IS NOT NULL")
    return merge_counts(events, "indicator_id", "created_at")


def latest_documents(spark, folder):
    return C.documents(spark, folder)


def latest_indicators(spark, folder):
    return C.indicators(spark, folder)


def latest_mentions(spark, folder):
    return C.mentions(spark, folder, "mention_id", "confidence").select("mention_id", "indicator_id", "document_id", "position", "confidence")


def latest_chunks(spark, folder):
    return C.chunks(spark, folder).select("chunk_id", "document_id", "chunk_index", "start_position", "end_position", "language", "indicators_count")


def valid_mention_links(spark, folder):
    """Distinct (indicator, document) edges of which both ends exist."""
    edges = C.mentions(spark, folder, "indicator_id").select(F.col("indicator_id").alias("source"), F.col("document_id").alias("target")).distinct()
    return linked(edges, C.indicators(spark, folder, "indicator_id"), "indicator_id", C.documents(spark, folder, "doc_id"), "doc_id").select("source", "target")


def campaign_edges(spark, folder):
    """Campaign memberships of existing indicators with their best score."""
    edges = C.links(spark, folder, "PART_OF_CAMPAIGN")
    return edges.join(C.indicators(spark, folder, "indicator_id").select(F.col("indicator_id").alias("source")), "source", "left_semi").select("source", "target", "score")


def attribution_edges(spark, folder):
    return C.links(spark, folder, "ATTRIBUTED_TO").select("source", "target", "score")


def link_types(spark, folder):
    return C.links(spark, folder).groupBy("type").agg(F.count(F.lit(1)).alias("links"), F.round(F.avg("score"), 6).alias("mean_score"))


QUERIES = {f.__name__: f for f in (
    top_indicators, indicator_search_ilike, indicator_detail, indicator_mentions, related_directed, related_undirected, indicator_campaigns, indicator_context_counts, store_statistics,
    graph_statistics, indicator_statistics, similar_indicators, indicator_timeline, mention_timeline, fulltext_and, campaign_members, filtered_mentions, tlp_containment, trigram_titles, sighting_counts,
    latest_documents, latest_indicators, latest_mentions, latest_chunks, valid_mention_links, campaign_edges, attribution_edges, link_types,
)}

_RELATED = """ , e AS (SELECT target AS id, score FROM l WHERE type = 'RELATED_TO' AND source = {hub} {more}), best AS (SELECT id, max(score) AS score FROM e GROUP BY 1)
  SELECT i.indicator_id, i.type AS indicator_type, best.score FROM best JOIN i ON i.indicator_id = best.id ORDER BY best.score DESC NULLS LAST, i.indicator_id LIMIT {n}"""
_STOP = "'" + "','".join(sorted(R.STOP_WORDS)) + "'"
_TERMS = f"list_transform(list_filter(string_split(regexp_replace(lower({{0}}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '' AND x NOT IN ({_STOP})), lambda x: regexp_replace(x, '^([a-z]{{{{3,}}}}?)(?:ies|es|s|ing|ed)$', '\\1'))"
_GRAMS = "list_distinct(list_transform(range(1, length('  ' || lower({0}) || ' ') - 1), lambda k: substring('  ' || lower({0}) || ' ', k, 3)))"

SQL = {
    "top_indicators": with_views("i", " SELECT indicator_id, value, occurrence_count FROM i WHERE type = 'domain' ORDER BY occurrence_count DESC NULLS LAST, indicator_id LIMIT 100"),
    "indicator_search_ilike": with_views("i", " SELECT indicator_id, type, value, occurrence_count FROM i WHERE value ILIKE '%ul%' OR normalized_value ILIKE '%ul%' ORDER BY occurrence_count DESC NULLS LAST, indicator_id LIMIT 100"),
    "indicator_detail": with_views("i", f" SELECT indicator_id, type, value, normalized_value, first_seen, last_seen, occurrence_count FROM i WHERE indicator_id = {BUSIEST}"),
    "indicator_mentions": with_views("dm", f" SELECT mention_id, document_id, title, confidence, page_number FROM m JOIN d ON d.doc_id = m.document_id WHERE indicator_id = {BUSIEST}"),
    "related_directed": with_views("il", _RELATED.format(hub=_HUB, more="", n=20)),
    "related_undirected": with_views("il", _RELATED.format(hub=_HUB, more=f"UNION ALL SELECT source, score FROM l WHERE type = 'RELATED_TO' AND target = {_HUB}", n=10)),
    "indicator_campaigns": with_views("l", """ SELECT p.source AS indicator_id, p.target AS campaign, coalesce(string_agg(DISTINCT a.target, ',' ORDER BY a.target), '') AS actors
      FROM l p LEFT JOIN l a ON a.source = p.target AND a.type = 'ATTRIBUTED_TO' WHERE p.type = 'PART_OF_CAMPAIGN' GROUP BY 1, 2"""),
    "indicator_context_counts": with_views("iml", """ , met AS (SELECT indicator_id, count(*) AS n_mentions, count(DISTINCT document_id) AS n_documents FROM m GROUP BY 1),
      camp AS (SELECT source, count(DISTINCT target) AS n_campaigns FROM l WHERE type = 'PART_OF_CAMPAIGN' GROUP BY 1),
      near AS (SELECT x, count(DISTINCT y) AS n_related FROM (SELECT source AS x, target AS y FROM l WHERE type = 'RELATED_TO' UNION ALL SELECT target, source FROM l WHERE type = 'RELATED_TO') WHERE x <> y GROUP BY 1)
      SELECT i.indicator_id, value, coalesce(n_mentions, 0) AS n_mentions, coalesce(n_documents, 0) AS n_documents, coalesce(n_campaigns, 0) AS n_campaigns, coalesce(n_related, 0) AS n_related
      FROM i LEFT JOIN met ON met.indicator_id = i.indicator_id LEFT JOIN camp ON camp.source = i.indicator_id LEFT JOIN near ON near.x = i.indicator_id"""),
    "store_statistics": with_views("dimc", """ SELECT 'documents' AS what, count(*) AS n FROM d UNION ALL SELECT 'indicators', count(*) FROM i UNION ALL SELECT 'mentions', count(*) FROM m
      UNION ALL SELECT 'chunks', count(*) FROM c UNION ALL SELECT 'type:' || type, count(*) FROM i WHERE type IS NOT NULL GROUP BY type"""),
    "graph_statistics": with_views("diml", """ SELECT (SELECT count(*) FROM d) AS documents, (SELECT count(*) FROM i) AS indicators, (SELECT string_agg(DISTINCT type, ',' ORDER BY type) FROM i) AS types,
      (SELECT count(*) FROM (SELECT DISTINCT indicator_id, document_id FROM m)) AS mention_edges, (SELECT count(DISTINCT target) FROM l WHERE type = 'PART_OF_CAMPAIGN') AS campaigns,
      (SELECT count(DISTINCT target) FROM l WHERE type = 'ATTRIBUTED_TO') AS actors"""),
    "indicator_statistics": with_views("im", """ SELECT i.type, count(*) AS total_count, count(DISTINCT i.indicator_id) AS indicator_count, count(DISTINCT m.document_id) AS document_count,
      round(avg(m.confidence), 6) AS avg_confidence, max(i.last_seen) AS most_recent FROM i LEFT JOIN m ON m.indicator_id = i.indicator_id GROUP BY 1"""),
    "similar_indicators": with_views("im", f""" , t AS (SELECT {BUSIEST} AS id), n AS (SELECT count(*) AS rows FROM m, t WHERE indicator_id = t.id),
      common AS (SELECT o.indicator_id, count(*) AS k FROM m s JOIN t ON s.indicator_id = t.id JOIN m o ON o.document_id = s.document_id AND o.indicator_id <> t.id GROUP BY 1)
      SELECT i.indicator_id, i.type, round(k / rows, 6) AS score FROM common JOIN i ON i.indicator_id = common.indicator_id, n WHERE k / rows >= 0.001 ORDER BY k / rows DESC, i.indicator_id LIMIT 10"""),
    "indicator_timeline": with_views("m", f""" , own AS (SELECT * FROM m WHERE indicator_id = {BUSIEST}), a AS (SELECT max(created_at)::DATE AS day FROM own)
      SELECT strftime(created_at, '%Y-%m-%d') AS date, count(*) AS mention_count, count(DISTINCT document_id) AS unique_documents FROM own, a WHERE created_at >= a.day - INTERVAL 365 DAY GROUP BY 1"""),
    "mention_timeline": with_views("m", " SELECT strftime(created_at, '%Y-%m-%d') AS date, count(*) AS mention_count, count(DISTINCT document_id) AS unique_documents FROM m WHERE created_at IS NOT NULL GROUP BY 1"),
    "fulltext_and": with_views("d", " , w AS (SELECT doc_id, title, " + _TERMS.format("coalesce(title, '') || ' ' || coalesce(source, '')") + """ AS words FROM d),
      r AS (SELECT doc_id, title, round(len(list_filter(words, lambda x: x IN ('genuine', 'review'))) / len(words), 6) AS rank FROM w WHERE list_contains(words, 'genuine') AND list_contains(words, 'review'))
      SELECT * FROM r ORDER BY rank DESC, doc_id LIMIT 50"""),
    "campaign_members": with_views("il", f" SELECT indicator_id, type, value FROM i WHERE indicator_id IN (SELECT source FROM l WHERE type = 'PART_OF_CAMPAIGN' AND target = {LARGEST})"),
    "filtered_mentions": with_views("im", """ SELECT m.mention_id, m.indicator_id, i.type, m.confidence FROM m JOIN i ON i.indicator_id = m.indicator_id
      WHERE i.type IN ('domain', 'email', 'url') AND confidence >= 0.8 AND created_at >= TIMESTAMP '2023-06-01' AND created_at <= TIMESTAMP '2024-06-30'"""),
    "tlp_containment": "SELECT json_extract_string(TRY_CAST(metadata AS JSON), '$.tlp') AS tlp, count(*) AS n FROM indicators GROUP BY 1",
    "trigram_titles": with_views("d", f""" , p AS (SELECT title AS probe FROM d WHERE title IS NOT NULL ORDER BY title, doc_id LIMIT 1),
      g AS (SELECT doc_id, title, {_GRAMS.format('title')} AS a, {_GRAMS.format('probe')} AS b FROM d, p WHERE title IS NOT NULL),
      s AS (SELECT doc_id, title, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS similarity FROM g) SELECT * FROM s WHERE similarity >= 0.3"""),
    "sighting_counts": f"SELECT {C._key('indicator_id')} AS indicator_id, min(created_at) AS first_seen, max(created_at) AS last_seen, count(*) AS occurrence_count FROM indicator_mentions WHERE {C._key('indicator_id')} IS NOT NULL GROUP BY 1",
    "latest_documents": with_views("d", " SELECT * FROM d"),
    "latest_indicators": with_views("i", " SELECT * FROM i"),
    "latest_mentions": with_views("m", " SELECT mention_id, indicator_id, document_id, position, confidence FROM m"),
    "latest_chunks": with_views("c", " SELECT chunk_id, document_id, chunk_index, start_position, end_position, language, indicators_count FROM c"),
    "valid_mention_links": with_views("dim", " SELECT DISTINCT indicator_id AS source, document_id AS target FROM m WHERE indicator_id IN (SELECT indicator_id FROM i) AND document_id IN (SELECT doc_id FROM d)"),
    "campaign_edges": with_views("il", " SELECT source, target, score FROM l WHERE type = 'PART_OF_CAMPAIGN' AND source IN (SELECT indicator_id FROM i)"),
    "attribution_edges": with_views("l", " SELECT source, target, score FROM l WHERE type = 'ATTRIBUTED_TO'"),
    "link_types": with_views("l", " SELECT type, count(*) AS links, round(avg(score), 6) AS mean_score FROM l GROUP BY 1"),
}
