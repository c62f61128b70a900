"""Graph queries over the canonical views and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspan.operators import graph as G
from inkspan.plans import catalog as C
from inkspan.plans.catalog import with_views
from inkspan.plans.relational import BUSIEST, busiest
from inkspan.skew import cut


def _related(spark, folder):
    return C.links(spark, folder, "RELATED_TO").select(F.col("source").alias("u"), F.col("target").alias("v"))


def _hub(edges):
    """(id): the node with the most different neighbours, as a table of one row."""
    return G.both_ways(edges).groupBy(F.col("u").alias("id")).count().orderBy(F.desc("count"), "id").limit(1).select("id")


def n_hop(spark, folder):
    """Indicators within 2 hops of the busiest one over links of every type and over shared documents."""
    links = C.links(spark, folder).select(F.concat(F.lit("i:"), "source").alias("u"), F.concat(F.lit("i:"), "target").alias("v"))
    edges = cut(G.mention_edges(C.mentions(spark, folder, "indicator_id")).unionByName(links.distinct()))
    start = busiest(spark, folder).select(F.concat(F.lit("i:"), "id").alias("id"))
    reached = G.neighbourhood(edges, start, 2).filter("id LIKE 'i:%' AND distance > 0")
    return reached.select(F.substring("id", 3, 1000).alias("indicator_id"), "distance")


def related_n_hop(spark, folder):
    edges = cut(_related(spark, folder))
    return G.neighbourhood(edges, _hub(edges), 4)


def subgraph_edges(spark, folder):
    edges = cut(_related(spark, folder))
    return G.subgraph(edges, _hub(edges), 2)[1].select(F.col("u").alias("source"), F.col("v").alias("target"))


def subgraph_nodes(spark, folder):
    edges = cut(_related(spark, folder))
    return G.subgraph(edges, _hub(edges), 2)[0]


def cooccurrence_pairs(spark, folder):
    return G.cooccurrence(C.mentions(spark, folder, "indicator_id"), 3)


def ego_clusters(spark, folder):
    return G.ego_clusters(C.mentions(spark, folder, "indicator_id"), 3)


def components(spark, folder):
    edges = C.links(spark, folder, "USES").select(F.col("source").alias("u"), F.col("target").alias("v"))
    return G.components(edges)


def mention_clusters(spark, folder):
    """The component of every indicator that shares at least 3 documents with another, over such pairs."""
    pairs = G.cooccurrence(C.mentions(spark, folder, "indicator_id"), 3)
    return G.components(cut(pairs.select(F.col("indicator_a").alias("u"), F.col("indicator_b").alias("v"))))


def communities(spark, folder):
    return G.communities(_related(spark, folder))


def page_rank(spark, folder):
    return G.page_rank(_related(spark, folder)).withColumn("rank", F.round("rank", 9))


def shortest_path(spark, folder):
    """From the hub to the farthest node within 10 hops, the largest id of these."""
    edges = cut(_related(spark, folder))
    hub = cut(_hub(edges))
    far = G.neighbourhood(edges, hub, 10).orderBy(F.desc("distance"), F.desc("id")).limit(1).select("id")
    return G.shortest_path(edges, hub, far)


def cross_campaign(spark, folder):
    return G.cross_campaign(C.links(spark, folder))


def dominant_type(spark, folder):
    return G.dominant_types(C.indicators(spark, folder), 0.1)


def degree_distribution(spark, folder):
    return G.both_ways(_related(spark, folder)).groupBy("u").agg(F.count(F.lit(1)).alias("degree")).groupBy("degree").agg(F.count(F.lit(1)).alias("nodes"))


QUERIES = {f.__name__: f for f in (
    n_hop, related_n_hop, subgraph_edges, subgraph_nodes, cooccurrence_pairs, ego_clusters, components, mention_clusters, communities, page_rank, shortest_path, cross_campaign, dominant_type, degree_distribution,
)}

_WAYS = """ , w AS MATERIALIZED (SELECT source AS u, target AS v FROM l WHERE type = '{kind}' AND source <> target UNION SELECT target, source FROM l WHERE type = '{kind}' AND source <> target)"""
_RELATED = _WAYS.format(kind="RELATED_TO")
_START = "(SELECT u FROM w GROUP BY u ORDER BY count(*) DESC, u LIMIT 1)"
_REACH = _RELATED + ", r AS (SELECT {start} AS id, 0 AS distance UNION SELECT w.v, r.distance + 1 FROM r JOIN w ON w.u = r.id WHERE r.distance < {hops}), near AS (SELECT id, min(distance) AS distance FROM r GROUP BY 1)"
_CO = """ , p AS (SELECT DISTINCT indicator_id, document_id FROM m),
  co AS (SELECT a.indicator_id AS x, b.indicator_id AS y, count(*) AS k FROM p a JOIN p b ON a.document_id = b.document_id AND a.indicator_id < b.indicator_id GROUP BY 1, 2 HAVING count(*) >= 3)"""

_ARCS = """ , a AS MATERIALIZED (SELECT DISTINCT source AS u, target AS v FROM l WHERE type = 'RELATED_TO' AND source <> target), o AS (SELECT u, count(*) AS d FROM a GROUP BY 1),
  x AS MATERIALIZED (SELECT id, d, (SELECT count(*) FROM (SELECT u FROM a UNION SELECT v FROM a)) AS n FROM (SELECT u AS id FROM a UNION SELECT v FROM a) LEFT JOIN o ON o.u = id), r0 AS (SELECT id, d, n, 1.0::DOUBLE / n AS rank FROM x)"""
_ROUND = """, r{1} AS MATERIALIZED (SELECT x.id, x.d, x.n, 0.15 / x.n + 0.85 * (coalesce(got, 0) + coalesce(lost, 0) / x.n) AS rank FROM x LEFT JOIN (SELECT a.v, sum(r.rank / r.d) AS got FROM a JOIN r{0} r ON r.id = a.u GROUP BY 1) g ON g.v = x.id,
  (SELECT sum(rank) AS lost FROM r{0} WHERE d IS NULL))"""

SQL = {
    "page_rank": with_views("l", _ARCS + "".join(_ROUND.format(k, k + 1) for k in range(10)) + " SELECT id, round(rank, 9) AS rank FROM r10"),
    "shortest_path": with_views("l", _REACH.format(start=_START, hops=10) + """ , f AS (SELECT id, distance FROM near ORDER BY distance DESC, id DESC LIMIT 1),
      b AS (SELECT distance AS step, id FROM f UNION ALL SELECT step - 1, (SELECT min(w.u) FROM w JOIN near ON near.id = w.u WHERE w.v = b.id AND near.distance = b.step - 1) FROM b WHERE step > 0) SELECT step, id FROM b""", recursive=True),
    "n_hop": with_views("ml", f""" , e AS MATERIALIZED (SELECT DISTINCT 'i:' || indicator_id AS u, 'd:' || document_id AS v FROM m UNION SELECT 'i:' || source, 'i:' || target FROM l WHERE source <> target),
      w AS MATERIALIZED (SELECT u, v FROM e UNION SELECT v, u FROM e), one AS (SELECT v FROM w WHERE u = 'i:' || {BUSIEST}),
      r AS (SELECT v AS id, 1 AS distance FROM one UNION ALL SELECT w.v, 2 FROM one JOIN w ON w.u = one.v)
      SELECT substring(id, 3) AS indicator_id, min(distance) AS distance FROM r WHERE id LIKE 'i:%' AND id <> 'i:' || {BUSIEST} GROUP BY 1"""),
    "related_n_hop": with_views("l", _REACH.format(start=_START, hops=4) + " SELECT * FROM near", recursive=True),
    "subgraph_nodes": with_views("l", _REACH.format(start=_START, hops=2) + " SELECT * FROM near", recursive=True),
    "subgraph_edges": with_views("l", _REACH.format(start=_START, hops=2) + " SELECT DISTINCT source, target FROM l WHERE type = 'RELATED_TO' AND source IN (SELECT id FROM near) AND target IN (SELECT id FROM near)", recursive=True),
    "cooccurrence_pairs": with_views("m", _CO + " SELECT x AS indicator_a, y AS indicator_b, k AS documents FROM co"),
    "ego_clusters": with_views("m", _CO + """ , z AS (SELECT DISTINCT x AS center FROM co), s AS (SELECT center, count(DISTINCT b.indicator_id) + 1 AS size FROM z JOIN p a ON a.indicator_id = center
      JOIN p b ON b.document_id = a.document_id AND b.indicator_id <> center GROUP BY 1) SELECT * FROM s WHERE size >= 3 ORDER BY size DESC, center LIMIT 10"""),
    "components": with_views("l", _WAYS.format(kind="USES") + """ , r AS (SELECT source AS id, source AS other FROM l WHERE type = 'USES' UNION SELECT target, target FROM l WHERE type = 'USES'
      UNION SELECT r.id, w.v FROM r JOIN w ON w.u = r.other) SELECT id, min(other) AS component FROM r GROUP BY 1""", recursive=True),
    "mention_clusters": with_views("m", _CO + """ , w AS MATERIALIZED (SELECT x AS u, y AS v FROM co UNION SELECT y, x FROM co), r AS (SELECT u AS id, u AS other FROM w
      UNION SELECT r.id, w.v FROM r JOIN w ON w.u = r.other) SELECT id, min(other) AS component FROM r GROUP BY 1""", recursive=True),
    "cross_campaign": with_views("l", " SELECT source AS indicator_id, count(DISTINCT target) AS campaigns, least(count(DISTINCT target) / 10, 1.0) AS confidence FROM l WHERE type = 'PART_OF_CAMPAIGN' GROUP BY 1 HAVING count(DISTINCT target) > 1 ORDER BY campaigns DESC, indicator_id LIMIT 10"),
    "dominant_type": with_views("i", " , n AS (SELECT type, count(*) AS n, round(count(*) / (SELECT count(*) FROM i), 6) AS ratio FROM i GROUP BY 1) SELECT * FROM n WHERE ratio > 0.1"),
    "degree_distribution": with_views("l", _RELATED + " , g AS (SELECT u, count(*) AS degree FROM w GROUP BY 1) SELECT degree, count(*) AS nodes FROM g GROUP BY 1"),
}
