"""Graph queries as rounds of joins over an edge table (u, v).

Frontiers are cut off by written tables after each hop, so plans stay short; visited nodes are removed by anti-joins. Only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.skew import cut, forget, meet

#: Documents whose members are counted without being listed for every center.
LARGEST = 8


def both_ways(edges: DataFrame) -> DataFrame:
    """(u, v) in both directions, distinct, without loops."""
    turned = F.explode(F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    return edges.select(turned.alias("e")).select("e.u", "e.v").filter("u <> v").distinct()


def mention_edges(mentions: DataFrame) -> DataFrame:
    """(u, v) of indicators and documents, with ids set apart by prefixes."""
    return mentions.select(F.concat(F.lit("i:"), F.col("indicator_id")).alias("u"), F.concat(F.lit("d:"), F.col("document_id")).alias("v")).distinct()


def _start(edges: DataFrame, start: str | DataFrame) -> DataFrame:
    """(id) of the node or the few nodes, given as a table of one column, that a walk begins at."""
    return edges.sparkSession.createDataFrame([(start,)], "id string") if isinstance(start, str) else start.select(F.col(start.columns[0]).alias("id"))


def _step(edges: DataFrame, frontier: DataFrame, *carried: str) -> DataFrame:
    """(id, carried columns) of the nodes one edge away. A small frontier is broadcast, being a written table of known size, and the edges are not shuffled."""
    out = edges.select("u", "v").filter("u <> v").join(frontier.withColumnRenamed("id", "u"), "u").select(F.col("v").alias("id"), F.col("u").alias("from"), *carried)
    back = edges.select("u", "v").filter("u <> v").join(frontier.withColumnRenamed("id", "v"), "v").select(F.col("u").alias("id"), F.col("v").alias("from"), *carried)
    return out.unionByName(back)


def neighbourhood(edges: DataFrame, start: str | DataFrame, hops: int) -> DataFrame:
    """(id, distance) of the nodes within so many hops of start, start itself at 0."""
    frontier = cut(_start(edges, start).withColumn("distance", F.lit(0)))
    reached = frontier
    for hop in range(1, hops + 1):
        step = _step(edges, frontier.select("id")).select("id").distinct()
        frontier = cut(step.join(reached.select("id"), "id", "left_anti").withColumn("distance", F.lit(hop)))
        reached = reached.unionByName(frontier)
    return reached


def subgraph(edges: DataFrame, center: str | DataFrame, hops: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the neighbourhood: nodes as (id, distance), edges with both ends inside."""
    nodes = cut(neighbourhood(edges, center, hops))
    inside = edges.select("u", "v").distinct().join(nodes.select(F.col("id").alias("u")), "u", "left_semi").join(nodes.select(F.col("id").alias("v")), "v", "left_semi")
    return nodes, inside


def _pairs(mentions: DataFrame) -> DataFrame:
    return cut(mentions.select("indicator_id", "document_id").distinct())


def _largest(pairs: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """((indicator_id, bits), pairs of the other documents): a bit for each of the n largest documents that an indicator is in, n being small."""
    ids = [r[0] for r in pairs.groupBy("document_id").count().orderBy(F.desc("count"), "document_id").limit(n).collect()] if n else []
    bit = F.coalesce(*[F.when(F.col("document_id") == d, F.lit(1 << k).cast("long")) for k, d in enumerate(ids)], F.lit(0).cast("long"))
    inside = F.col("document_id").isin(ids)
    return cut(pairs.filter(inside).groupBy("indicator_id").agg(F.bit_or(bit).alias("bits"))), pairs.filter(~inside)


def _numbered(pairs: DataFrame, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((indicator_id, no, bits), (document_id, no, bits) of all but the n largest documents, bits of the members of these): numbers make pairs small."""
    bits, rest = _largest(pairs, n)
    names = pairs.select("indicator_id").distinct().withColumn("no", F.monotonically_increasing_id())
    named = cut(names.join(bits, "indicator_id", "left").withColumn("bits", F.coalesce("bits", F.lit(0).cast("long"))))
    return named, cut(rest.join(named, "indicator_id").select("document_id", "no", "bits")), bits


def _counted(pairs: DataFrame, least: int) -> DataFrame:
    """Each indicator needs `least` documents itself; the others are dropped before documents are paired.

    The least - 1 largest documents alone never suffice: pairs are made in the other ones only, and the largest add to their counts by a bit per indicator.
    """
    often = pairs.groupBy("indicator_id").count().filter(F.col("count") >= least).select("indicator_id")
    named, rows, _ = _numbered(cut(pairs.join(often, "indicator_id", "left_semi")), min(least - 1, 60))
    both = meet(rows.select("document_id", F.col("no").alias("a"), F.col("bits").alias("bits_a")), rows.select("document_id", F.col("no").alias("b"), F.col("bits").alias("bits_b")), "document_id")
    shared = F.bit_count(F.col("bits_a").bitwiseAND(F.col("bits_b")))
    counts = both.filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max(shared).alias("shared")).withColumn("documents", F.col("n") + F.col("shared"))
    kept = counts.filter(F.col("documents") >= least).select("a", "b", "documents")
    told = kept.join(named.select(F.col("no").alias("a"), F.col("indicator_id").alias("x")), "a").join(named.select(F.col("no").alias("b"), F.col("indicator_id").alias("y")), "b")
    return told.select(F.least("x", "y").alias("indicator_a"), F.greatest("x", "y").alias("indicator_b"), "documents")


def cooccurrence(mentions: DataFrame, least: int = 2) -> DataFrame:
    """(indicator_a, indicator_b, documents) of pairs that share at least so many documents; large documents are paired block by block."""
    return _counted(_pairs(mentions), least)


def ego_clusters(mentions: DataFrame, least: int = 2, smallest: int = 3, limit: int = 10) -> DataFrame:
    """(center, size): indicators that are the smaller of a co-occurring pair, with the number of all they are mentioned with.

    The members that a center meets in the largest documents are counted from these documents' sizes, one union per set of them that occurs;
    only members met elsewhere, and not in a large document of the center, are listed.
    """
    pairs = _pairs(mentions)
    centers = _counted(pairs, least).select(F.col("indicator_a").alias("indicator_id")).distinct()
    named, rows, bits = _numbered(pairs, LARGEST)
    masks = bits.groupBy("bits").agg(F.count(F.lit(1)).alias("n"))  # at most 2 ** LARGEST rows
    unions = F.broadcast(masks.select(F.col("bits").alias("mask"))).crossJoin(F.broadcast(masks)).groupBy("mask").agg(F.sum(F.when(F.col("mask").bitwiseAND(F.col("bits")) != 0, F.col("n")).otherwise(0)).alias("inside"))
    marked = cut(named.join(centers, "indicator_id").select(F.col("indicator_id").alias("center"), "no", F.col("bits").alias("mask")))
    own = rows.join(marked.select("no"), "no", "left_semi").select("document_id", F.col("no").alias("own"), F.col("bits").alias("mask"))
    around = meet(own, rows, "document_id").filter("own <> no AND (mask & bits) = 0")
    met = around.select("own", "no").distinct().groupBy(F.col("own").alias("no")).agg(F.count(F.lit(1)).alias("outside"))
    joined = marked.join(met, "no", "left").join(F.broadcast(unions), "mask", "left")
    # the union of a center's large documents holds the center itself
    size = F.coalesce("outside", F.lit(0)) + F.when(F.col("mask") != 0, F.col("inside")).otherwise(1)
    return joined.select("center", size.alias("size")).filter(F.col("size") >= smallest).orderBy(F.desc("size"), "center").limit(limit)


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id of each connected component, by smallest-neighbour rounds with shortcuts."""
    ways = cut(both_ways(edges))
    loops = edges.select(F.col("u").alias("id")).union(edges.select("v")).distinct()
    labels = cut(loops.withColumn("component", F.col("id")))
    while True:
        near = ways.join(labels.select(F.col("id").alias("v"), "component"), "v").groupBy(F.col("u").alias("id")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "id", "left").select("id", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        # a label's own label is at least as small: one shortcut per round halves long chains
        hop = lower.select(F.col("id").alias("component"), F.col("component").alias("further"))
        fresh = cut(lower.join(hop, "component", "left").select("id", F.least("component", "further").alias("component"), "was"))
        done = fresh.filter("component <> was").isEmpty()
        forget(labels)
        labels = fresh.select("id", "component")
        labels._written_at = fresh._written_at
        if done:
            return labels


def communities(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, community): label propagation, each node taking its neighbours' most frequent label, the smaller one of a tie."""
    ways = cut(both_ways(edges))
    labels = ways.select(F.col("u").alias("id")).distinct().withColumn("community", F.col("id"))
    for _ in range(rounds):
        votes = ways.join(labels.select(F.col("id").alias("v"), "community"), "v").groupBy(F.col("u").alias("id"), "community").agg(F.count(F.lit(1)).alias("votes"))
        labels = cut(votes.groupBy("id").agg(F.min_by("community", F.struct(-F.col("votes"), F.col("community"))).alias("community")))
    return labels


def page_rank(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """(id, rank) by power iteration over directed distinct edges; nodes without a way out share their rank with all."""
    arcs = cut(edges.select("u", "v").filter("u <> v").distinct())
    nodes = arcs.select(F.col("u").alias("id")).union(arcs.select("v")).distinct()
    degree = arcs.groupBy(F.col("u").alias("id")).agg(F.count(F.lit(1)).alias("out"))
    nodes = cut(nodes.join(degree, "id", "left"))
    n = nodes.count()
    ranks = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for _ in range(rounds):
        lost = ranks.agg(F.sum(F.when(F.col("out").isNull(), F.col("rank")).otherwise(0.0)).alias("lost"))
        given = arcs.join(ranks.filter("out IS NOT NULL").select(F.col("id").alias("u"), (F.col("rank") / F.col("out")).alias("part")), "u").groupBy(F.col("v").alias("id")).agg(F.sum("part").alias("got"))
        rank = (1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)
        ranks = cut(nodes.join(given, "id", "left").crossJoin(F.broadcast(lost)).select("id", "out", rank.alias("rank")))
    return ranks.select("id", "rank")


def shortest_path(edges: DataFrame, start: str | DataFrame, end: str | DataFrame, most: int = 10) -> DataFrame:
    """(step, id) of one shortest path, that with the smallest ids from its end back; empty if end is not reached in so many hops.

    Every node of the frontier carries its path, at most `most` ids.
    """
    goal = cut(_start(edges, end))
    frontier = cut(_start(edges, start).withColumn("path", F.array("id")))
    reached = frontier.select("id")
    for hop in range(most + 1):
        arrived = frontier.join(F.broadcast(goal), "id")
        if hop == most or not arrived.isEmpty() or frontier.isEmpty():
            break
        step = _step(edges, frontier, "path").groupBy("id").agg(F.min_by("path", F.reverse("path")).alias("path"))
        frontier = cut(step.join(reached, "id", "left_anti").select("id", F.concat("path", F.array("id")).alias("path")))
        reached = reached.unionByName(frontier.select("id"))
    return arrived.select(F.posexplode("path").alias("step", "id"))


def cross_campaign(links: DataFrame, limit: int = 10) -> DataFrame:
    """(indicator_id, campaigns, confidence) of members of several campaigns."""
    member = links.filter(F.col("type") == "PART_OF_CAMPAIGN").groupBy(F.col("source").alias("indicator_id")).agg(F.count_distinct("target").alias("campaigns"))
    several = member.filter("campaigns > 1").withColumn("confidence", F.least(F.col("campaigns") / 10, F.lit(1.0)))
    return several.orderBy(F.desc("campaigns"), "indicator_id").limit(limit)


def dominant_types(indicators: DataFrame, above: float = 0.3) -> DataFrame:
    """(type, n, ratio) of types that hold more than that share of all indicators."""
    counts = indicators.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("ratio", F.col("n") / F.col("total")).filter(F.col("ratio") > above).select("type", "n", F.round("ratio", 6).alias("ratio"))
