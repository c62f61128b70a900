"""The engine's verbs over a folder of tables: each returns a DataFrame that nothing has run yet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.operators import extract as X
from inkspan.operators import graph as G
from inkspan.operators import relational as R
from inkspan.operators import vectors as V
from inkspan.operators.upsert import latest, merge_counts, upsert
from inkspan.plans import catalog as C
from inkspan.plans import router
from inkspan.skew import cut
from inkspan.sources.tables import table


class Engine:
    """Lookup, search, context, network, clusters, patterns, timelines and statistics, and ingestion of pages."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.documents, self.indicators = C.documents(spark, folder), C.indicators(spark, folder)
        self.mentions, self.links, self.chunks = C.mentions(spark, folder), C.links(spark, folder), C.chunks(spark, folder)

    def ingest(self, pages: DataFrame) -> dict[str, DataFrame]:
        """Pages (document_id, page_number, page_id, text, extracted_at) -> the upserted indicators and their mentions.

        One pass over the pages: extraction is narrow, one shuffle deduplicates per page, one merges the counts per indicator.
        """
        found = X.with_ids(X.extract(pages.withColumn("key", F.struct("document_id", "page_number", "extracted_at")), "key", "text"))
        flat = found.select("key.*", "indicator_id", "type", "value", "normalized_value", F.col("start").alias("position"), "confidence", "context")
        counts = merge_counts(flat, "indicator_id", "extracted_at", ["type", "value", "normalized_value"])
        stored = self.indicators.select("indicator_id", "type", "value", "normalized_value", "first_seen", "last_seen", "occurrence_count")
        seen = stored.select("indicator_id", F.col("occurrence_count").alias("before"))
        fresh = counts.join(seen, "indicator_id", "left").withColumn("occurrence_count", F.col("occurrence_count") + F.coalesce("before", F.lit(0))).drop("before")
        merged = upsert(stored, fresh.select(*stored.columns), ["indicator_id"], ["type", "value", "normalized_value", "first_seen"])
        mentions = flat.select("indicator_id", "document_id", "context", "confidence", "page_number", "position", F.col("extracted_at").alias("created_at"))
        return {"indicators": merged, "mentions": latest(mentions, ["indicator_id", "document_id", "position"], ["created_at", "page_number"])}

    def search(self, query: str, limit: int = 20) -> DataFrame:
        """(score, type, id, content, source, metadata, highlights) of a query, by the path its words route it to."""
        row = router.routed(self.spark.createDataFrame([(query,)], "query string")).first()
        if row["path"] == "indicator":
            found = R.search(self.indicators, None, row["indicator_type"], limit)
            return self._results(found, F.lit(1.0), "indicator", "indicator_id", "value", F.lit("indicators"), {"indicator_type": "type", "occurrence_count": "occurrence_count"}, query)
        if row["path"] == "graph":
            near = self.relationships(row["node_id"] or "", row["hops"], limit)
            return self._results(near, 1 / (F.col("distance") + 1), "relationship", "indicator_id", "value", F.lit("relationships"), {"distance": "distance", "indicator_type": "type"}, query)
        if row["path"] == "pattern":
            clusters = G.ego_clusters(self.mentions, 2, 3, 10)
            return self._results(clusters, F.col("size") / 100, "cluster", "center", "center", F.lit("mentions"), {"size": "size"}, query)
        return self._results(self.semantic(query, limit), F.col("score"), "chunk", "id", "content", F.col("document_id"), {"page_numbers": "page_numbers", "chunk_index": "chunk_index"}, query)

    def _results(self, rows: DataFrame, score, kind: str, key: str, content: str, source, metadata: dict[str, str], query: str) -> DataFrame:
        """Rows in the one form of all results; highlights are the query's words that the content holds."""
        words = F.array_distinct(F.filter(F.split(F.lower(F.lit(query)), r"\W+"), lambda w: F.length(w) > 2))
        held = F.filter(words, lambda w: F.contains(F.lower(F.col(content)), w))
        pairs = F.create_map(*[x for name, column in metadata.items() for x in (F.lit(name), F.col(column).cast("string"))])
        return rows.select(score.cast("double").alias("score"), F.lit(kind).alias("type"), F.col(key).alias("id"), F.col(content).alias("content"), source.alias("source"), pairs.alias("metadata"), held.alias("highlights"))

    def embedded(self, dimension: int = 384) -> DataFrame:
        """(chunk_id, embedding) of all chunks by hashed words: to be stored once and given to semantic()."""
        return self.chunks.filter("content IS NOT NULL").select("chunk_id", V.hashed_embedding(F.col("content"), dimension).alias("embedding"))

    def semantic(self, query: str, limit: int = 10, threshold: float = 0.5, dimension: int = 384, stored: DataFrame | None = None) -> DataFrame:
        """(score, id, content, document_id, chunk_index, page_numbers) of the chunks most similar to a query, by hashed word vectors, above the threshold."""
        vectors = self.embedded(dimension) if stored is None else stored
        wanted = F.array(*[F.lit(float(x)) for x in V.hashed_vector(query, dimension)])
        scored = vectors.select(F.col("chunk_id").alias("id"), V.cosine(F.col("embedding"), wanted).alias("score")).filter(F.col("score") > threshold)
        best = scored.orderBy(F.desc("score"), "id").limit(limit)
        told = self.chunks.select(F.col("chunk_id").alias("id"), "content", "document_id", "chunk_index", "page_numbers")
        return told.join(F.broadcast(best), "id").select("score", "id", "content", "document_id", "chunk_index", "page_numbers").orderBy(F.desc("score"), "id")

    def lookup(self, kind: str, limit: int = 100) -> DataFrame:
        return R.by_type(self.indicators, kind, limit)

    def context(self, indicator_id: str, limit: int = 20) -> DataFrame:
        """One row with an indicator, its counts, its campaigns with their actors, its mentions with their documents (surest first) and the indicators linked to it; none if it is unknown."""
        one = self.spark.createDataFrame([(indicator_id,)], "id string")
        own = C.indicators(self.spark, self.folder, only=one)
        mentions = C.mentions(self.spark, self.folder, only=one)
        counts = R.context_counts(own, mentions, self.links).drop("value")
        campaigns = R.campaigns_with_actors(self.links).filter(F.col("indicator_id") == indicator_id).groupBy("indicator_id").agg(F.collect_list(F.struct("campaign", "actors")).alias("campaigns"))
        told = R.with_documents(mentions, self.documents).orderBy(F.desc_nulls_last("confidence"), "mention_id").limit(limit)
        listed = told.groupBy("indicator_id").agg(F.collect_list(F.struct("document_id", "title", "context", "confidence", "page_number", "position")).alias("mentions"))
        near = R.related(self.links, self.indicators, indicator_id, limit, directed=False).select(F.struct("indicator_id", "indicator_type", "value", "score").alias("r"))
        related = near.agg(F.collect_list("r").alias("related")).withColumn("indicator_id", F.lit(indicator_id))
        joined = own
        for part in (counts, campaigns, listed, related):
            joined = joined.join(part, "indicator_id", "left")
        return joined

    def relationships(self, indicator_id: str, hops: int = 2, limit: int = 50) -> DataFrame:
        """Indicators within 1 to 5 hops over links and shared documents, nearest and most frequent first."""
        edges = G.mention_edges(self.mentions).unionByName(self.links.select(F.concat(F.lit("i:"), "source").alias("u"), F.concat(F.lit("i:"), "target").alias("v")))
        near = G.neighbourhood(edges, f"i:{indicator_id}", min(5, max(1, hops))).filter("distance > 0 AND id LIKE 'i:%'")
        named = near.select(F.substring("id", 3, 1000).alias("indicator_id"), "distance").join(self.indicators, "indicator_id")
        return named.select("indicator_id", "type", "value", "distance", "occurrence_count").orderBy("distance", F.desc_nulls_last("occurrence_count"), "indicator_id").limit(limit)

    def network(self, center: str, hops: int = 1, limit: int = 100) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) around an indicator, campaign or actor within 1 to 3 hops, over the `limit` nearest links: nodes as (id, label, properties, distance), edges as
        (source, target, type, properties). Empty if nothing is linked to it."""
        links = self.links.select(F.col("source").alias("u"), F.col("target").alias("v"), "type", "score")
        near = G.neighbourhood(links, center, min(3, max(1, hops)))
        ends = links.join(near.select(F.col("id").alias("u"), F.col("distance").alias("from_u")), "u").join(near.select(F.col("id").alias("v"), F.col("distance").alias("from_v")), "v")
        order = (F.least("from_u", "from_v") + F.greatest("from_u", "from_v"), "u", "v", "type")
        edges = cut(ends.orderBy(*order).limit(min(500, max(10, limit))))
        touched = edges.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("from_u").alias("distance")), F.struct(F.col("v").alias("id"), F.col("from_v").alias("distance")))).alias("n")).select("n.*").distinct()
        campaign, actor = self.links.filter("type = 'PART_OF_CAMPAIGN'").select(F.col("target").alias("id")), self.links.filter("type = 'ATTRIBUTED_TO'").select(F.col("target").alias("id"))
        kinds = campaign.distinct().withColumn("kind", F.lit("Campaign")).unionByName(actor.distinct().withColumn("kind", F.lit("ThreatActor")))
        label = touched.join(kinds.groupBy("id").agg(F.min("kind").alias("kind")), "id", "left")
        known = label.join(self.indicators.withColumnRenamed("indicator_id", "id"), "id", "left")
        names = F.map_filter(F.create_map(*[x for c in ("type", "value", "first_seen", "last_seen", "occurrence_count") for x in (F.lit(c), F.col(c).cast("string"))]), lambda _, v: v.isNotNull())
        nodes = known.select("id", F.coalesce("kind", F.lit("Indicator")).alias("label"), names.alias("properties"), "distance")
        scored = F.map_filter(F.create_map(F.lit("score"), F.col("score").cast("string")), lambda _, v: v.isNotNull())
        return nodes, edges.select(F.col("u").alias("source"), F.col("v").alias("target"), "type", scored.alias("properties"))

    def campaign(self, name: str) -> DataFrame:
        return R.campaign_members(self.links, self.indicators, name)

    def clusters(self, smallest: int = 2, limit: int = 10) -> DataFrame:
        """(component, size) of the largest groups of indicators that share documents, directly or through others."""
        groups = G.components(G.cooccurrence(self.mentions).select(F.col("indicator_a").alias("u"), F.col("indicator_b").alias("v")))
        sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= smallest)
        return sizes.orderBy(F.desc("size"), "component").limit(limit)

    def patterns(self) -> DataFrame:
        """(pattern_type, subject, confidence): members of several campaigns and types that dominate."""
        cross = G.cross_campaign(self.links).select(F.lit("cross_campaign_indicator").alias("pattern_type"), F.col("indicator_id").alias("subject"), "confidence")
        return cross.unionByName(G.dominant_types(self.indicators).select(F.lit("dominant_indicator_type").alias("pattern_type"), F.col("type").alias("subject"), F.col("ratio").alias("confidence")))

    def timeline(self, indicator_id: str, days: int = 30) -> DataFrame:
        return R.timeline(self.mentions, indicator_id, days)

    def statistics(self) -> DataFrame:
        """(what, n): rows of the tables, indicators by type, links by type, campaigns and actors."""
        stored = R.store_statistics(self.documents, self.indicators, self.mentions, self.chunks)
        links = self.links.groupBy(F.concat(F.lit("links:"), "type").alias("what")).agg(F.count(F.lit(1)).alias("n"))
        named = [self.links.filter(F.col("type") == kind).agg(F.count_distinct("target").alias("n")).select(F.lit(what).alias("what"), "n") for what, kind in (("campaigns", "PART_OF_CAMPAIGN"), ("actors", "ATTRIBUTED_TO"))]
        return stored.unionByName(links).unionByName(named[0]).unionByName(named[1])

    def pages(self) -> DataFrame:
        return table(self.spark, self.folder, "pdf_pages")
