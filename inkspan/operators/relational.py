"""Lookup, context, statistics and search queries over the canonical tables (arguments are DataFrames with their columns).

Every top-k report is ordered to the last tie by an id, so that its rows are defined; `limit` is part of such a report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_type(indicators: DataFrame, kind: str, limit: int = 100) -> DataFrame:
    """Indicators of a type, most frequent first."""
    return indicators.filter(F.col("type") == kind).orderBy(F.desc_nulls_last("occurrence_count"), "indicator_id").limit(limit)


def search(indicators: DataFrame, pattern: str | None = None, kind: str | None = None, limit: int = 100) -> DataFrame:
    """Indicators whose value or normalised value holds the pattern, letter case aside; `%` and `_` are wildcards."""
    if kind:
        indicators = indicators.filter(F.col("type") == kind)
    if pattern:
        indicators = indicators.filter(F.col("value").ilike(f"%{pattern}%") | F.col("normalized_value").ilike(f"%{pattern}%"))
    return indicators.orderBy(F.desc_nulls_last("occurrence_count"), "indicator_id").limit(limit)


def with_documents(mentions: DataFrame, documents: DataFrame) -> DataFrame:
    """Mentions with the title and source of their documents; those of unknown documents are left out."""
    titles = documents.select(F.col("doc_id").alias("document_id"), "title", "source")
    return mentions.join(titles, "document_id")


def mentions_of(mentions: DataFrame, documents: DataFrame, indicator_id: str) -> DataFrame:
    """Mentions of one indicator with their documents."""
    own = with_documents(mentions.filter(F.col("indicator_id") == indicator_id), documents)
    return own.select("mention_id", "document_id", "title", "source", "context", "confidence", "page_number", "position")


def links_of(links: DataFrame, ids: DataFrame, directed: bool = True) -> DataFrame:
    """(indicator_id, type, score) of the other ends of the links of a few ids, a table of one column; undirected takes links from either end."""
    few = F.broadcast(ids.select(F.col(ids.columns[0]).alias("own")))
    out = links.join(few, F.col("source") == F.col("own")).select(F.col("target").alias("indicator_id"), "type", "score")
    if not directed:
        out = out.unionByName(links.join(few, F.col("target") == F.col("own")).select(F.col("source").alias("indicator_id"), "type", "score"))
    return out


def related_to(ends: DataFrame, indicators: DataFrame, limit: int = 20) -> DataFrame:
    """The indicators at the other ends of links, by correlation score."""
    best = ends.groupBy("indicator_id").agg(F.max("score").alias("score"))
    found = best.join(indicators.select("indicator_id", F.col("type").alias("indicator_type"), "value"), "indicator_id")
    return found.orderBy(F.desc_nulls_last("score"), "indicator_id").limit(limit)


def related(links: DataFrame, indicators: DataFrame, indicator_id: str, limit: int = 20, directed: bool = True) -> DataFrame:
    """Indicators linked to one, by correlation score; undirected takes links from either end."""
    one = links.sparkSession.createDataFrame([(indicator_id,)], "id string")
    return related_to(links_of(links, one, directed), indicators, limit)


def campaigns_with_actors(links: DataFrame) -> DataFrame:
    """(indicator_id, campaign, actors): campaigns of every indicator, with their attributed actors or an empty array."""
    member = links.filter(F.col("type") == "PART_OF_CAMPAIGN").select(F.col("source").alias("indicator_id"), F.col("target").alias("campaign"))
    actor = links.filter(F.col("type") == "ATTRIBUTED_TO").select(F.col("source").alias("campaign"), F.col("target").alias("actor"))
    return member.join(actor, "campaign", "left").groupBy("indicator_id", "campaign").agg(F.sort_array(F.collect_set("actor")).alias("actors"))


def context_counts(indicators: DataFrame, mentions: DataFrame, links: DataFrame) -> DataFrame:
    """(indicator_id, value, n_mentions, n_documents, n_campaigns, n_related) of every indicator."""
    met = mentions.groupBy("indicator_id").agg(F.count(F.lit(1)).alias("n_mentions"), F.count_distinct("document_id").alias("n_documents"))
    member = links.filter(F.col("type") == "PART_OF_CAMPAIGN").groupBy(F.col("source").alias("indicator_id")).agg(F.count_distinct("target").alias("n_campaigns"))
    ends = links.filter(F.col("type") == "RELATED_TO").select(F.explode(F.array(F.struct(F.col("source").alias("indicator_id"), F.col("target").alias("other")), F.struct(F.col("target").alias("indicator_id"), F.col("source").alias("other")))).alias("e")).select("e.*")
    near = ends.filter("indicator_id <> other").groupBy("indicator_id").agg(F.count_distinct("other").alias("n_related"))
    joined = indicators.select("indicator_id", "value").join(met, "indicator_id", "left").join(member, "indicator_id", "left").join(near, "indicator_id", "left")
    return joined.fillna(0, ["n_mentions", "n_documents", "n_campaigns", "n_related"])


def store_statistics(documents: DataFrame, indicators: DataFrame, mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(what, n): rows of each table and indicators of each type."""
    parts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n") for name, t in (("documents", documents), ("indicators", indicators), ("mentions", mentions), ("chunks", chunks))]
    parts.append(indicators.groupBy(F.concat(F.lit("type:"), F.col("type")).alias("what")).agg(F.count(F.lit(1)).alias("n")).filter("what IS NOT NULL"))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def graph_statistics(documents: DataFrame, indicators: DataFrame, mentions: DataFrame, links: DataFrame) -> DataFrame:
    """One row of counts and the sorted indicator types; each side is a one-row aggregate."""
    one = lambda t, *aggs: t.agg(*aggs)
    return (
        one(documents, F.count(F.lit(1)).alias("documents"))
        .crossJoin(one(indicators, F.count(F.lit(1)).alias("indicators"), F.sort_array(F.collect_set("type")).alias("types")))
        .crossJoin(one(mentions, F.count_distinct("indicator_id", "document_id").alias("mention_edges")))
        .crossJoin(one(links.filter("type = 'PART_OF_CAMPAIGN'"), F.count_distinct("target").alias("campaigns")))
        .crossJoin(one(links.filter("type = 'ATTRIBUTED_TO'"), F.count_distinct("target").alias("actors")))
    )


def indicator_statistics(indicators: DataFrame, mentions: DataFrame) -> DataFrame:
    """Per type: joined rows, indicators, documents, mean confidence, latest sighting.

    Mentions are counted per indicator before the join, except for the distinct documents, which need the type: their pairs are
    deduplicated first, so no type's rows meet in one task.
    """
    per = mentions.groupBy("indicator_id").agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("conf"), F.count("confidence").alias("n_conf"))
    typed = indicators.select("indicator_id", "type", "last_seen").join(per, "indicator_id", "left")
    whole = typed.groupBy("type").agg(
        F.sum(F.coalesce("n", F.lit(1))).alias("total_count"), F.count(F.lit(1)).alias("indicator_count"), (F.sum("conf") / F.sum("n_conf")).alias("avg_confidence"), F.max("last_seen").alias("most_recent")
    )
    pairs = mentions.select("indicator_id", "document_id").join(indicators.select("indicator_id", "type"), "indicator_id").select("type", "document_id").distinct()
    docs = pairs.groupBy("type").agg(F.count(F.lit(1)).alias("document_count"))
    joined = whole.join(docs.withColumnRenamed("type", "t"), F.col("type").eqNullSafe(F.col("t")), "left").drop("t")
    return joined.fillna(0, ["document_count"])


def sharing_documents(mentions: DataFrame, indicators: DataFrame, target: DataFrame, threshold: float = 0.5, limit: int = 10) -> DataFrame:
    """Indicators by the share of the target's mention rows whose documents they share; repeats can lift it above 1. target: a table of one id.

    Both sides are counted per document and indicator before they meet, so the join has one row of the target per document.
    """
    counts = mentions.groupBy("document_id", "indicator_id").agg(F.count(F.lit(1)).alias("rows"))
    one = F.broadcast(target.select(F.col(target.columns[0]).alias("own_id")))
    mine = counts.join(one, F.col("indicator_id") == F.col("own_id")).select("document_id", F.col("rows").alias("own_rows"))
    n = mine.agg(F.sum("own_rows").alias("target_rows"))
    theirs = counts.join(one, F.col("indicator_id") == F.col("own_id"), "left_anti")
    common = theirs.join(mine, "document_id").groupBy("indicator_id").agg(F.sum(F.col("rows") * F.col("own_rows")).alias("common"))
    scored = common.crossJoin(F.broadcast(n)).withColumn("score", F.col("common") / F.col("target_rows")).filter(F.col("score") >= threshold)  # one row
    found = scored.join(indicators.select("indicator_id", "type", "value"), "indicator_id").select("indicator_id", "type", "value", "score")
    return found.orderBy(F.desc("score"), "indicator_id").limit(limit)


def similar_indicators(mentions: DataFrame, indicators: DataFrame, indicator_id: str, threshold: float = 0.5, limit: int = 10) -> DataFrame:
    """The same for one id."""
    return sharing_documents(mentions, indicators, mentions.sparkSession.createDataFrame([(indicator_id,)], "id string"), threshold, limit)


def timeline(mentions: DataFrame, indicator_id: str | None = None, days: int | None = 30, anchor: Column | None = None) -> DataFrame:
    """(date, mention_count, unique_documents) per day; the last days before the anchor (the latest mention unless given)."""
    own = mentions.filter(F.col("indicator_id") == indicator_id) if indicator_id else mentions
    if days is not None:
        latest = own.agg(F.to_date(F.max("created_at")).alias("anchor"))
        own = own.crossJoin(F.broadcast(latest)) if anchor is None else own.withColumn("anchor", anchor)
        own = own.filter(F.col("created_at") >= F.date_sub("anchor", days))
    dated = own.filter(F.col("created_at").isNotNull()).groupBy(F.to_date("created_at").alias("date"), "document_id").agg(F.count(F.lit(1)).alias("n"))
    return dated.groupBy("date").agg(F.sum("n").alias("mention_count"), F.count("document_id").alias("unique_documents"))


#: Words that full-text search ignores.
STOP_WORDS = frozenset("a an and are as at be by for from has in is it of on or that the this to was were will with".split())


def terms(text: Column) -> Column:
    """Lower-case words of a text without stop words, with plain English endings cut, each once."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+", " "), " ")
    cut = lambda w: F.regexp_replace(w, r"^([a-z]{3,}?)(?:ies|es|s|ing|ed)$", "$1")
    kept = F.filter(words, lambda w: (w != "") & ~w.isin(*sorted(STOP_WORDS)))
    return F.transform(kept, cut)


def full_text(documents: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """(doc_id, title, source, rank): documents whose title and source hold all query terms; rank is the terms' share of the words."""
    wanted = F.array_distinct(terms(F.lit(query)))
    words = terms(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("source", F.lit(""))))
    rows = documents.select("doc_id", "title", "source", words.alias("words"), wanted.alias("wanted"))
    matched = rows.filter((F.size("wanted") > 0) & (F.size(F.array_except("wanted", "words")) == 0))
    rank = F.size(F.filter("words", lambda w: F.array_contains("wanted", w))) / F.size("words")
    return matched.select("doc_id", "title", "source", F.round(rank, 6).alias("rank")).orderBy(F.desc("rank"), "doc_id").limit(limit)


def campaign_members(links: DataFrame, indicators: DataFrame, campaign: str) -> DataFrame:
    """Indicators of one campaign."""
    member = links.filter((F.col("type") == "PART_OF_CAMPAIGN") & (F.col("target") == campaign)).select(F.col("source").alias("indicator_id"))
    return indicators.join(member, "indicator_id", "left_semi")


def mention_filter(kinds: list[str] | None = None, least: float | None = None, since=None, until=None) -> Column:
    """A predicate over mentions joined with indicators: types, confidence (clamped to 0..1), dates."""
    condition = F.lit(True)
    if kinds:
        condition &= F.col("type").isin(*kinds)
    if least is not None:
        condition &= F.col("confidence") >= min(1.0, max(0.0, least))
    if since is not None:
        condition &= F.col("created_at") >= F.lit(since).cast("timestamp_ntz")
    if until is not None:
        condition &= F.col("created_at") <= F.lit(until).cast("timestamp_ntz")
    return condition


def trigram_similarity(left: Column, right: Column) -> Column:
    """Jaccard similarity of the trigrams of two strings, padded and in lower case."""

    def grams(text: Column) -> Column:
        padded = F.concat(F.lit("  "), F.lower(text), F.lit(" "))
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))

    a, b = grams(left), grams(right)
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
