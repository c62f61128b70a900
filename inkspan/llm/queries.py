"""The pN_ queries of this package and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.llm.components import connected_groups, related_links
from inkspan.llm.cooccurrence import basket_items, frequent_pairs
from inkspan.llm.languages import chunk_languages, document_languages, fit, page_languages, wrong_labels
from inkspan.llm.leaks import find_leaks
from inkspan.llm.list_pages import list_pages
from inkspan.llm.mixing import mixture, shares
from inkspan.llm.neighbours import nearest_vectors, neighbour_pairs, usable_vectors
from inkspan.llm.scan_repair import lexicon_of, page_defects, page_paragraphs, running_lines
from inkspan.skew import cut
from inkspan.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of pages that are running heads or page numbers, end inside a word, or have a misread word."""
    pages = table(spark, folder, "pdf_pages")
    return page_defects(pages, lexicon_of(pages), running_lines(pages)).distinct()


def p1_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """The pages' text as repaired continuous paragraphs."""
    pages = table(spark, folder, "pdf_pages")
    return page_paragraphs(pages, lexicon_of(pages), running_lines(pages))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The group of every record linked by RELATED_TO."""
    return connected_groups(related_links(table(spark, folder, "graph_relationships")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of chunks of which at least one is among the 10 nearest of the other."""
    vectors = usable_vectors(table(spark, folder, "document_chunks"), "chunk_id", "embedding", 384)
    return neighbour_pairs(nearest_vectors(vectors)).selectExpr("first AS chunk_a", "second AS chunk_b").distinct()


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Wrong labels of pages and chunks, segments of mixed pages, languages amiss of documents."""
    model = fit(table(spark, folder, "lang_samples"))
    pages = cut(page_languages(table(spark, folder, "pdf_pages"), model))
    return wrong_labels(pages, chunk_languages(table(spark, folder, "document_chunks"), model), table(spark, folder, "pdf_documents"))


def p4_languages(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every page, paragraph, chunk and segment of a mixed chunk with its confidence (4 decimals), and the languages of every document."""
    model = fit(table(spark, folder, "lang_samples"))
    pages = cut(page_languages(table(spark, folder, "pdf_pages"), model))
    of_pages = pages.selectExpr("'page' AS kind", "string(page_id) AS record_key", "0 AS segment_no", "lang", "round(confidence, 4) AS confidence")
    segments = pages.selectExpr("page_id", "explode(paragraphs) AS p").selectExpr("'segment'", "string(page_id)", "p.no", "p.lang", "round(p.confidence, 4)")
    judged = chunk_languages(table(spark, folder, "document_chunks"), model)
    mixed = "if(size(segments) > 1, transform(segments, s -> named_struct('kind', 'chunk_segment', 'no', s.no, 'lang', s.lang, 'confidence', s.confidence)), array())"
    rows = judged.selectExpr("chunk_id", f"explode(concat(array(named_struct('kind', 'chunk', 'no', 0, 'lang', lang, 'confidence', confidence)), {mixed})) AS r")
    chunks = rows.selectExpr("r.kind", "chunk_id", "r.no", "r.lang", "round(r.confidence, 4)")
    documents = document_languages(pages).selectExpr("'document'", "document_id", "0", "explode(used)", "double(null)")
    return of_pages.union(segments).union(chunks).union(documents).filter("lang IS NOT NULL").distinct()


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    return frequent_pairs(basket_items(table(spark, folder, "indicator_mentions"), "document_id", "indicator_id"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of indicators that share at least 4 documents, at least 5 times as often as by chance."""
    return _pairs(spark, folder).selectExpr("item_a AS indicator_a", "item_b AS indicator_b")


def p5_pair_measures(spark: SparkSession, folder: str) -> DataFrame:
    """The same pairs with their counts, lift and pointwise mutual information, rounded to 6 decimals."""
    names = ["item_a AS indicator_a", "item_b AS indicator_b", "n_ab", "n_a", "n_b", "n", "round(lift, 6) AS lift", "round(pmi, 6) AS pmi"]
    return _pairs(spark, folder).selectExpr(*names)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold at least 15 words of a test item, with the item."""
    return find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id").distinct()


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The texts of the mixture in the order of their slots."""
    return mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of every source of the mixture."""
    return shares(p8_mixture(spark, folder), table(spark, folder, "mix_targets")).withColumn("actual_share", F.round("actual_share", 6))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of which more than half of the characters are list text."""
    return list_pages(table(spark, folder, "documents")).selectExpr("id AS doc_id").distinct()


_TRIM = r"E' \t\n\r\f\v'"

_LINKS = rf"""
WITH RECURSIVE links AS (
  SELECT DISTINCT lower(trim(source_id, {_TRIM})) AS u, lower(trim(target_id, {_TRIM})) AS v FROM graph_relationships
  WHERE regexp_matches(lower(trim(relationship_type, {_TRIM})), '^related[_ -]to$')
    AND trim(source_id, {_TRIM}) <> '' AND trim(target_id, {_TRIM}) <> ''),
both_ways AS (SELECT u, v FROM links UNION SELECT v, u FROM links UNION SELECT u, u FROM links UNION SELECT v, v FROM links),
reach AS (SELECT u, v FROM both_ways UNION SELECT r.u, b.v FROM reach r JOIN both_ways b ON r.v = b.u)
"""

_PAIRS = rf"""
WITH item AS (
  SELECT DISTINCT lower(trim(document_id, {_TRIM})) AS d, lower(trim(indicator_id, {_TRIM})) AS i FROM indicator_mentions
  WHERE trim(document_id, {_TRIM}) <> '' AND trim(indicator_id, {_TRIM}) <> ''),
total AS (SELECT count(DISTINCT d) AS n FROM item),
marginal AS (SELECT i, count(*) AS n_i FROM item GROUP BY i),
pair AS (SELECT x.i AS a, y.i AS b, count(*) AS n_ab FROM item x JOIN item y ON x.d = y.d AND x.i < y.i GROUP BY 1, 2 HAVING count(*) >= 4),
kept AS (SELECT a, b, n_ab, p.n_i AS n_a, q.n_i AS n_b, n FROM pair JOIN marginal p ON p.i = a JOIN marginal q ON q.i = b, total
  WHERE n_ab * n >= 5 * p.n_i * q.n_i)
"""

QUERIES = {"p1_found": p1_found, "p1_paragraphs": p1_paragraphs, "p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p4_languages": p4_languages, "p5_found": p5_found, "p5_pair_measures": p5_pair_measures, "p7_found": p7_found, "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p9_found": p9_found}
SQL = {
    "p2_found": _LINKS + "SELECT u AS record_id, min(v) AS group_id FROM reach GROUP BY u",
    "p5_found": _PAIRS + "SELECT a AS indicator_a, b AS indicator_b FROM kept",
    "p5_pair_measures": _PAIRS
    + """SELECT a AS indicator_a, b AS indicator_b, n_ab, n_a, n_b, n,
        round(n_ab * n / (n_a * n_b), 6) AS lift, round(log2(n_ab * n / (n_a * n_b)), 6) AS pmi FROM kept""",
}
