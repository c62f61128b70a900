"""Queries on chunking, vectors and page texts, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspan.functions.text import collapse
from inkspan.operators import chunking as K
from inkspan.operators import vectors as V
from inkspan.plans import catalog as C
from inkspan.plans.catalog import with_views
from inkspan.sources.tables import table


def _pages(spark, folder):
    return table(spark, folder, "pdf_pages").select("page_id", "document_id", "page_number", "text").filter("text IS NOT NULL AND document_id IS NOT NULL")


def sliding_chunks(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text").filter("text IS NOT NULL")
    return K.sliding_chunks(docs, "doc_id", "text", 128, 32)


def sentence_counts(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", K.sentences(F.col("text")).alias("s")).filter("s IS NOT NULL")
    return docs.select("doc_id", F.size("s").alias("sentences"), F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).alias("longest"))


def chunk_ids(spark, folder):
    rows = C.chunks(spark, folder).filter("content IS NOT NULL AND document_id IS NOT NULL AND chunk_index IS NOT NULL")
    return rows.select("chunk_id", K.chunk_id(F.col("document_id"), F.col("chunk_index"), F.col("content")).alias("computed_id"))


def fit_chunks(spark, folder):
    return K.fit(C.chunks(spark, folder).select("chunk_id", "content"), smallest=200)


def page_chunks(spark, folder):
    return K.page_chunks(_pages(spark, folder), 64, 16)


def merged_page_chunks(spark, folder):
    """Pages as chunks, joined in pairs of consecutive pages that fit."""
    return K.merge_pages(_page_rows(spark, folder), 1500).withColumn("pages", F.array_join(F.transform("pages", lambda p: p.cast("string")), ","))


def _page_rows(spark, folder):
    pages = _pages(spark, folder).filter("page_number IS NOT NULL").groupBy("document_id", "page_number").agg(F.min_by("text", "page_id").alias("content"))
    return pages.select("document_id", F.col("page_number").alias("chunk_index"), "page_number", "content")


def chunk_stats(spark, folder):
    found = K.statistics(C.chunks(spark, folder).filter("content IS NOT NULL"))
    return found.withColumns({c: F.round(c, 6) for c in ("mean_size", "deviation")})


def semantic_chunks(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text").filter("text IS NOT NULL")
    return K.semantic_chunks(docs, "doc_id", "text", 200, 40, 30)


def vector_topk(spark, folder):
    rows = table(spark, folder, "embeddings")
    query = rows.orderBy("vec_id").first()["embedding"]
    return V.top_k(rows, "vec_id", "embedding", query, 20, 0.1, strict=True).withColumn("similarity", F.round("similarity", 6))


def chunk_topk(spark, folder):
    """The chunks most similar to the first usable one, from cosine 0.2 on."""
    rows = table(spark, folder, "document_chunks").select("chunk_id", "embedding").filter("size(embedding) = 384 AND forall(embedding, x -> NOT isnan(x) AND abs(x) < float('infinity')) AND exists(embedding, x -> x <> 0)")
    rows = rows.groupBy("chunk_id").agg(F.min_by("embedding", F.xxhash64("embedding")).alias("embedding"))
    query = rows.orderBy("chunk_id").first()["embedding"]
    return V.top_k(rows, "chunk_id", "embedding", query, 20, 0.2).withColumn("similarity", F.round("similarity", 5))


def vector_inner_topk(spark, folder):
    rows = table(spark, folder, "embeddings")
    query = rows.orderBy("vec_id").first()["embedding"]
    return V.top_k_inner(rows, "vec_id", "embedding", query, 20).withColumn("score", F.round("score", 6))


def vector_norms(spark, folder):
    return table(spark, folder, "embeddings").groupBy("label").agg(F.round(F.avg(V.norm(F.col("embedding"))), 6).alias("mean_norm"), F.count(F.lit(1)).alias("n"))


def embedding_cache_misses(spark, folder):
    """Distinct chunk texts that aren't the text of an indexed (embedded) chunk."""
    chunks = table(spark, folder, "document_chunks")
    cached = chunks.filter("embedding IS NOT NULL AND content IS NOT NULL").select(F.md5("content").alias("text_key"))
    return V.cache_misses(chunks, "content", cached).select("text_key", F.length("text").alias("n_chars"))


def hashed_embeddings(spark, folder):
    """Signed word-hash vectors of 64 places of all chunk texts."""
    rows = table(spark, folder, "document_chunks").select("chunk_id", V.hashed_embedding(F.col("content"), 64).alias("embedding")).filter("embedding IS NOT NULL")
    return rows.select("chunk_id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding")).distinct()


def vector_stats(spark, folder):
    return V.statistics(table(spark, folder, "document_chunks").select("document_id", "embedding"))


def delete_chunks(spark, folder):
    """Chunks of documents that the deletion log doesn't name."""
    from inkspan.operators.upsert import delete_where

    gone = table(spark, folder, "deleted_records").filter("table_name = 'pdf_documents'").select("record_key").distinct()
    return delete_where(C.chunks(spark, folder), "document_id", gone).select("chunk_id", "document_id")


def relabelled_chunks(spark, folder):
    """Chunk labels of unknown languages set to null."""
    from inkspan.operators.upsert import update_where

    unknown = F.lower("language").isin("xx", "und", "n/a", "unknown", "")
    return update_where(C.chunks(spark, folder), unknown, language=F.lit(None)).select("chunk_id", "language")


def text_hashes(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


def needs_ocr(spark, folder):
    text = F.coalesce("text", F.lit(""))
    return table(spark, folder, "pdf_pages").select("page_id", (F.length(F.regexp_replace(text, r"^\s+|\s+$", "")) < 50).alias("needs_ocr"))


def text_export(spark, folder):
    """Each document's pages in order, joined by blank lines."""
    pages = _pages(spark, folder).filter("page_number IS NOT NULL").groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("page_number", "page_id", "text"))).alias("p"))
    return pages.select("document_id", F.array_join(F.transform("p", lambda p: p["text"]), "\n\n").alias("text")).select("document_id", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


def layout_counts(spark, folder):
    pages = table(spark, folder, "pdf_pages")
    return pages.groupBy("layout_type").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("text")).alias("n_chars"))


def title_words(spark, folder):
    """Titles with white space collapsed, and their first word."""
    rows = C.documents(spark, folder).filter("title IS NOT NULL").select("doc_id", collapse(F.col("title")).alias("title"))
    return rows.withColumn("first_word", F.split_part("title", F.lit(" "), F.lit(1)))


QUERIES = {f.__name__: f for f in (
    sliding_chunks, sentence_counts, chunk_ids, fit_chunks, page_chunks, merged_page_chunks, chunk_stats, semantic_chunks, vector_topk, chunk_topk, vector_inner_topk, vector_norms, embedding_cache_misses,
    hashed_embeddings, vector_stats, delete_chunks, relabelled_chunks, text_hashes, needs_ocr, text_export, layout_counts, title_words,
)}

_WORDS = r"list_filter(string_split_regex(replace(text, chr(0), ''), '\s+'), lambda w: w <> '')"
_CHUNKED = """, n AS (SELECT *, len(w) AS n FROM w), k AS (SELECT *, unnest(range(0, CASE WHEN n <= {size} THEN least(n, 1) ELSE ceil((n - {overlap}) / {step}) END::BIGINT)) AS i FROM n)"""
_SENT = r"list_filter(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"
_FINITE = "len(embedding) = 384 AND len(list_filter(embedding, lambda x: isfinite(x))) = 384 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"

SQL = {
    "sliding_chunks": f"WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL)" + _CHUNKED.format(size=128, overlap=32, step=96)
    + " SELECT doc_id, i AS chunk_index, array_to_string(w[i * 96 + 1 : i * 96 + 128], ' ') AS content, i * 96 AS start_word, least(i * 96 + 128, n) AS end_word FROM k",
    "sentence_counts": f"WITH s AS (SELECT doc_id, {_SENT} AS s FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(s) AS sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS longest FROM s",
    "chunk_ids": with_views("c", " SELECT chunk_id, md5(document_id || '_' || chunk_index || '_' || substring(content, 1, 50)) AS computed_id FROM c WHERE content IS NOT NULL AND document_id IS NOT NULL AND chunk_index IS NOT NULL"),
    "fit_chunks": with_views("c", r" SELECT chunk_id, trim(regexp_replace(content, '\s+', ' ', 'g')) AS content FROM c WHERE length(trim(content)) >= 200"),
    "page_chunks": f"""WITH w AS (SELECT document_id, page_number, page_id, text, coalesce(sum(length(text)) OVER (PARTITION BY document_id ORDER BY page_number, page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset",
      {_WORDS} AS w FROM pdf_pages WHERE text IS NOT NULL AND document_id IS NOT NULL)""" + _CHUNKED.format(size=64, overlap=16, step=48)
    + """ SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY page_number, page_id, i) - 1 AS chunk_index, page_number, page_id, array_to_string(w[i * 48 + 1 : i * 48 + 64], ' ') AS content, "offset" FROM k""",
    "chunk_stats": with_views("c", """ , x AS (SELECT coalesce(language, '') AS language, content, indicators_count FROM c WHERE content IS NOT NULL UNION ALL SELECT '*', content, indicators_count FROM c WHERE content IS NOT NULL)
      SELECT language, count(*) AS chunks, round(avg(length(content)), 6) AS mean_size, min(length(content)) AS least, max(length(content)) AS most, round(stddev_pop(length(content)), 6) AS deviation, sum(indicators_count) AS indicators FROM x GROUP BY 1"""),
    "vector_topk": """WITH q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) AS s FROM embeddings, q)
      SELECT vec_id, round(s, 6) AS similarity FROM s WHERE s > 0.1 ORDER BY s DESC, vec_id LIMIT 20""",
    "chunk_topk": f"""WITH r AS (SELECT DISTINCT ON (chunk_id) chunk_id, embedding FROM document_chunks WHERE {_FINITE}), q AS (SELECT embedding AS e FROM r ORDER BY chunk_id LIMIT 1),
      s AS (SELECT chunk_id, list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) AS s FROM r, q) SELECT chunk_id, round(s, 5) AS similarity FROM s WHERE s >= 0.2 ORDER BY s DESC, chunk_id LIMIT 20""",
    "vector_inner_topk": """WITH q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT vec_id, list_dot_product(embedding::DOUBLE[], e::DOUBLE[]) AS s FROM embeddings, q)
      SELECT vec_id, round(s, 6) AS score FROM s ORDER BY s DESC, vec_id LIMIT 20""",
    "vector_norms": "SELECT label, round(avg(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS mean_norm, count(*) AS n FROM embeddings GROUP BY 1",
    "embedding_cache_misses": """SELECT DISTINCT md5(content) AS text_key, length(content) AS n_chars FROM document_chunks WHERE content IS NOT NULL
      AND md5(content) NOT IN (SELECT md5(content) FROM document_chunks WHERE embedding IS NOT NULL AND content IS NOT NULL)""",
    "hashed_embeddings": r"""WITH w AS (SELECT DISTINCT chunk_id, content, list_transform(regexp_extract_all(lower(content), '[\p{L}\p{N}]+'), lambda w: ('0x' || substr(md5(w), 1, 16))::UBIGINT) AS h FROM document_chunks WHERE content IS NOT NULL),
      p AS (SELECT chunk_id, unnest(h) % 64 AS place, CASE WHEN (unnest(h) >> 32) & 1 = 1 THEN 1 ELSE -1 END AS sign, content FROM w),
      n AS (SELECT chunk_id, content, place, sum(sign)::DOUBLE AS x FROM p GROUP BY 1, 2, 3), l AS (SELECT chunk_id, content, sqrt(sum(x * x)) AS norm FROM n GROUP BY 1, 2),
      g AS (SELECT w.chunk_id, w.content, k AS place FROM w, range(64) t(k))
      SELECT chunk_id, list(value ORDER BY place) AS embedding FROM (SELECT g.chunk_id, g.content, g.place, CASE WHEN coalesce(norm, 0) > 0 THEN round(coalesce(x, 0) / norm, 6) ELSE 0.0 END AS value
        FROM g LEFT JOIN n USING (chunk_id, content, place) LEFT JOIN l USING (chunk_id, content)) GROUP BY chunk_id, content""",
    "merged_page_chunks": """WITH RECURSIVE p AS (SELECT document_id, page_number, arg_min(text, page_id) AS content FROM pdf_pages WHERE text IS NOT NULL AND document_id IS NOT NULL AND page_number IS NOT NULL GROUP BY 1, 2),
      o AS MATERIALIZED (SELECT document_id, page_number, content, row_number() OVER w AS k, coalesce(lead(page_number) OVER w = page_number + 1 AND length(content) + length(lead(content) OVER w) <= 1500, false) AS joins,
        lead(content) OVER w AS after, lead(page_number) OVER w AS next_page FROM p WINDOW w AS (PARTITION BY document_id ORDER BY page_number)),
      r AS (SELECT o.*, 0 AS chunk_index FROM o WHERE k = 1 UNION ALL SELECT o.*, r.chunk_index + 1 FROM r JOIN o ON o.document_id = r.document_id AND o.k = r.k + CASE WHEN r.joins THEN 2 ELSE 1 END)
      SELECT document_id, chunk_index, CASE WHEN joins THEN page_number || ',' || next_page ELSE page_number::VARCHAR END AS pages, CASE WHEN joins THEN content || ' ' || after ELSE content END AS content FROM r""",
    "vector_stats": "SELECT count(*) AS chunks, count(embedding) AS embedded, count(DISTINCT document_id) AS documents FROM document_chunks",
    "delete_chunks": with_views("c", " SELECT chunk_id, document_id FROM c WHERE document_id IS NULL OR document_id NOT IN (SELECT record_key FROM deleted_records WHERE table_name = 'pdf_documents' AND record_key IS NOT NULL)"),
    "relabelled_chunks": with_views("c", " SELECT chunk_id, CASE WHEN lower(language) IN ('xx', 'und', 'n/a', 'unknown', '') THEN NULL ELSE language END AS language FROM c"),
    "text_hashes": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "needs_ocr": r"SELECT page_id, length(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) < 50 AS needs_ocr FROM pdf_pages",
    "text_export": """WITH t AS (SELECT document_id, string_agg(text, chr(10) || chr(10) ORDER BY page_number, page_id) AS text FROM pdf_pages WHERE text IS NOT NULL AND document_id IS NOT NULL AND page_number IS NOT NULL GROUP BY 1)
      SELECT document_id, length(text) AS n_chars, md5(text) AS text_md5 FROM t""",
    "layout_counts": "SELECT layout_type, count(*) AS pages, sum(length(text)) AS n_chars FROM pdf_pages GROUP BY 1",
    "title_words": with_views("d", r" , t AS (SELECT doc_id, trim(regexp_replace(title, '\s+', ' ', 'g')) AS title FROM d WHERE title IS NOT NULL) SELECT doc_id, title, string_split(title, ' ')[1] AS first_word FROM t"),
}
