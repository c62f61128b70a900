"""Extraction queries over the contexts of mentions and the pages, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspan.functions import text as T
from inkspan.functions.patterns import CALLING_CODES, CRYPTO, HASHES, LOOSE, PATTERNS, RESERVED_IPV4, SOCIAL, SUFFIXES, TRACKING, WHITELIST
from inkspan.operators import extract as X
from inkspan.skew import spread
from inkspan.sources.tables import table

#: The reserved names that the hosts of the test tables end in count as public suffixes here.
HOSTS = (*SUFFIXES, "example", "test", "invalid")


def _contexts(spark, folder):
    return table(spark, folder, "indicator_mentions").select("mention_id", "context").filter("context IS NOT NULL")


def _values(spark, folder, found):
    flat = _contexts(spark, folder).select("mention_id", F.explode(found).alias("x"))
    return flat.select("mention_id", "x.type", "x.value", "x.normalized_value", "x.start")


def extract_url(spark, folder):
    return _values(spark, folder, X.urls(F.col("context")))


def extract_domain(spark, folder):
    return _values(spark, folder, X.domains(F.col("context"), HOSTS))


def extract_ip_address(spark, folder):
    """Everything that looks like an IPv4 address, with the verdict on it."""
    flat = _contexts(spark, folder).select("mention_id", F.explode(X.ip_candidates(F.col("context"))).alias("x"))
    return flat.select("mention_id", "x.value", "x.start", "x.public")


def extract_email(spark, folder):
    return _values(spark, folder, X.emails(F.col("context")))


def extract_phone(spark, folder):
    return _values(spark, folder, X.phones(F.col("context")))


def extract_hashes(spark, folder):
    return _values(spark, folder, F.concat(*[X.hashes(F.col("context"), k) for k in HASHES]))


def extract_social(spark, folder):
    return _values(spark, folder, F.concat(*[X.social(F.col("context"), k) for k in SOCIAL]))


def extract_tracking(spark, folder):
    return _values(spark, folder, F.concat(*[X.verbatim(F.col("context"), k) for k in ("google_analytics", "adsense")]))


def extract_crypto(spark, folder):
    return _values(spark, folder, F.concat(*[X.verbatim(F.col("context"), k) for k in ("bitcoin", "ethereum")]))


def page_indicators(spark, folder):
    """All types over the pages' text, deduplicated per page, with context."""
    pages = spread(table(spark, folder, "pdf_pages").select("page_id", "document_id", "text").filter("text IS NOT NULL"))
    found = X.extract(pages, "page_id", "text", X.all_indicators(F.col("text"), HOSTS), source="document_id")
    return X.with_ids(found).select("page_id", "indicator_id", "type", "value", "normalized_value", "start", "confidence", "context", F.col("metadata")["source_document"].alias("source_document"))


def document_indicators(spark, folder):
    """All types over the whole corpus of documents, deduplicated per document."""
    texts = spread(table(spark, folder, "documents").select("doc_id", "text").filter("text IS NOT NULL"))
    return X.with_ids(X.extract(texts, "doc_id", "text", X.all_indicators(F.col("text"), HOSTS))).select("doc_id", "indicator_id", "type", "value", "normalized_value", "start", "confidence", "context")


def _unique(spark, folder):
    """Every indicator of every mention's context once."""
    return _contexts(spark, folder).select("mention_id", F.explode(X.surest(X.all_indicators(F.col("context"), HOSTS))).alias("x")).select("mention_id", "x.type", "x.normalized_value", "x.confidence").distinct()


def extraction_statistics(spark, folder):
    return X.statistics(_unique(spark, folder))


def top_extracted(spark, folder):
    """Extracted indicators by the number of mentions whose context holds them."""
    unique = X.with_ids(_unique(spark, folder).select("mention_id", "type", "normalized_value").distinct())
    counts = unique.groupBy("indicator_id", "type", "normalized_value").agg(F.count(F.lit(1)).alias("mentions"))
    return counts.orderBy(F.desc("mentions"), "indicator_id").limit(100)


def loose_counts(spark, folder):
    return table(spark, folder, "document_chunks").select("chunk_id", X.loose_count(F.col("content")).alias("n")).filter("chunk_id IS NOT NULL").distinct()


def url_contexts(spark, folder):
    """The window of 20 characters around every URL of each context."""
    rows = _contexts(spark, folder).select("mention_id", "context", F.explode(X.urls(F.col("context"))).alias("x"))
    return rows.select("mention_id", "x.start", T.context(F.col("context"), F.col("x.start"), F.length("x.value"), 20).alias("around"))


QUERIES = {f.__name__: f for f in (
    extract_url, extract_domain, extract_ip_address, extract_email, extract_phone, extract_hashes, extract_social, extract_tracking, extract_crypto, page_indicators, document_indicators,
    extraction_statistics, top_extracted, loose_counts, url_contexts,
)}


def _quoted(regex: str) -> str:
    return "'" + regex.replace("'", "''") + "'"


def _regex(kind: str) -> str:
    return _quoted(("(?i)" if PATTERNS[kind].ignore_case else "") + PATTERNS[kind].regex)


def _number(ip: str) -> int:
    a, b, c, d = map(int, ip.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


# the pieces between the matches give their places
_STARTS = "list_transform(range(1, len(found) + 1), lambda k: coalesce(list_sum(list_transform(pieces[1:k], lambda p: length(p))), 0)::BIGINT + coalesce(list_sum(list_transform(found[1:k - 1], lambda f: length(f))), 0)::BIGINT)"


def _matched(kind: str, rows: str = "contexts") -> str:
    """(id, text, type, value, start) of every match of a type in the rows, which are (id, text)."""
    return f"""SELECT id, text, '{kind}' AS type, unnest(found) AS value, unnest({_STARTS})::INT AS start
      FROM (SELECT id, text, regexp_extract_all(text, {_regex(kind)}) AS found, string_split_regex(text, {_regex(kind)}) AS pieces FROM {rows})"""


_PUBLIC = "NOT (" + " OR ".join(f"n BETWEEN {_number(a)} AND {_number(b)}" for a, b in RESERVED_IPV4) + ")"
_OCTETS = "list_reduce(list_transform(string_split(value, '.'), lambda p: p::BIGINT), lambda a, p: a * 256 + p)"
_VALID_IP = "regexp_matches(value, '^(?:0|[1-9][0-9]{0,2})(?:\\.(?:0|[1-9][0-9]{0,2})){3}$') AND list_max(list_transform(string_split(value, '.'), lambda p: p::BIGINT)) <= 255"
_URL_NORMAL = "regexp_replace(url_decode(regexp_replace(regexp_replace(lower(value), '%([^0-9a-f]|$|[0-9a-f]([^0-9a-f]|$))', '%25\\1', 'g'), '\\+', '%2B', 'g')), '/$', '')"
_HOST = "lower(regexp_extract(value, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1))"
_ENDS = "|".join(s.replace(".", r"\.") for s in sorted(HOSTS, key=len, reverse=True))
_CODES = "|".join(sorted(CALLING_CODES, key=len, reverse=True))
_HASH_OK = "NOT regexp_matches(lower(value), '^(" + "|".join(f"{c}+" for c in "0123456789abcdef") + ")$')"
_EMAIL_OK = """length(string_split(value, '@')[1]) BETWEEN 1 AND 64 AND NOT regexp_matches(string_split(value, '@')[1], '^\\.|\\.$|\\.\\.')
  AND regexp_matches(string_split(value, '@')[2], '^(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\\.)+[A-Za-z]{2,63}$') AND length(value) <= 254"""
_DOMAIN_OK = f"""lower(value) NOT IN ({', '.join(map(_quoted, WHITELIST))}) AND length(value) <= 253
  AND regexp_matches(lower(value), '\\.(?:{_ENDS})$') AND length(value) - length(replace(value, '.', '')) <= 10"""
_DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"
_PHONE_OK = f"CASE WHEN value LIKE '+%' THEN regexp_matches({_DIGITS}, '^(?:{_CODES})[0-9]+$') AND length({_DIGITS}) BETWEEN 8 AND 15 ELSE length({_DIGITS}) >= 7 END"
_ACCOUNT = "CASE WHEN type = 'telegram' THEN string_split(string_split(lower(value), 't.me/')[2], '/')[1] ELSE lower(value) END"


def _judged(kind: str, rows: str = "contexts") -> str:
    """(id, text, type, value, start, normalized_value, confidence) of the indicators of a type."""
    matched = f"FROM ({_matched(kind, rows)})"
    sure = f"{PATTERNS[kind].confidence}::DOUBLE"
    if kind == "url":
        return f"SELECT *, {_URL_NORMAL} AS normalized_value, {sure} AS confidence {matched} WHERE {_HOST} <> ''"
    if kind == "domain":
        hosts = f"SELECT DISTINCT id, {_HOST} AS host FROM ({_matched('url', rows)})"
        return f"SELECT x.*, lower(value) AS normalized_value, {sure} AS confidence FROM ({_matched(kind, rows)}) x LEFT JOIN ({hosts}) u ON u.id = x.id AND u.host = lower(x.value) WHERE u.id IS NULL AND {_DOMAIN_OK}"
    if kind == "ip_address":
        return f"SELECT id, text, type, value, start, value AS normalized_value, {sure} AS confidence FROM (SELECT *, {_OCTETS} AS n {matched} WHERE {_VALID_IP}) WHERE {_PUBLIC}"
    if kind == "email":
        return f"SELECT *, lower(value) AS normalized_value, {sure} AS confidence {matched} WHERE {_EMAIL_OK}"
    if kind == "phone":
        return f"SELECT *, CASE WHEN value LIKE '+%' THEN '+' || {_DIGITS} ELSE {_DIGITS} END AS normalized_value, CASE WHEN value LIKE '+%' THEN 1.0 ELSE 0.7 END::DOUBLE AS confidence {matched} WHERE {_PHONE_OK}"
    if kind in HASHES:
        return f"SELECT *, lower(value) AS normalized_value, {sure} AS confidence {matched} WHERE {_HASH_OK}"
    if kind in SOCIAL:
        return f"SELECT *, {_ACCOUNT} AS normalized_value, {sure} AS confidence {matched}"
    return f"SELECT *, value AS normalized_value, {sure} AS confidence {matched}"


_KINDS = ["url", "domain", "ip_address", "email", "phone", *HASHES, *SOCIAL, *TRACKING, *CRYPTO]
_CONTEXTS = "WITH contexts AS (SELECT mention_id AS id, context AS text FROM indicator_mentions WHERE context IS NOT NULL) "


def _of(*kinds: str) -> str:
    return _CONTEXTS + "SELECT id AS mention_id, type, value, normalized_value, start FROM (" + " UNION ALL ".join(_judged(k) for k in kinds) + ")"


def _best(rows: str) -> str:
    """Of every indicator of a row of (id, text) the surest, then first match."""
    every = " UNION ALL ".join(_judged(k, rows) for k in _KINDS)
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, type, normalized_value ORDER BY confidence DESC, start) AS rn FROM ({every})) WHERE rn = 1"


def _around(window: int) -> str:
    a, b = f"greatest(0, start - {window})", f"least(length(text), start + length(value) + {window})"
    blanks = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
    return f"CASE WHEN {a} > 0 THEN '...' ELSE '' END || trim(regexp_replace(substring(text, {a} + 1, {b} - {a}), '{blanks}', ' ', 'g')) || CASE WHEN {b} < length(text) THEN '...' ELSE '' END"


_COLUMNS = f"md5(type || ':' || normalized_value) AS indicator_id, type, value, normalized_value, start, confidence, {_around(100)} AS context"

SQL = {
    "extract_url": _of("url"),
    "extract_domain": _of("domain"),
    "extract_ip_address": _CONTEXTS + f"""SELECT id AS mention_id, value, start, CASE WHEN {_VALID_IP} THEN {_PUBLIC} ELSE FALSE END AS public
      FROM (SELECT *, CASE WHEN length(value) <= 15 THEN {_OCTETS} END AS n FROM ({_matched('ip_address')}))""",
    "extract_email": _of("email"),
    "extract_phone": _of("phone"),
    "extract_hashes": _of(*HASHES),
    "extract_social": _of(*SOCIAL),
    "extract_tracking": _of("google_analytics", "adsense"),
    "extract_crypto": _of("bitcoin", "ethereum"),
    "page_indicators": f"WITH texts AS (SELECT page_id AS id, text FROM pdf_pages WHERE text IS NOT NULL) SELECT id AS page_id, {_COLUMNS}, document_id AS source_document FROM ({_best('texts')}) JOIN (SELECT page_id, document_id FROM pdf_pages) ON page_id = id",
    "document_indicators": f"WITH texts AS (SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL) SELECT id AS doc_id, {_COLUMNS} FROM ({_best('texts')})",
    "extraction_statistics": _CONTEXTS + f"""SELECT type, count(*) AS total, count(*) FILTER (confidence >= 0.9) AS high, count(*) FILTER (confidence >= 0.7 AND confidence < 0.9) AS medium, count(*) FILTER (confidence < 0.7) AS low
      FROM ({_best('contexts')}) GROUP BY 1""",
    "top_extracted": _CONTEXTS + f"""SELECT md5(type || ':' || normalized_value) AS indicator_id, type, normalized_value, count(*) AS mentions FROM (SELECT DISTINCT id, type, normalized_value FROM ({_best('contexts')}))
      GROUP BY type, normalized_value ORDER BY mentions DESC, indicator_id LIMIT 100""",
    "loose_counts": "SELECT DISTINCT chunk_id, " + " + ".join(f"coalesce(len(regexp_extract_all(content, {_quoted('(?i)' + r)})), 0)" for r in LOOSE) + " AS n FROM document_chunks WHERE chunk_id IS NOT NULL",
    "url_contexts": _CONTEXTS + f"SELECT id AS mention_id, start, {_around(20)} AS around FROM ({_judged('url')})",
}
