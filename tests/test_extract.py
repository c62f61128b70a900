import re

from pyspark.sql import functions as F

from inkspan.functions import text as T
from inkspan.functions.patterns import PATTERNS
from inkspan.operators import extract as X

TEXTS = [
    (1, "Visit https://malicious-site.com/Path%20a/ and evil-domain.net, payload.exe"),
    (2, "Contact bad.actor@malicious.org from 8.8.8.8 or 192.168.1.1 or 01.2.3.4"),
    (3, "Call +33123456789 or 555 123 4567; wallet 1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa"),
    (4, "t.me/joinchat/ABC twitter.com/Someone facebook.com/pages/x"),
    (5, "UA-12345-1 pub-1234567890123456 0x" + "ab" * 20),
    (6, "d41d8cd98f00b204e9800998ecf8427e and " + "0" * 32),
    (7, ""), (8, None), (9, "a@b.co a@b.co A@B.CO"), (10, "netflix.com/a about.me/z 100% 5+5 http://x.org/%zz"),
]


def found(spark, **more):
    rows = spark.createDataFrame(TEXTS, "id long, text string")
    return {(r["id"], r["type"], r["normalized_value"]): r for r in X.extract(rows, "id", "text", **more).collect()}


def test_types_and_normal_forms(spark):
    got = set(found(spark))
    assert (1, "url", "https://malicious-site.com/path a") in got
    assert (1, "domain", "evil-domain.net") in got and (1, "domain", "malicious-site.com") not in got and (1, "domain", "payload.exe") not in got
    assert (2, "email", "bad.actor@malicious.org") in got and (2, "ip_address", "8.8.8.8") in got
    assert not {k for k in got if k[1] == "ip_address" and k[2] != "8.8.8.8"}
    assert (3, "phone", "+33123456789") in got and (3, "phone", "5551234567") in got
    assert (3, "bitcoin", "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa") in got
    assert (4, "telegram", "joinchat") in got and (4, "twitter", "twitter.com/someone") in got
    assert {(5, "google_analytics", "UA-12345-1"), (5, "adsense", "pub-1234567890123456")} <= got
    assert (6, "md5", "d41d8cd98f00b204e9800998ecf8427e") in got and (6, "md5", "0" * 32) not in got
    assert (10, "twitter", "x.com/a") in got and (10, "telegram", "z") in got
    assert (10, "url", "http://x.org/%zz") in got
    assert not {k for k in got if k[0] in (7, 8)}


def test_dedup_keeps_the_first_of_equal_confidence(spark):
    row = found(spark)[(9, "email", "a@b.co")]
    assert row["start"] == 0 and row["value"] == "a@b.co" and row["context"] == "a@b.co a@b.co A@B.CO"


def test_source_and_ids(spark):
    rows = spark.createDataFrame([("d1", "8.8.8.8")], "doc string, text string")
    row = X.with_ids(X.extract(rows, "doc", "text", source="doc")).first()
    assert row["metadata"]["source_document"] == "d1" and row["metadata"]["ip_version"] == "4"
    import hashlib

    assert row["indicator_id"] == hashlib.md5(b"ip_address:8.8.8.8").hexdigest()


def test_matches_equal_finditer_on_all_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    for kind in ("email", "ip_address", "domain", "phone", "sha1", "url"):
        p = PATTERNS[kind]
        regex = ("(?i)" if p.ignore_case else "") + p.regex
        for r in docs.select("text", T.matches(F.col("text"), regex, p.hint).alias("m")).collect():
            expected = [(m.group(), m.start()) for m in re.finditer(p.regex, r["text"] or "", re.IGNORECASE if p.ignore_case else 0)]
            got = [(m["value"], m["start"]) for m in r["m"]]
            if (r["text"] or "").isascii():
                assert got == expected


def test_context_window(spark):
    text = "x" * 150 + "  8.8.8.8\n" + "y" * 150
    rows = spark.createDataFrame([(1, text)], "id long, text string")
    row = [r for r in X.extract(rows, "id", "text").collect() if r["type"] == "ip_address"][0]
    assert row["context"] == "..." + "x" * 98 + " 8.8.8.8 " + "y" * 99 + "..."


def test_statistics_and_registry(spark):
    X.register_pattern("ticket", r"TCK-\d+", F.upper, 0.8)
    try:
        rows = spark.createDataFrame([(1, "see TCK-77 and 8.8.8.8")], "id long, text string")
        got = {r["type"]: r for r in X.statistics(X.extract(rows, "id", "text")).collect()}
        assert got["ticket"]["medium"] == 1 and got["ip_address"]["high"] == 1
    finally:
        X._EXTRA.clear()


def test_loose_count(spark):
    row = spark.createDataFrame([("HTTP://a.b 999.1.1.1 x@y.zz",), (None,)], "t string").select(X.loose_count(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in row] == [3, 0]


def test_astral_characters_count_once(spark):
    rows = spark.createDataFrame([(1, "😀😀 8.8.8.8")], "id long, text string")
    row = [r for r in X.extract(rows, "id", "text").collect() if r["type"] == "ip_address"][0]
    assert row["start"] == 3
