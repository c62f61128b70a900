import json

from pyspark.sql import functions as F

from inkspan.functions import text as T
from inkspan.operators import layout as L
from inkspan.operators import validate as W


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("r")).first()["r"]


def test_queries(spark):
    assert one(spark, " find domains ", W.query)["value"] == "find domains"
    for bad in ("", "x" * 1001, "a; DROP TABLE x", "1 OR 1=1", "$where", "select a from b", None):
        assert not one(spark, bad, W.query)["valid"]


def test_values(spark):
    assert one(spark, "https://Evil.COM/x", W.domain)["value"] == "evil.com"
    assert not one(spark, "payload.exe", W.domain)["valid"]
    assert one(spark, "192.168.0.1", W.ip)["valid"] and not one(spark, "01.2.3.4", W.ip)["valid"]
    assert one(spark, "A@b.co", W.email)["value"] == "a@b.co" and not one(spark, "a..b@c.de", W.email)["valid"]
    assert one(spark, "AB" * 16, lambda v: W.form("md5", v))["value"] == "ab" * 16
    assert not one(spark, "Doppelgänger", lambda v: W.form("campaign_name", v))["valid"]
    assert one(spark, 1.0, W.confidence, "double") and not one(spark, 1.1, W.confidence, "double") and not one(spark, None, W.confidence, "double")
    assert one(spark, '{"a": 1}', W.metadata)["valid"] and not one(spark, "[1]", W.metadata)["valid"] and not one(spark, "{", W.metadata)["valid"]


def test_public_ips(spark):
    for ip, public in {"8.8.8.8": True, "10.1.2.3": False, "100.64.0.1": True, "224.0.0.1": True, "192.0.0.9": True, "192.0.0.1": False, "256.1.1.1": False, "198.51.100.7": False}.items():
        assert one(spark, ip, T.public_ip) is public


def test_redact_and_sanitise(spark):
    row = spark.createDataFrame([({"API_KEY": "abcdef", "pin_token": "abc", "name": "n"},)], "m map<string,string>").select(W.redact(F.col("m")).alias("m")).first()["m"]
    assert row == {"API_KEY": "ab**ef", "pin_token": "****", "name": "n"}
    assert one(spark, " a\x00b\x07\n\tc ", T.sanitized) == "ab\n\tc"
    assert one(spark, "<a href='x'>", T.html_escaped) == "&lt;a href=&#x27;x&#x27;&gt;"


def test_rate_admission_ignores_rejected(spark):
    times = [0, 1, 2, 3, 61, 62, 63]
    rows = [(i, "c", f"2024-01-01 00:{t // 60:02d}:{t % 60:02d}") for i, t in enumerate(times)]
    frame = spark.createDataFrame(rows, "event_id long, user string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {r["event_id"]: r["admitted"] for r in W.rate_admitted(frame, "user", "ts", "event_id", 2, 60).collect()}
    assert [got[i] for i in range(7)] == [True, True, False, False, True, True, False]


def test_layout(spark):
    chars = [("p", "a", 0.0, 5.0, 10.1), ("p", "b", 5.5, 10.0, 9.9), ("p", "c", 20.0, 25.0, 10.0), ("p", "d", 0.0, 5.0, 30.0)]
    frame = spark.createDataFrame(chars, "page_id string, char string, x0 double, x1 double, top double")
    assert L.page_text(frame).first()["text"] == "ab c\nd"
    assert L.layout_type(frame, 60.0).first()["layout_type"] == "mixed"
    both = spark.createDataFrame([("p", "a", float(x), x + 1.0, 1.0) for x in (1, 2, 50, 55)], "page_id string, char string, x0 double, x1 double, top double")
    assert L.layout_type(both, 60.0).first()["layout_type"] == "multi_column"
    tables = spark.createDataFrame([([[[" a ", None], [None, ""]], [[None]]],)], "t array<array<array<string>>>")
    assert tables.select(L.clean_tables(F.col("t")).alias("t")).first()["t"] == [[["a", ""]]]
    text = tables.select(L.export(F.array(F.lit("p1"), F.lit("p2")), L.clean_tables(F.col("t"))).alias("x")).first()["x"]
    assert text == "p1\n\np2\n\n[Table]\na\t"


def test_nested_metadata(spark):
    texts = ['{"api_key": "abcdefgh", "x": [{"Password": "abc", "n": 1}, "  a\\u0001b "], "token": {"k": 5}}', "no json", None, "[1, 2]", "[" * 5000, '{"password": null}']
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(W.redacted_json(F.col("t")).alias("r"), W.sanitized_json(F.col("t")).alias("s")).collect()
    got = json.loads(rows[0]["r"])
    assert got["api_key"] == "ab****gh" and got["x"][0] == {"Password": "****", "n": 1} and got["token"].startswith('{"') and "*" in got["token"]
    assert json.loads(rows[0]["s"])["x"][1] == "ab" and rows[1]["r"] is None and rows[2]["r"] is None and rows[3]["s"] is None and rows[4]["r"] is None
    assert json.loads(rows[5]["r"]) == {"password": None}
