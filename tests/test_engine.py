import json

from pyspark.sql import functions as F

from inkspan.engine import Engine
from inkspan.operators import relational as R
from inkspan.operators import vectors as V
from inkspan.sources import files
from inkspan.streaming import flows


def test_engine_verbs(spark, folder):
    engine = Engine(spark, folder)
    some = engine.mentions.groupBy("indicator_id").count().orderBy(F.desc("count")).first()["indicator_id"]
    assert engine.context(some).count() <= 1
    assert engine.relationships(some, 2, 5).count() <= 5
    assert engine.lookup("domain", 3).count() <= 3
    assert engine.timeline(some, 400).count() > 0
    assert engine.search("find all domains", 4).count() == 4
    assert engine.search("show related things", 4).count() == 0
    assert engine.search("the takedown of the newsroom archive", 4).count() <= 4
    assert engine.statistics().filter("what = 'chunks'").first()["n"] > 0
    assert set(engine.patterns().columns) == {"pattern_type", "subject", "confidence"}
    full = engine.context(some).first()
    assert full["mentions"] and len(full["mentions"]) <= 20 and full["n_mentions"] >= len(full["mentions"])
    assert engine.context("no such id").count() == 0
    hub = engine.links.filter("type = 'PART_OF_CAMPAIGN'").groupBy("target").count().orderBy(F.desc("count"), "target").first()["target"]
    nodes, edges = engine.network(hub, 1, 10)
    labels = {r["id"]: r["label"] for r in nodes.collect()}
    assert labels[hub] == "Campaign" and 0 < edges.count() <= 10 and set(labels.values()) >= {"Campaign", "Indicator"}
    assert {r["source"] for r in edges.collect()} | {r["target"] for r in edges.collect()} == set(labels)
    assert all(t.count() == 0 for t in engine.network("no such id"))
    for query in ("find all domains", "show related things", "the takedown of the newsroom archive", "detect patterns in campaigns"):
        assert engine.search(query, 3).columns == ["score", "type", "id", "content", "source", "metadata", "highlights"]
    assert engine.search("find all domains", 1).first()["metadata"]["indicator_type"] == "domain"
    assert {"campaigns", "actors"} <= {r["what"] for r in engine.statistics().collect()}


def test_ingest_counts_again(spark, folder):
    engine = Engine(spark, folder)
    pages = spark.createDataFrame([("d", 1, 1, "8.8.8.8 and 8.8.8.8", "2024-01-01 00:00:00"), ("d", 2, 2, "8.8.8.8", "2024-01-02 00:00:00")], "document_id string, page_number int, page_id long, text string, extracted_at string")
    out = engine.ingest(pages.withColumn("extracted_at", F.col("extracted_at").cast("timestamp_ntz")))
    row = out["indicators"].filter("type = 'ip_address' AND value = '8.8.8.8'").first()
    assert row["occurrence_count"] == 2 and str(row["first_seen"]) == "2024-01-01 00:00:00"
    # the same position on another page replaces the mention
    assert out["mentions"].filter(F.col("indicator_id") == row["indicator_id"]).collect()[0]["page_number"] == 2


def test_similar_can_pass_one(spark):
    rows = [("t", "d1"), ("o", "d1"), ("o", "d1"), ("t", "d2")]
    mentions = spark.createDataFrame(rows, "indicator_id string, document_id string")
    names = spark.createDataFrame([("o", "md5", "v")], "indicator_id string, type string, value string")
    assert R.similar_indicators(mentions, names, "t").first()["score"] == 1.0


def test_thresholds(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0])], "id long, v array<double>")
    assert [r["id"] for r in V.top_k(rows, "id", "v", [1.0, 0.0], 5, 0.0).collect()] == [1, 2]
    assert [r["id"] for r in V.top_k(rows, "id", "v", [1.0, 0.0], 5, 0.0, strict=True).collect()] == [1]


def test_cache(spark):
    texts = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "t string")
    cached = texts.filter("t = 'a'").select(F.md5("t").alias("text_key"), F.array(F.lit(1.0)).alias("embedding")).distinct()
    assert [r["text"] for r in V.cache_misses(texts, "t", cached).collect()] == ["b"]
    assert V.embed_missing(texts, "t", cached, lambda t: F.array(F.lit(2.0))).count() == 2


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ftwo")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4 broken")
    (tmp_path / "c.exe").write_bytes(b"no")
    rows = files.files(spark, str(tmp_path))
    assert {r["path"].rsplit("/", 1)[1]: r["is_pdf"] for r in rows.collect()} == {"a.txt": False, "b.pdf": True}

    def parser(content):
        raise ValueError("broken")

    pages = sorted((r["page_number"], r["text"], r["layout_type"]) for r in files.parsed(rows, parser).collect())
    assert pages == [(1, "one", "unknown"), (2, "two", "unknown")]
    files.write_embeddings(spark.createDataFrame([("x", [0.5])], "id string, embedding array<double>"), str(tmp_path / "e"), "m", 1)
    assert files.read_embeddings(spark, str(tmp_path / "e")).first()["model_name"] == "m"
    docs = spark.createDataFrame([("d", "t")], "doc_id string, title string")
    parts = spark.createDataFrame([("d", 1, "x", None, "en")], "document_id string, page_number int, text string, layout_type string, language string")
    files.write_documents(docs, parts, str(tmp_path / "docs"))
    assert json.loads(spark.read.text(str(tmp_path / "docs")).first()[0])["pages"][0]["text"] == "x"


def test_latest_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), (None, 1, "n")], "k string, at int, v string")
    rows.repartition(3).write.parquet(str(tmp_path / "in" / "t.parquet"))
    stream = flows.stream_table(spark, str(tmp_path / "in"), "t", files_per_batch=1)
    got = flows.drain(flows.latest_stream(stream, ["k"], ["at"]), "complete")
    assert {r["k"]: r["v"] for r in got.collect()} == {"a": "y", "b": "z"}


def test_page_metadata(spark):
    rows = spark.createDataFrame([("<html><head><TITLE>A\n b</TITLE><meta name='author' content='X'></head>", None), ("plain", '{"title": "T", "pages": 3, "producer": "p"}'), (None, "no json"), ("", None)], "text string, metadata string")
    got = [r["details"] for r in files.page_metadata(rows).collect()]
    assert (got[0]["title"], got[0]["author"], got[0]["pages"]) == ("A b", "X", None)
    assert (got[1]["title"], got[1]["producer"], got[1]["pages"]) == ("T", "p", 3)
    assert not any(got[2].asDict().values()) and not any(got[3].asDict().values())
