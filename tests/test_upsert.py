from pyspark.sql import functions as F

from inkspan.operators import upsert as U


def test_latest_keeps_first_created_and_null_keys(spark):
    rows = spark.createDataFrame([("a", 1, "old", 10), ("a", 2, "new", 20), (None, 1, "x", 1), (None, 1, "x", 1)], "k string, at int, v string, created int")
    got = sorted((r["k"] or "", r["v"], r["created"]) for r in U.latest(rows, ["k"], ["at"], ["created"]).collect())
    assert got == [("", "x", 1), ("", "x", 1), ("a", "new", 10)]


def test_latest_ties_do_not_depend_on_order(spark):
    rows = [("a", 1, v) for v in ("p", "q", "r")]
    for order in (rows, rows[::-1]):
        assert U.latest(spark.createDataFrame(order, "k string, at int, v string"), ["k"], ["at"]).first()["v"] == "r"


def test_upsert_twice(spark):
    store = spark.createDataFrame([("a", "1", 5)], "k string, v string, created int")
    fresh = spark.createDataFrame([("a", "2", 9), ("b", "3", 9)], "k string, v string, created int")
    once = U.upsert(store, fresh, ["k"], ["created"])
    assert sorted(map(tuple, once.collect())) == [("a", "2", 5), ("b", "3", 9)]
    assert sorted(map(tuple, U.upsert(once, fresh, ["k"], ["created"]).collect())) == [("a", "2", 5), ("b", "3", 9)]


def test_upsert_writes_nulls(spark):
    store = spark.createDataFrame([("a", "1")], "k string, v string")
    fresh = spark.createDataFrame([("a", None)], "k string, v string")
    assert U.upsert(store, fresh, ["k"]).first()["v"] is None


def test_counts_delete_update_link(spark):
    events = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 3, "z")], "k string, at int, v string")
    row = U.merge_counts(events, "k", "at", ["v"]).first()
    assert (row["v"], row["first_seen"], row["last_seen"], row["occurrence_count"]) == ("y", 1, 2, 2)
    gone = spark.createDataFrame([("a",), (None,)], "x string")
    assert U.delete_where(events, "k", gone).count() == 1
    assert [r["v"] for r in U.update_where(events, F.col("at") == 1, v=F.lit("n")).orderBy("at").collect()] == ["n", "x", "z"]
    edges = spark.createDataFrame([("a", "d"), ("b", "d"), ("a", "e")], "source string, target string")
    ends = spark.createDataFrame([("a",)], "id string"), spark.createDataFrame([("d",)], "id string")
    assert [tuple(r) for r in U.linked(edges, ends[0], "id", ends[1], "id").collect()] == [("a", "d")]


def test_campaigns_are_merged_by_name(spark):
    kind = "name string, properties map<string,string>, updated_at int"
    stored = spark.createDataFrame([("Gorm", {"a": "1"}, 1)], kind)
    fresh = spark.createDataFrame([(" Gorm", {"b": "2"}, 2), ("Gorm", {"c": "3"}, 3), ("New", None, 1), ("  ", {}, 9), (None, {}, 9)], kind)
    assert {r["name"]: r["properties"] for r in U.merge_named(stored, fresh).collect()} == {"Gorm": {"c": "3"}, "New": None}
    assert U.cleared(stored).count() == 0 and U.cleared(stored).schema == stored.schema
