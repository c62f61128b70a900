from datetime import datetime

from inkspan.operators.orphans import orphan_references, orphans_by_month

DAY = lambda d: datetime(2024, 1, d)


def tables(spark, mentions, indicators, documents, deleted):
    return (
        spark.createDataFrame(mentions, "mention_id long, indicator_id string, document_id string, created_at timestamp_ntz, key string, ref_column int"),
        spark.createDataFrame(indicators, "indicator_id string, created_at timestamp_ntz, key string"),
        spark.createDataFrame(documents, "doc_id string, created_at timestamp_ntz, refs int"),
        spark.createDataFrame(deleted, "table_name string, record_key string, deleted_at timestamp_ntz"),
    )


def found(spark, *args):
    return sorted((r["mention_id"], r["ref_column"], r["state"]) for r in orphan_references(*tables(spark, *args)).collect())


def test_states(spark):
    mentions = [
        (1, " A\t", "d1", DAY(5), None, 1), (2, "b", "D1 ", DAY(5), None, 1), (3, "c", None, DAY(5), "x", 1), (4, "gone", " ", DAY(5), None, None), (5, "gone", "", None, None, 1),
        (6, "late", "d1", DAY(2), None, 1), (7, "late", "d1", None, None, 1), (8, "undated", "d1", DAY(1), None, 1), (8, "undated", "d1", DAY(1), None, 1),
    ]
    indicators = [("a", DAY(1), "k"), ("late", DAY(3), None), ("late", DAY(9), None), ("undated", None, None), (None, DAY(1), None)]
    documents = [("d1", DAY(1), 1), ("d1", DAY(1), 1)]
    deleted = [("indicators", " GONE", DAY(6)), ("indicators", "gone", DAY(7)), ("pdf_documents", "b", DAY(6)), ("indicators", None, None), (None, "c", DAY(1))]
    assert found(spark, mentions, indicators, documents, deleted) == [
        (2, "indicator_id", "missing"), (3, "indicator_id", "missing"), (4, "indicator_id", "deleted"), (5, "indicator_id", "deleted"), (6, "indicator_id", "late"),
    ]


def test_empty_tables(spark):
    assert found(spark, [], [], [], []) == []
    assert found(spark, [(1, "a", "d", DAY(1), None, 1)], [], [], []) == [(1, "document_id", "missing"), (1, "indicator_id", "missing")]


def test_hot_key_and_months(spark):
    mentions = [(i, "hot" if i % 3 else f"k{i}", "d", DAY(1 + i % 28), None, 1) for i in range(3000)]
    frames = tables(spark, mentions, [], [("d", DAY(1), 1)], [("indicators", "hot", DAY(1))])
    months = {(r["ref_table"], r["month"], r["state"]): r["n_refs"] for r in orphans_by_month(*frames).collect()}
    assert months == {("indicators", "2024-01", "deleted"): 2000, ("indicators", "2024-01", "missing"): 1000}


def test_months_agree_with_the_single_references(spark):
    rows = [(i, f"k{i % 7}", f"d{i % 5}", DAY(1 + i % 28) if i % 11 else None, None, 1) for i in range(400)]
    rows += [(1000 + i, "k1", "d1", datetime(2024, 1 + i % 6, 3), None, 1) for i in range(60)]
    indicators = [("k1", DAY(9), None), ("k1", DAY(12), None), ("k2", datetime(2024, 3, 3), None), ("k3", None, None)]
    frames = tables(spark, rows, indicators, [("d1", DAY(14), 1), ("d2", DAY(1), 1)], [("indicators", "k4", DAY(1)), ("pdf_documents", "d3", DAY(1))])
    from collections import Counter

    names = {"indicator_id": "indicators", "document_id": "pdf_documents"}
    one_by_one = Counter((names[r["ref_column"]], r["created_at"] and r["created_at"].strftime("%Y-%m"), r["state"]) for r in orphan_references(*frames).collect())
    assert {(r["ref_table"], r["month"], r["state"]): r["n_refs"] for r in orphans_by_month(*frames).collect()} == one_by_one
    assert orphans_by_month(*tables(spark, [], [], [], [])).count() == 0
