import pytest

from inkspan.plans import router

GOLDEN = [
    ("What Russian disinformation campaigns target France?", "campaign_analysis", "semantic", None, 2),
    ("Find all domains associated with Doppelgänger", "indicator_lookup", "indicator", "domain", 2),
    ("Show all indicators within 3 hops of domain X", "indicator_lookup", "indicator", "domain", 3),
    ("Find clusters of related social media accounts", "graph_traversal", "graph", None, 2),
    ("Which indicators appear across multiple campaigns?", "semantic_search", "semantic", None, 2),
    ("Show indicator relationships over time", "indicator_lookup", "indicator", "ip_address", 2),
    ("malware analysis", "semantic_search", "semantic", None, 2),
    ("cluster 99 hops", "pattern_analysis", "pattern", None, 5),
    ("the history of it", "timeline_query", "semantic", None, 2),
]


@pytest.fixture(scope="module")
def routed(spark):
    rows = spark.createDataFrame([(q,) for q, *_ in GOLDEN] + [(None,)], "query string")
    return {r["query"]: r for r in router.routed(rows).collect()}


@pytest.mark.parametrize("query,intent,path,kind,hops", GOLDEN)
def test_routes(routed, query, intent, path, kind, hops):
    row = routed[query]
    assert (row["intent"], row["path"], row["hops"]) == (intent, path, hops)
    if kind:
        assert row["indicator_type"] == kind


def test_node_ids(spark):
    rows = spark.createDataFrame([("related to " + "a1" * 16,)], "query string")
    assert router.routed(rows).first()["node_id"] == "a1" * 16


def test_synthesis(spark):
    rows = spark.createDataFrame([(0.5, "chunk", "b"), (0.9, "indicator", "a"), (0.5, "chunk", "a")], "score double, type string, id string")
    best, summary = router.synthesis(rows, 2)
    assert [r["id"] for r in best.collect()] == ["a", "a"]
    assert tuple(summary.first()) == (3, 2, 0.9, ["chunk", "indicator"])
