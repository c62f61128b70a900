from collections import defaultdict, deque

import numpy as np

from inkspan.operators import graph as G


def random_edges(n, m, seed):
    rng = np.random.default_rng(seed)
    return [(f"n{a:03d}", f"n{b:03d}") for a, b in rng.integers(0, n, (m, 2))]


def bfs(edges, start):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b), near[b].add(a)
    seen, queue = {start: 0}, deque([start])
    while queue:
        x = queue.popleft()
        for y in near[x] - seen.keys():
            seen[y] = seen[x] + 1
            queue.append(y)
    return seen


def test_neighbourhood_and_subgraph(spark):
    edges = random_edges(60, 70, 1)
    frame = spark.createDataFrame(edges, "u string, v string")
    start = edges[0][0]
    true = {k: d for k, d in bfs(edges, start).items() if d <= 3}
    assert {r["id"]: r["distance"] for r in G.neighbourhood(frame, start, 3).collect()} == true
    nodes, inside = G.subgraph(frame, start, 3)
    assert {(r["u"], r["v"]) for r in inside.collect()} == {(a, b) for a, b in edges if a in true and b in true}
    assert {r["id"] for r in nodes.collect()} == set(true)


def test_components_partition(spark):
    edges = random_edges(80, 60, 2) + [("zz", "zz")]
    got = {r["id"]: r["component"] for r in G.components(spark.createDataFrame(edges, "u string, v string")).collect()}
    for node, label in got.items():
        assert label == min(bfs(edges, node))


def test_shortest_path(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "x"), ("x", "d")]
    frame = spark.createDataFrame(edges, "u string, v string")
    assert [r["id"] for r in G.shortest_path(frame, "a", "d").orderBy("step").collect()] == ["a", "x", "d"]
    assert G.shortest_path(frame, "a", "nowhere").count() == 0
    assert [r["id"] for r in G.shortest_path(frame, "a", "a").collect()] == ["a"]


def test_page_rank_equals_power_iteration(spark):
    edges = sorted(set((a, b) for a, b in random_edges(12, 30, 5) if a != b))
    nodes = sorted({x for e in edges for x in e})
    at = {x: i for i, x in enumerate(nodes)}
    n = len(nodes)
    out = defaultdict(list)
    for a, b in edges:
        out[a].append(b)
    rank = np.full(n, 1 / n)
    for _ in range(4):
        new = np.zeros(n)
        for a in nodes:
            if out[a]:
                for b in out[a]:
                    new[at[b]] += rank[at[a]] / len(out[a])
            else:
                new += rank[at[a]] / n
        rank = 0.15 / n + 0.85 * new
    got = {r["id"]: r["rank"] for r in G.page_rank(spark.createDataFrame(edges, "u string, v string"), 4).collect()}
    assert all(abs(got[x] - rank[at[x]]) < 1e-9 for x in nodes)


def test_communities_settle_on_cliques(spark):
    clique = lambda p: [(f"{p}{i}", f"{p}{j}") for i in range(4) for j in range(i)]
    got = {r["id"]: r["community"] for r in G.communities(spark.createDataFrame(clique("a") + clique("b"), "u string, v string")).collect()}
    assert len({got[f"a{i}"] for i in range(4)}) == 1 and got["a0"] != got["b0"]


def test_cooccurrence_and_empty(spark):
    rows = [("i1", "d1"), ("i2", "d1"), ("i1", "d2"), ("i2", "d2"), ("i3", "d2"), ("i1", "d2")]
    frame = spark.createDataFrame(rows, "indicator_id string, document_id string")
    assert [tuple(r) for r in G.cooccurrence(frame).collect()] == [("i1", "i2", 2)]
    assert G.cooccurrence(frame.limit(0)).count() == 0
    assert G.components(spark.createDataFrame([], "u string, v string")).count() == 0


def test_large_documents_are_counted_exactly(spark, monkeypatch):
    import random
    from collections import Counter, defaultdict
    from itertools import combinations

    from inkspan import skew

    monkeypatch.setattr(skew, "BLOCK", 5)
    rng = random.Random(8)
    docs = {f"d{k:02d}": rng.sample(range(40), rng.choice([1, 3, 6])) for k in range(40)} | {f"huge{k}": rng.sample(range(40), 30 - k) for k in range(12)}
    frame = spark.createDataFrame([(f"i{i:02d}", d) for d, items in docs.items() for i in items] * 2, "indicator_id string, document_id string")
    counts = Counter(p for items in docs.values() for p in combinations(sorted(f"i{i:02d}" for i in items), 2))
    near = defaultdict(set)
    for items in docs.values():
        for a in items:
            near[f"i{a:02d}"] |= {f"i{b:02d}" for b in items}
    for least in (1, 2, 4, 7):
        got = {(r["indicator_a"], r["indicator_b"]): r["documents"] for r in G.cooccurrence(frame, least).collect()}
        assert got == {p: n for p, n in counts.items() if n >= least}
    for largest in (0, 2, 8):
        monkeypatch.setattr(G, "LARGEST", largest)
        centers = {a for (a, _), n in counts.items() if n >= 4}
        assert {r["center"]: r["size"] for r in G.ego_clusters(frame, 4, 3, 100).collect()} == {c: len(near[c]) for c in centers if len(near[c]) >= 3}
