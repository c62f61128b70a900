from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from inkspan.llm.components import connected_groups, related_links
from inkspan.llm.cooccurrence import basket_items, frequent_pairs
from inkspan.llm.neighbours import nearest_vectors, neighbour_pairs, usable_vectors
from inkspan.llm.vector_graph import VectorGraph


def union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    groups = defaultdict(set)
    for x in parent:
        groups[find(x)].add(x)
    return {x: min(g) for g in groups.values() for x in g}


def groups_of(spark, pairs):
    frame = spark.createDataFrame(pairs, "u string, v string")
    rows = connected_groups(frame).collect()
    got = {r["record_id"]: r["group_id"] for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("seed", range(3))
def test_groups_equal_union_find(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = [(f"{a:04d}", f"{b:04d}") for a, b in rng.integers(0, 300, (200, 2))]
    assert groups_of(spark, pairs) == union_find(pairs)


def test_long_chain_hub_and_loops(spark):
    order = np.random.default_rng(1).permutation(150)
    chain = [(f"c{order[i]:03d}", f"c{order[i + 1]:03d}") for i in range(149)]
    hub = [("h", f"x{i:03d}") for i in range(200)] + [(f"x{i:03d}", "h") for i in range(0, 200, 3)]
    pairs = chain + hub + [("l", "l"), ("h", "h")]
    assert groups_of(spark, pairs) == union_find(pairs)


def test_no_links(spark):
    assert groups_of(spark, []) == {}
    assert groups_of(spark, [("a", "a"), ("a", "a")]) == {"a": "a"}


def test_related_links_are_cleaned(spark):
    rows = [(" A", "b\t", "Related-To ", 1, None), ("a", "b", "UNRELATED_TO", 1, None), ("a", "", "related to", 1, None), (None, "b", "RELATED_TO", 1, None), ("a", "b", None, 1, None), ("x", "y", "relatedto", 1, None)]
    frame = spark.createDataFrame(rows, "source_id string, target_id string, relationship_type string, u int, v string")
    assert [tuple(r) for r in related_links(frame).collect()] == [("a", "b")]


def brute_pairs(rows, least, lift):
    items, baskets = defaultdict(set), set()
    for b, i in rows:
        items[i].add(b)
        baskets.add(b)
    n = len(baskets)
    names = sorted(items)
    found = {}
    for k, a in enumerate(names):
        for b in names[k + 1 :]:
            both = len(items[a] & items[b])
            if both >= least and both * n >= lift * len(items[a]) * len(items[b]):
                found[a, b] = (both, len(items[a]), len(items[b]), n)
    return found


@pytest.mark.parametrize("block", [512, 4])
def test_pairs_equal_brute_force(spark, block):
    rng = np.random.default_rng(5)
    rows = []
    for b in range(120):
        group = rng.integers(0, 8)
        rows += [(f"b{b}", f"i{group}_{k}") for k in range(5) if rng.random() < 0.7] + [(f"b{b}", f"n{rng.integers(0, 40)}"), (f"b{b}", "everywhere")]
    rows += [("huge", f"i{g}_{k}") for g in range(8) for k in range(5)]
    frame = spark.createDataFrame(rows + rows[:50], "basket string, item string")
    got = {(r["item_a"], r["item_b"]): (r["n_ab"], r["n_a"], r["n_b"], r["n"]) for r in frequent_pairs(frame, 4, 5.0, block).collect()}
    expected = brute_pairs(rows, 4, 5.0)
    assert got == expected and len(expected) > 30


@pytest.mark.parametrize("n_huge", [1, 3, 4])
def test_pairs_with_huge_baskets(spark, n_huge):
    rng = np.random.default_rng(n_huge)
    items = [f"i{k}" for k in range(60)]
    rows = [(f"huge{h}", i) for h in range(n_huge) for i in items if rng.random() < 0.9]
    rows += [(f"b{b}", f"i{(7 * (b % 20) + k) % 60}") for b in range(400) for k in range(2)] + [(f"s{b}", f"z{b}") for b in range(300)]
    got = {(r["item_a"], r["item_b"]): r["n_ab"] for r in frequent_pairs(spark.createDataFrame(rows, "basket string, item string"), 4, 2.0).collect()}
    assert got == {k: v[0] for k, v in brute_pairs(rows, 4, 2.0).items()} and got


def test_pairs_of_nothing(spark):
    raw = spark.createDataFrame([(" B ", "\tX", "other"), ("b", "x", None), (None, "y", None), ("b", " ", None)], "d string, i string, basket string")
    assert {tuple(r) for r in basket_items(raw, "d", "i").collect()} == {("b", "x")}
    assert frequent_pairs(basket_items(raw, "d", "i")).count() == 0
    assert frequent_pairs(basket_items(raw.limit(0), "d", "i")).count() == 0


def vectors(n, dimension=24, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dimension))
    return (centres[rng.integers(0, 12, n)] + 0.4 * rng.normal(size=(n, dimension))).astype(np.float32)


def brute_neighbours(names, x, k):
    wide = x.astype(np.float64)
    wide /= np.linalg.norm(wide, axis=1, keepdims=True)
    s = np.round(wide @ wide.T, 6)
    np.fill_diagonal(s, -9)
    order = sorted(range(len(names)), key=lambda i: names[i])
    return {names[i]: [names[j] for j in sorted((j for j in order if j != i), key=lambda j: (-s[i, j], names[j]))[:k]] for i in range(len(names))}


def test_graph_search_finds_the_nearest():
    x = vectors(1500)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = VectorGraph(x)
    found, _ = graph.search(x[:300], 48, np.arange(300, dtype=np.int32))
    s = x[:300] @ x.T
    s[np.arange(300), np.arange(300)] = -9
    true = np.argsort(-s, axis=1)[:, :10]
    hits = np.mean([len(set(f[f != i][:10]) & set(t)) / 10 for i, (f, t) in enumerate(zip(found, true))])
    assert hits > 0.97


def test_nearest_vectors_recall_at_least_090(spark):
    x = vectors(2500)
    names = [f"v{i:05d}" for i in range(len(x))]
    frame = spark.createDataFrame([(n, [float(y) for y in v]) for n, v in zip(names, x)], "id string, vector array<float>")
    true = brute_neighbours(names, x, 10)
    got = {r["id"]: [n["id"] for n in r["neighbours"]] for r in nearest_vectors(frame).collect()}
    assert set(got) == set(names)
    assert np.mean([len(set(got[n]) & set(true[n])) / 10 for n in names]) > 0.95


def test_unusable_vectors_ties_and_copies(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", [1.0, 0.0]), ("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [0.5, 0.0]), ("d", None), ("e", [1.0]), ("f", [nan, 1.0]), ("g", [inf, 1.0]), ("h", [0.0, 0.0]), ("i", [None, 1.0]), (None, [1.0, 1.0]), ("j", [0.0, 1.0]), ("j", [1.0, 0.1])]
    frame = spark.createDataFrame([(*r, r[0]) for r in rows], "chunk_id string, embedding array<double>, id string")
    usable = usable_vectors(frame, "chunk_id", "embedding", 2)
    assert {r["id"] for r in usable.collect()} == {"a", "b", "c", "j"}
    assert usable.select("id", "vector").distinct().count() == 4
    nearest = {r["id"]: [n["id"] for n in r["neighbours"]] for r in nearest_vectors(usable, 2).collect()}
    assert nearest["c"] == ["a", "b"] and nearest["a"] == ["b", "c"]
    assert ("a", "b") in {(r["first"], r["second"]) for r in neighbour_pairs(nearest_vectors(usable, 2)).collect()}
    assert nearest_vectors(usable.limit(0)).count() == 0
    assert [r["neighbours"] for r in nearest_vectors(usable.filter("id = 'b'")).collect()] == [[]]


def test_large_groups_of_equal_vectors_are_exact(spark):
    rng = np.random.default_rng(4)
    base = vectors(60, seed=4)
    of = np.concatenate([np.zeros(150, int), np.ones(40, int), np.full(12, 2), rng.integers(3, 60, 150)])
    x = base[of] * rng.choice([0.5, 1.0, 2.0], (len(of), 1)).astype(np.float32)
    names = [f"v{i:05d}" for i in rng.permutation(len(of))]
    frame = spark.createDataFrame([(n, [float(y) for y in v]) for n, v in zip(names, x)], "id string, vector array<float>")
    got = {r["id"]: [n["id"] for n in r["neighbours"]] for r in nearest_vectors(frame.unionByName(frame.limit(50))).collect()}
    assert got == brute_neighbours(names, x, 10)


def test_a_hot_region_is_divided_and_its_askers_are_spread(spark, monkeypatch):
    from inkspan.llm import neighbours as V

    for name, value in {"SAMPLE": 256, "PER_CENTRE": 64, "CAPACITY": 128, "ASKERS": 16}.items():
        monkeypatch.setattr(V, name, value)
    rng = np.random.default_rng(3)
    inner = rng.normal(size=24) + 0.15 * rng.normal(size=(100, 24))
    hot = np.repeat(inner, 15, axis=0) + 0.03 * rng.normal(size=(1500, 24))  # one dense region of small clusters holds most of the rows
    x = np.concatenate([hot, np.repeat(rng.normal(size=(35, 24)), 20, axis=0) + 0.3 * rng.normal(size=(700, 24))]).astype(np.float32)
    names = [f"v{i:05d}" for i in range(len(x))]
    frame = spark.createDataFrame([(n, [float(y) for y in v]) for n, v in zip(names, x)], "id string, vector array<float>")
    groups = {}
    grouped = V._grouped
    monkeypatch.setattr(V, "_grouped", lambda routed: groups.setdefault("rows", grouped(routed)))
    got = {r["id"]: [n["id"] for n in r["neighbours"]] for r in nearest_vectors(frame).collect()}
    true = brute_neighbours(names, x, 10)
    assert set(got) == set(names)
    assert np.mean([len(set(got[n]) & set(true[n])) / 10 for n in names]) > 0.9
    sizes = groups["rows"].groupBy("shard", "part").agg({"member": "count"}).toPandas()
    members = groups["rows"].filter("member").groupBy("shard", "part").count().toPandas()
    assert members["count"].max() <= 128 and sizes["count(member)"].max() <= 128 + 3 * 16  # parts are drawn by hash
    assert sizes["part"].max() > 0 and sizes["shard"].str.contains(".", regex=False).any()


def test_a_vector_is_stored_once_and_shards_are_answered_in_parts(spark, monkeypatch):
    from pathlib import Path

    from inkspan.llm import neighbours as V

    monkeypatch.setattr(V, "PER_CENTRE", 100)
    x = vectors(900, 256, seed=8).astype(np.float16).astype(np.float32)
    x[:5] += np.float32(1e-5)  # not all in half precision
    names = [f"v{i:05d}" for i in range(len(x))]
    frame = spark.createDataFrame([(n, [float(y) for y in v]) for n, v in zip(names, x)], "id string, vector array<float>").repartition(4)
    sizes, cut = [], V.cut

    def measured(df, **how):
        table = cut(df, **how)
        sizes.append(sum(f.stat().st_size for f in Path(table._written_at.removeprefix("file:")).glob("*.parquet")))
        return table

    monkeypatch.setattr(V, "cut", measured)
    found = []
    for wave in (1 << 19, 300):
        monkeypatch.setattr(V, "WAVE", wave, raising=False)
        found.append({r["id"]: [tuple(n) for n in r["neighbours"]] for r in nearest_vectors(frame).collect()})
    assert max(sizes) < len(x) * (2 * 256 + 64) + 20_000  # two bytes a number, once, with the names of the shards
    assert found[0] == found[1]
    true = brute_neighbours(names, x, 10)
    assert np.mean([len({i for _, i in found[0][n]} & set(true[n])) / 10 for n in names]) > 0.9
    assert np.array_equal(V._unpack(pd.Series(V._pack(x)), 256), x)


def test_hot_roots_are_not_shuffled_by(spark, monkeypatch):
    from inkspan.llm import components as C

    monkeypatch.setattr(C, "HOT_LEAST", 4)
    rng = np.random.default_rng(4)
    star = [(f"hub{i % 3}", f"leaf{i:04d}") for i in range(300)]  # most components hook to three hubs
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(120)] + [("c050", "hub1")]
    some = [(f"x{a:03d}", f"x{b:03d}") for a, b in rng.integers(0, 150, (110, 2))]
    links = star + chain + some
    group = {}
    for u, v in links:
        group.setdefault(u, {u}), group.setdefault(v, {v})
        if group[u] is not group[v]:
            group[u] |= group[v]
            for w in list(group[v]):
                group[w] = group[u]
    frame = spark.createDataFrame(links, "u string, v string")
    got = {r["record_id"]: r["group_id"] for r in connected_groups(frame).collect()}
    assert got == {w: min(g) for w, g in group.items()}


def test_frequent_items_and_huge_baskets_are_counted_exactly(spark, monkeypatch):
    from collections import Counter
    from itertools import combinations

    from inkspan.llm import cooccurrence as O

    rng = np.random.default_rng(6)
    baskets = {f"b{k}": sorted(set(rng.zipf(1.6, 12) % 60)) for k in range(150)} | {f"huge{k}": list(range(60)) for k in range(5)}
    rows = [(b, f"i{i:02d}") for b, items in baskets.items() for i in items]
    counts = Counter(p for items in baskets.values() for p in combinations(sorted(f"i{i:02d}" for i in items), 2))
    n_of = Counter(i for _, i in rows)
    n = len(baskets)
    true = {p: c for p, c in counts.items() if c >= 4 and c * n >= 1.2 * n_of[p[0]] * n_of[p[1]]}
    for frequent in (0, 7, 1000):
        monkeypatch.setattr(O, "FREQUENT", frequent)
        got = {(r["item_a"], r["item_b"]): r["n_ab"] for r in O.frequent_pairs(spark.createDataFrame(rows, "basket string, item string"), 4, 1.2, block=8).collect()}
        assert got == true
