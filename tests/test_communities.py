"""Communities against a plain greedy search, on planted partitions and odd graphs."""

import collections
import random

import pytest

from causeway.operators.communities import communities, community_report


def quality(edges, label):
    total = sum(2 * w for _, _, w in edges)
    inside, degree = 0.0, collections.Counter()
    for a, b, w in edges:
        degree[label[a]] += w
        degree[label[b]] += w
        inside += 2 * w * (label[a] == label[b])
    return inside / total - sum((d / total) ** 2 for d in degree.values())


def plain_search(edges, seed=0):
    """One node after another to the best neighbouring community, then the same on the graph of communities."""
    r = random.Random(seed)
    total = sum(2 * w for _, _, w in edges)
    graph = collections.defaultdict(collections.Counter)
    for a, b, w in edges:
        graph[a][b] += w
        graph[b][a] += w
    of = {n: n for n in graph}
    while True:
        own, degree = {n: n for n in graph}, {n: sum(graph[n].values()) for n in graph}
        size, moved_any, order = dict(degree), False, list(graph)
        r.shuffle(order)
        moved = True
        while moved:
            moved = False
            for n in order:
                near = collections.Counter()
                for m, w in graph[n].items():
                    if m != n:
                        near[own[m]] += w
                size[own[n]] -= degree[n]
                here = near[own[n]] - degree[n] * size[own[n]] / total
                best, to = max(((near[c] - degree[n] * size[c] / total, c) for c in near), default=(here, own[n]))
                if best > here + 1e-9:
                    own[n], moved, moved_any = to, True, True
                size[own[n]] += degree[n]
        of = {n: own[c] for n, c in of.items()}
        if not moved_any:
            return of
        smaller = collections.defaultdict(collections.Counter)
        for a in graph:
            for b, w in graph[a].items():
                smaller[own[a]][own[b]] += w
        graph = smaller


def planted(sizes, inside, between, seed):
    r = random.Random(seed)
    group = [g for g, n in enumerate(sizes) for _ in range(n)]
    return [(i, j, 1.0) for i in range(len(group)) for j in range(i) if r.random() < (inside if group[i] == group[j] else between)], group


def run(spark, edges):
    found, told = communities(spark.createDataFrame(edges, "a long, b long, w double"), "a", "b", "w")
    return {r["node"]: r["community"] for r in found.collect()}, told


@pytest.mark.parametrize("sizes,inside,between,seed", [([25] * 10, 0.35, 0.02, 1), ([80, 20, 20, 20, 10, 10], 0.4, 0.03, 2)])
def test_planted_partitions(spark, sizes, inside, between, seed):
    edges, group = planted(sizes, inside, between, seed)
    label, told = run(spark, edges)
    assert abs(quality(edges, label) - told) < 1e-6
    assert told >= quality(edges, plain_search(edges)) - 0.02
    assert run(spark, edges) == (label, told)
    assert all(min(n for n, c in label.items() if c == x) == x for x in set(label.values()))


def test_weights_loops_parallel_edges_and_nulls(spark):
    edges = [(1, 2, 5.0), (2, 1, 1.0), (2, 3, 4.0), (3, 1, 4.0), (3, 4, 0.5), (4, 5, 3.0), (5, 6, 3.0), (6, 4, 3.0), (6, 6, 2.0), (7, 8, 1.0), (9, None, 1.0), (9, 10, 0.0)]
    label, told = run(spark, edges)
    assert label == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 7, 8: 7}
    assert told == pytest.approx(quality([e for e in edges if None not in e and e[2]], label), abs=1e-9)


def test_no_edges(spark):
    df = spark.createDataFrame([], "a string, b string")
    found, told = communities(df, "a", "b")
    assert found.count() == 0 and told == 0.0
    row = community_report(spark.createDataFrame([("x", "y")], "a string, b string"), "a", "b").first()
    assert (row["n_nodes"], row["n_communities"], row["share"], row["modularity"]) == (2, 1, 1.0, 0.0)
