"""Top products, ball k-means and the audit of filters against plain Python."""

import collections
import hashlib
import itertools
import math
import re

import numpy as np
import pytest

from causeway.llm import ball_kmeans, norm_buckets
from causeway.llm.filter_audit import audit_filters
from causeway.llm.int_vectors import largest_component

VECTORS = "vec_id long, embedding array<double>, id string, v int, q long, shard int, cluster string"


def table(spark, rows):
    """With columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, v, "x", 1, 2, 3, "c") for i, v in rows], VECTORS)


def whole(v, scale, most):
    return [max(-most, min(most, math.floor(scale * x) if abs(x) * scale < 2**60 else int(math.copysign(most, x)))) for x in v]


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def random_rows(seed=3, n=300, width=6):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(5, width))
    rows = [(i, ((centers[r.integers(5)] + 0.1 * r.normal(size=width)) * r.choice([0.05, 0.5, 1.0, 3.0])).tolist()) for i in range(n)]
    rows += [(n + i, list(rows[7][1])) for i in range(40)]  # copies of one vector: ties
    rows += [(1000, list(rows[7][1]))] * 30 + [(1000, rows[8][1]), (50, rows[9][1])]  # a repeated row; ids with several vectors
    rows += [(None, list(rows[7][1])), (None, None), (2000, None), (2001, [None] * width), (2002, [float("nan")] * width), (2003, [float("inf")] + [0.0] * (width - 1))]
    rows += [(2050, [0.0] * width), (2100, [1e30] + [0.0] * (width - 1)), (2150, [1.0, 2.0]), (2151, [3.0, -1.0]), (2200, []), (2201, [])]
    return rows


def brute_top(rows, every, k, scale=256):
    most = largest_component(64)
    have = [(i, tuple(whole(v, scale, most))) for i, v in rows if usable(v)]
    out = []
    for qi, qv in {(i, v) for i, v in have if i is not None and i % every == 0}:
        found = sorted(((-sum(a * b for a, b in zip(qv, v)), i is None, i or 0) for i, v in have if i != qi and len(v) == len(qv)))[:k]
        out += [(qi, n + 1, None if null else i, -s) for n, (s, null, i) in enumerate(found)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("bucket_rows", [16, 2048])
def test_top_products_match_brute_force(spark, bucket_rows):
    rows = random_rows()
    got = norm_buckets.top_products(table(spark, rows), "id % 50 = 0", 5, bucket_rows=bucket_rows)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_top(rows, 50, 5)


def test_top_products_of_fewer_rows_and_of_none(spark):
    assert norm_buckets.top_products(table(spark, []), "id % 50 = 0", 5).count() == 0
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None)]
    assert [tuple(r) for r in norm_buckets.top_products(table(spark, rows), "id % 50 = 0", 5).collect()] == [(0, 1, 1, 256 * 128)]
    assert norm_buckets.top_products(table(spark, [(1, [1.0])]), "id % 50 = 0", 5).count() == 0


def test_all_ways_through_a_bucket_answer_alike():
    """Skewed lengths and near copies make queries skip buckets, and take coordinates or lengths in others."""
    r = np.random.default_rng(5)
    base = r.normal(size=(60, 32))
    v = np.repeat(base, 10, axis=0) * 200 * r.choice([0.02, 0.2, 1.0], size=(600, 1)) + r.normal(size=(600, 32))
    v = np.floor(v).astype(np.int32)
    ident, null = np.arange(600), np.zeros(600, bool)
    shard = norm_buckets.Shard(ident, null, v, (v.astype(np.int64) ** 2).sum(axis=1), 64)
    asks = np.arange(0, 600, 7)
    score = v[asks].astype(np.int64) @ v.astype(np.int64).T
    score[np.arange(len(asks)), asks] = norm_buckets.NONE
    want = [sorted(((-s, i) for i, s in enumerate(row)))[:5] for row in score.tolist()]
    row, found, _, got = shard.search(asks, v[asks].astype(np.int64), np.full(len(asks), norm_buckets.NONE), 5)
    assert [(int(a), -int(s), int(i)) for a, s, i in zip(row, got, found)] == [(a, s, i) for a, top in enumerate(want) for s, i in top]
    assert min(shard.went["skipped"], shard.went["coordinate"], shard.went["length"]) > 0
    assert shard.went["products"] < 0.7 * len(asks) * 600


def test_products_beyond_floats_are_exact():
    v = np.array([[2**26, 2**26 - 1], [2**26, 2**26 - 2], [2**26 - 1, 2**26], [3, 4]], dtype=np.int32)
    shard = norm_buckets.Shard(np.arange(4), np.zeros(4, bool), v, (v.astype(np.int64) ** 2).sum(axis=1))
    _, found, _, score = shard.search(np.array([0]), v[:1].astype(np.int64), np.array([norm_buckets.NONE]), 3)
    want = sorted((-(int(v[0, 0]) * int(x[0]) + int(v[0, 1]) * int(x[1])), i) for i, x in enumerate(v) if i)
    assert [(-int(s), int(i)) for s, i in zip(score, found)] == want


def brute_kmeans(rows, width, k, rounds, scale=64):
    have = [(i, whole(v, scale, largest_component(width))) for i, v in rows if usable(v) and len(v) == width]
    start = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in have if i is not None)[:k]
    centers, labels = [v for _, v in start], []
    for n in range(rounds + 1):
        labels = [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centers)) for _, v in have]
        for j in range(len(centers) if n < rounds else 0):
            members = [v for (_, v), (_, l) in zip(have, labels) if l == j]
            if members:
                centers[j] = [sum(x) // len(members) for x in zip(*members)]
    inertia = collections.Counter()
    for d, j in labels:
        inertia[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), sha[j]) for (i, _), (d, j) in zip(have, labels)), key=repr)


@pytest.mark.parametrize("k", [1, 4, 16])
def test_ball_kmeans_matches_plain_rounds(spark, k):
    rows = [(i, v) for i, v in random_rows() if i != 2100]
    got = ball_kmeans.cluster_report(table(spark, rows), width=6, k=k)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_kmeans(rows, 6, k, 3)


def test_ball_kmeans_of_fewer_rows_huge_numbers_and_none(spark):
    assert ball_kmeans.cluster_report(table(spark, [])).count() == 0
    assert ball_kmeans.cluster_report(table(spark, [(None, [1.0, 2.0])]), width=2).count() == 0  # nothing to start from
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [5.0, 5.0])]
    assert sorted(map(tuple, ball_kmeans.cluster_report(table(spark, rows), width=2).collect()), key=repr) == brute_kmeans(rows, 2, 16, 3)
    rows += [(3, [1e300, -1e300]), (4, [-1e300, 0.0])]
    got = ball_kmeans.cluster_report(table(spark, rows), width=2)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_kmeans(rows, 2, 16, 3)


def test_balls_compare_few_centroids_and_lose_none():
    r = np.random.default_rng(1)
    centers = r.integers(-200, 200, size=(40, 8))
    v = centers[r.integers(40, size=4000)] + r.integers(-25, 25, size=(4000, 8))
    own, distance, _ = ball_kmeans.assign_all(v, centers)
    moved = centers + r.integers(-4, 5, size=centers.shape)
    radii = np.array([math.sqrt(distance[own == i].max(initial=0)) for i in range(40)]) + np.sqrt(((moved - centers) ** 2).sum(axis=1))
    near = ball_kmeans.neighbours(moved, radii)
    best, least, compared = ball_kmeans.assign_near(v, own, moved, near)
    want, d, _ = ball_kmeans.assign_all(v, moved)
    assert (best == want).all() and (least == d).all() and compared.mean() < 4 and min(len(n) for n, _ in near) < 20


def brute_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1} - {None}
    toxic = {i for i, _, t in labels if t == 1} - {None}
    smallest, facts = {}, []
    for i, text, _ in docs:
        if i is not None:
            smallest[text or ""] = min(i, smallest.get(text or "", i))
    for i, text, source in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > smallest[t]}
        facts.append((source or "", {x for x, f in failed.items() if f}, i in good, i in toxic))
    out, shapley = {}, collections.Counter()
    for part in {f[0] for f in facts}:
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, x in enumerate(order, 1):
                row = [0] * 6
                for p, failed, is_good, is_toxic in facts:
                    if p == part:
                        gone, fails = bool(failed & set(order[: step - 1])), x in failed
                        removed = fails and not gone
                        for at, hit in enumerate((not gone and not fails, removed, fails and gone, failed == {x}, removed and is_good, removed and is_toxic)):
                            row[at] += hit
                out[part, order, step] = row
                shapley[part, x] += row[1]
    return sorted((*key, *row, shapley[key[0], key[1][key[2] - 1]]) for key, row in out.items())


def test_audit_matches_brute_force(spark):
    many = " ".join(f"w{i}" for i in range(60))
    docs = [(1, many, "a"), (2, many, "a"), (3, many, "b"), (3, many, "b"), (None, many, "b"), (4, None, None), (5, "", "a"), (6, "SHOUT of few", None), (7, many + " $ X" * 40, "")]
    docs += [(8, "same " * 80, "a"), (9, "same\x0b" * 80, "a"), (9, "same\x0b" * 80, "a"), (10, "Grüße 😀 naïve * " * 30, "b"), (11, ("long text with a few words | " * 30_000), "a"), (None, None, "c")]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, None), (3, None, 1), (6, 1, 1), (8, 0, 1), (9, 1, 0), (99, 1, 1), (None, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "'p' AS part", "1 AS n", "2 AS mask", "'d' AS digest")
    l = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 AS good", "2 AS first")
    got = audit_filters(d, l)
    assert sorted(map(tuple, got.collect())) == brute_audit(docs, labels)
    assert audit_filters(d.limit(0), l).count() == 0
    assert audit_filters(d, l.limit(0)).agg({"good_lost": "sum", "toxic_lost": "sum"}).first()[0] == 0
