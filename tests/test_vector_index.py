"""The stored index: recall against all pairs, growth of what it compares, appended rows, copies and odd tables."""

import math
import os

import numpy as np
import pytest

from causeway.operators.dense import exact_pairs, nearest
from causeway.operators.vector_index import CELL_SAMPLE, VectorIndex, cell_count, training_sample

DATA = "/root/testdata"
KIND = "k long, v array<double>"


def frame(spark, v, first=0):
    return spark.createDataFrame([(first + i, [float(y) for y in x]) for i, x in enumerate(v)], KIND)


def clustered(seed, n, width=8):
    r = np.random.default_rng(seed)
    return r.normal(size=(12, width))[r.integers(12, size=n)] + r.normal(size=(n, width)) * 0.4


@pytest.mark.skipif(not os.path.isdir(f"{DATA}/sf0.1"), reason="needs the test tables")
def test_recall_and_growth_on_the_tables(spark):
    """Nine tenths of all pairs of a cosine of 0.3 or more, and of each row's neighbours; work grows with a power below 1.6."""
    n, work = {}, {}
    for sf in ("sf0.01", "sf0.1"):
        e = spark.read.parquet(f"{DATA}/{sf}/embeddings.parquet")
        index = VectorIndex.build(e, "vec_id", "embedding")
        n[sf], work[sf] = e.count(), index.compared()
        want = {(r["src"], r["dst"]): r["similarity"] for r in exact_pairs(e, "vec_id", "embedding", 0.3).collect()}
        got = {(r["src"], r["dst"]): r["similarity"] for r in index.near_pairs(0.3).collect()}
        assert set(got) <= set(want) | {p for p in got if abs(got[p] - 0.3) < 1e-8}
        assert len(set(got) & set(want)) >= 0.9 * len(want)
        assert all(abs(got[p] - want[p]) < 1e-8 for p in set(got) & set(want))
    assert math.log(work["sf0.1"] / work["sf0.01"]) / math.log(n["sf0.1"] / n["sf0.01"]) <= 1.6
    want, got = (set(map(tuple, nearest(p, 5).select("src", "dst").collect())) for p in (exact_pairs(e, "vec_id", "embedding", 0.2), index.near_pairs(0.2)))
    assert len(want & got) >= 0.9 * len(want)


def test_refinement_wins_recall(spark):
    df = frame(spark, clustered(1, 900))
    index = VectorIndex.build(df, "k", "v", n_cells=30, block_rows=40)
    want = set(map(tuple, exact_pairs(df, "k", "v", 0.9).select("src", "dst").collect()))
    plain, refined = (set(map(tuple, index.near_pairs(0.9, n_probe=2, refine_with=m).select("src", "dst").collect())) for m in (0, 12))
    assert plain < refined <= want and len(refined) >= 0.9 * len(want)


def test_search_after_append_equals_brute_force_of_all_cells(spark, tmp_path):
    v, asks = clustered(2, 400), clustered(3, 20)
    index = VectorIndex.build(frame(spark, v[:250]), "k", "v", f"file://{tmp_path}/index", block_rows=50)
    VectorIndex(spark, f"file://{tmp_path}/index").append(frame(spark, v[250:], 250), "k", "v")
    assert index.rows().count() == 400 and index.rows().select("cell").distinct().count() <= len(index.centers()) == 15
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    cos = np.round(unit(asks) @ unit(v).T, 9)
    want = {(1000 + q, p + 1): int(i) for q, row in enumerate(cos) for p, i in enumerate(np.lexsort((np.arange(400), -row))[:7])}
    whole = {(r["query"], r["place"]): r["key"] for r in index.search(frame(spark, asks, 1000), "k", "v", 7, n_probe=15).collect()}
    assert whole == want
    few = {(r["query"], r["key"]) for r in index.search(frame(spark, asks, 1000), "k", "v", 7, n_probe=5).collect()}
    assert len(few & {(q, i) for (q, _), i in want.items()}) >= 0.9 * len(want)


def test_copies_zero_vectors_nulls_and_an_empty_table(spark):
    v = clustered(4, 60)
    rows = np.vstack([v, np.repeat(v[:1], 50, axis=0), np.zeros((3, 8))])
    df = frame(spark, rows).union(spark.createDataFrame([(500, None)], KIND))
    index = VectorIndex.build(df, "k", "v", block_rows=16)
    pairs = index.near_pairs(0.8, n_probe=100)
    firsts = frame(spark, v)
    got = {(r["src"], r["dst"]): round(r["similarity"], 6) for r in pairs.collect()}
    want = {(r["src"], r["dst"]): round(r["similarity"], 6) for r in exact_pairs(firsts, "k", "v", 0.8).collect()} | {(0, i): 1.0 for i in range(60, 110)}
    assert got == want
    none = VectorIndex.build(df.where("false"), "k", "v")
    assert none.rows().count() == 0 and none.near_pairs(0.5).count() == 0 and none.search(firsts, "k", "v", 3).count() == 0


def test_centers_are_no_literals(spark):
    index = VectorIndex.build(frame(spark, clustered(5, 500)), "k", "v")
    plan = index.near_pairs(0.5)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000


def test_training_grows_no_faster_than_the_table(spark):
    """Centres times sample rows: with a sample of all rows that is the power 1.5."""
    rows, work = {}, {}
    for n in (160_000, 640_000):
        df = spark.range(n).selectExpr("id as k", "array(double(id), 1.0D) as v")
        rows[n] = training_sample(df, n, cell_count(n), 500_000).count()
        work[n] = rows[n] * cell_count(n)
        assert 0.8 < rows[n] / (CELL_SAMPLE * cell_count(n)) < 1.2
    assert work[640_000] <= 4 * 1.3 * work[160_000]


def test_an_index_of_copies_alone(spark):
    df = spark.range(6_000).selectExpr("id as k", "array(1.0D, 2.0D) as v")
    pairs = VectorIndex.build(df, "k", "v").near_pairs(0.9)
    assert pairs.count() == 5_999 and pairs.where("src <> 0 or similarity < 1").count() == 0
