"""Models against plain numpy: logistic by Newton's method, ridge by normal equations, isotonic by brute force, intervals."""

import itertools
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from causeway.operators import evaluation as E
from causeway.plans import models as M
from causeway.plans.all_queries import QUERIES

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def irls(x, y, penalty, rounds=60):
    """Coefficients (the intercept last, unpenalised) of the L2-penalised logistic likelihood."""
    x = np.column_stack([x, np.ones(len(x))])
    w, p = np.zeros(x.shape[1]), np.diag([penalty] * (x.shape[1] - 1) + [0.0])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve(x.T @ (x * (q * (1 - q))[:, None]) + p, x.T @ (y - q) - p @ w)
    return w


@pytest.fixture(scope="module")
def sample(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(600, 3)) * [1, 5, 0.2] + [0, 3, 1]
    y = (r.random(600) < 1 / (1 + np.exp(-(x[:, 0] - 0.3 * x[:, 1] + 1)))).astype(int)
    g = r.integers(0, 25, 600)
    rows = [(i, float(a), float(b), float(c), int(t), int(u)) for i, ((a, b, c), t, u) in enumerate(zip(x, y, g))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y int, g int").withColumn("at", F.timestamp_seconds(1_600_000_000 + F.col("id") * 86_400 * 2)).repartition(4)
    return df.persist(), x, y, g


def standard(x):
    return (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)


def test_logistic_matches_newton(sample):
    df, x, y, _ = sample
    scored, coef = M.fit_logistic(df, ["a", "b", "c"], "y")
    want = irls(standard(x), y, 1.0)
    got = {r["feature"]: r["coefficient"] for r in coef.collect()}
    assert np.allclose([got[k] for k in "abc"], want[:3], atol=2e-3)
    p = 1 / (1 + np.exp(-(standard(x) @ want[:3] + want[3])))
    assert np.allclose([r["score"] for r in scored.orderBy("id").collect()], p, atol=2e-3)
    assert [r["feature"] for r in coef.orderBy("place").collect()] == sorted("abc", key=lambda k: -abs(got[k]))


def test_robust_intervals_match_numpy(sample):
    df, x, y, g = sample
    scored, coef = M.fit_logistic(df, ["a", "b", "c"], "y")
    got = {r["feature"]: r for r in M.robust_intervals(scored, "y", "g", ["a", "b", "c"], {r["feature"]: r["coefficient"] for r in coef.collect()}).collect()}
    z, p = standard(x), np.array([r["score"] for r in scored.orderBy("id").collect()])
    bread = np.linalg.inv(z.T @ (z * (p * (1 - p))[:, None]))
    grads = np.array([(z[g == k] * (y - p)[g == k][:, None]).sum(axis=0) for k in np.unique(g)])
    se = np.sqrt(np.diag(bread @ (grads.T @ grads) @ bread) * len(grads) / (len(grads) - 1))
    for k, s in zip("abc", se):
        assert np.isclose(got[k]["high"] - got[k]["low"], 2 * 1.96 * s, rtol=1e-4)


def test_ridge_matches_normal_equations(sample):
    df, x, _, _ = sample
    t = x[:, 0] * 2 + x[:, 1] + 5
    rows = df.withColumn("t", 2 * F.col("a") + F.col("b") + 5)
    fold = {r["id"]: r["f"] for r in df.select("id", F.pmod(F.xxhash64(F.lit(42), "id"), F.lit(5)).alias("f")).collect()}
    f = np.array([fold[i] for i in range(len(t))])
    z = standard(x[:, 1:])
    got = {r["fold"]: r["r2"] for r in M.ridge_cv(rows, ["b", "c"], "t", "id").collect()}
    for k in range(5):
        a, b = z[f != k], t[f != k]
        w = np.linalg.solve((a - a.mean(0)).T @ (a - a.mean(0)) + np.eye(2), (a - a.mean(0)).T @ (b - b.mean()))
        e = t[f == k] - (b.mean() + (z[f == k] - a.mean(0)) @ w)
        assert np.isclose(got[k], 1 - (e**2).sum() / ((t[f == k] - t[f == k].mean()) ** 2).sum(), atol=2e-3)


def pooled(y, w):
    """Least-squares increasing values of y in its order, by pooling adjacent violators."""
    value, weight, size = [], [], []
    for b, c in zip(y, w):
        value.append(float(b))
        weight.append(float(c))
        size.append(1)
        while len(value) > 1 and value[-2] >= value[-1]:
            t = weight[-2] + weight[-1]
            value[-2:] = [(value[-2] * weight[-2] + value[-1] * weight[-1]) / t]
            weight[-2:] = [t]
            size[-2:] = [size[-2] + size[-1]]
    return np.repeat(value, size)


def test_pooling_is_the_best_increasing_fit():
    """The max-min formula of isotonic regression, over all intervals."""
    r = np.random.default_rng(1)
    for n in (1, 2, 5, 17):
        y, w = r.normal(size=n), r.integers(1, 5, n).astype(float)
        mean = lambda a, b: (y[a : b + 1] * w[a : b + 1]).sum() / w[a : b + 1].sum()
        want = [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        assert np.allclose(pooled(y, w), want)


@pytest.mark.parametrize("shape", ["noise", "rising", "falling", "steps"])
def test_merged_pools_equal_plain_pooling(spark, shape):
    """100,000 distinct ranks over many partitions, windows of few pools; curves of two keys, read between and beyond pools."""
    from causeway.operators.isotonic import isotonic_pools, with_curve

    n, r = 100_000 if shape == "noise" else 20_000, np.random.default_rng(4)
    x = (np.arange(n) + 0.5) / n
    y = {"noise": r.normal(size=n) + 2 * x, "rising": x * 3.0, "falling": -x, "steps": np.floor(x * 7) + r.normal(size=n) * 0.01}[shape]
    w = r.integers(1, 4, n).astype(float)
    both = pd.DataFrame({"key": np.repeat([0, 1], n).astype(np.int32), "x": np.r_[x, x], "total": np.r_[y * w, -y * w], "weight": np.r_[w, w]})
    pools = isotonic_pools(spark.createDataFrame(both).repartition(9), window=8).toPandas().sort_values(["key", "first"])
    for key, sign in ((0, 1), (1, -1)):
        p, want = pools[pools["key"] == key], pooled(sign * y, w)
        got = np.repeat(p["value"].to_numpy(), np.searchsorted(x, p["last"].to_numpy(), "right") - np.searchsorted(x, p["first"].to_numpy()))
        assert np.allclose(got, want)
        if key == 0:
            asks = np.r_[r.random(300), 0.0, 1.0, x[:3]]
            rows = spark.createDataFrame([(i, float(a)) for i, a in enumerate(asks)], "i int, a double")
            read = with_curve(rows, F.lit(0), "a", spark.createDataFrame(pools), "v").orderBy("i").toPandas()
            assert np.allclose(read["v"], np.interp(asks, x, want)) and read["i"].tolist() == list(range(len(asks)))


@pytest.mark.parametrize("cross", [True, False])
def test_isotonic_residuals_match_numpy(spark, cross):
    r = np.random.default_rng(3)
    n = 240
    u, e = r.integers(0, 30, n).astype(float), r.normal(size=n)
    s = 0.1 * u + e + r.normal(size=n)
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(s, u, e))], "id long, s double, u double, e double").repartition(3)
    got = {x["id"]: x["residual"] for x in M.isotonic_residuals(df, "s", ["u", "e"], "id", cross_fit=cross).collect()}
    half = np.array([x["h"] for x in df.select("id", F.pmod(F.xxhash64(F.lit(42), "id"), F.lit(2 if cross else 1)).alias("h")).orderBy("id").collect()])

    def rank(v):
        return np.array([((v < x).sum() + ((v == x).sum() + 1) / 2) / len(v) for x in v])

    ranks = {c: np.zeros(n) for c in "ue"}
    for h in set(half):
        for c, v in (("u", u), ("e", e)):
            ranks[c][half == h] = rank(v[half == h])

    def curve(x, y):
        at = np.unique(x)
        return at, pooled(np.array([y[x == a].mean() for a in at]), np.array([(x == a).sum() for a in at], float))

    for h in set(half):
        fit, use = half == h, half == ((1 - h) if cross else h)
        first = curve(ranks["u"][fit], s[fit])
        left = s[fit] - np.interp(ranks["u"][fit], *first)
        second = curve(ranks["e"][fit], left)
        want = s[use] - np.interp(ranks["u"][use], *first) - np.interp(ranks["e"][use], *second)
        assert np.allclose([got[i] for i in np.flatnonzero(use)], want)


def test_folds_score_later_rows_only(sample):
    """Each fold's scores come from a model of the rows before it."""
    df, x, y, _ = sample
    scored, told = M.score_folds(df, "at", ["a", "b"], "y", most_folds=3)
    got = {r["id"]: (r["fold"], r["score"]) for r in scored.collect()}
    assert told.select("fold").distinct().count() == 3 and len({f for f, _ in got.values()}) == 3
    for fold in {f for f, _ in got.values()}:
        test = sorted(i for i, (f, _) in got.items() if f == fold)
        train = np.arange(test[0])
        assert test == list(range(test[0], test[-1] + 1))
        m, sd = x[train, :2].mean(0), x[train, :2].std(0, ddof=1)
        w = irls((x[train, :2] - m) / sd, y[train], 1.0)
        p = 1 / (1 + np.exp(-((x[test, :2] - m) / sd @ w[:2] + w[2])))
        assert np.allclose([got[i][1] for i in test], p, atol=3e-3)
    trees, gains = M.score_folds(df, "at", ["a", "b", "c"], "y", "gbt", most_folds=2, trees=5, depth=3)
    assert gains.groupBy("fold").agg(F.round(F.sum("importance"), 6).alias("s")).where("s <> 1").isEmpty()
    assert E.auc(trees, "score", "y").first()["auc"] > 0.6


def test_residual_slices_find_the_planted_slice(spark):
    df = spark.range(4000).select(F.col("id").cast("double").alias("t"), (F.col("id") % 7).cast("double").alias("v")).withColumn("loss", F.when((F.col("t") > 3000) & (F.col("v") > 3), 3.0).otherwise(1.0)).repartition(3)
    got = M.residual_slices(df, ["t", "v"], "loss", 100, 3, 1.1).orderBy(F.col("mean_loss").desc()).first()
    assert abs(got["mean_loss"] - 3.0) < 0.1 and 300 <= got["n"] <= 470 and "t >" in got["rule"] and "v >" in got["rule"]


def test_temporal_auc_matches_plain_code(spark, sample):
    df, x, y, _ = sample
    got = {r["feature"]: r["auc"] for r in M.temporal_auc(df, ["a", "b"], "y", "at").collect()}
    cut = int(np.floor(0.8 * 599))
    late = np.arange(cut + 1, 600)

    def auc(s):
        pos, neg = s[y[late] == 1], s[y[late] == 0]
        return np.mean([(p > q) + (p == q) / 2 for p, q in itertools.product(pos, neg)])

    assert np.isclose(got["a"], auc(x[late, 0])) and np.isclose(got["b"], auc(x[late, 1]))
    w = irls(standard(x[: cut + 1, :2]), y[: cut + 1], 1e-6)
    assert np.isclose(got["all"], auc(x[late, :2] / x[: cut + 1, :2].std(0, ddof=1) @ w[:2]), atol=2e-3)


@needs_data
def test_row_fingerprint_matches_plain_sum(spark):
    """The sum of row hashes, added up in Python; another value of one cell changes it."""
    import hashlib

    df = spark.read.parquet(f"{SF}/orders.parquet")
    total = sum(r["h"] for r in df.select(F.xxhash64(*sorted(df.columns)).alias("h")).collect())
    assert QUERIES["S17_row_fingerprint"](spark, SF).first()["fingerprint"] == hashlib.sha256(str(total).encode()).hexdigest()


@needs_data
def test_cell_queries_match_numpy(spark):
    """Probed neighbours are the best of the probed cells; pairs of clusters are those of rows of one cell."""
    from causeway.operators.vector_index import PROBES, VectorIndex

    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    v = np.array([r["embedding"] for r in e.orderBy("vec_id").collect()], dtype=float)
    v = v / np.linalg.norm(v, axis=1)[:, None]
    cos = np.round(v @ v.T, 9)
    cells = lambda c: np.argsort((c**2).sum(axis=1)[None, :] / 2 - v @ c.T, axis=1, kind="stable")
    near = cells(VectorIndex.build(e, "vec_id", "embedding").centers())
    got = {(r["query_id"], r["place"]): r["vec_id"] for r in QUERIES["V03_cell_probe"](spark, SF).collect()}
    hits = 0
    for q in range(0, len(v), 20):
        probed = np.isin(near[:, 0], near[q, :PROBES]) & (np.arange(len(v)) != q)
        want = sorted(np.flatnonzero(probed), key=lambda i: (-cos[q, i], i))[:25]
        assert [got[q, p + 1] for p in range(25)] == want
        hits += len(set(want) & set(sorted((i for i in range(len(v)) if i != q), key=lambda i: (-cos[q, i], i))[:25]))
    assert hits >= 0.9 * len(got)
    cell, best = cells(VectorIndex.build(e, "vec_id", "embedding", n_cells=10).centers())[:, 0], {}
    for i in range(len(v)):
        some = sorted((j for j in range(len(v)) if j != i and cell[j] == cell[i] and cos[i, j] >= 0.3), key=lambda j: (-cos[i, j], j))[:3]
        best |= {(min(i, j), max(i, j)): cos[i, j] for j in some}
    got = {(r["src"], r["dst"]): r["similarity"] for r in QUERIES["V16_cluster_pairs"](spark, SF).collect()}
    assert set(got) == set(best) and all(abs(got[k] - best[k]) < 1e-8 for k in got)
