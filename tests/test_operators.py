"""Windows, buckets, joins and metrics on literal rows and against plain Python."""

import itertools
import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from causeway.functions import text as X
from causeway.operators import aggregates as A
from causeway.operators import bootstrap as Boot
from causeway.operators import buckets as B
from causeway.operators import evaluation as E
from causeway.operators import graph as G
from causeway.operators import sparse as S
from causeway.operators import windows as W
from causeway.operators.asof import asof_backward
from causeway.operators import dense
from causeway.operators.dense import best_partners, causal_affinity, exact_pairs, nearest, tree_of_hits
from causeway.operators.joins import require_unique
from causeway.operators.ranking import with_average_rank, with_prefix_sums, with_row_number
from causeway.plans import features, gates


def seq(spark, flags, user=1):
    return spark.createDataFrame([(user, i, bool(f)) for i, f in enumerate(flags)], "u long, t long, f boolean")


def col(df, name, order="t"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_rolling_sum_is_zero_until_full(spark):
    df = seq(spark, [1, 1, 0, 1]).withColumn("a", F.col("f").cast("int"))
    out = df.withColumn("x", W.rolling_prior_sum("a", 3, ["u"], ["t"])).withColumn("y", W.rolling_prior_sum("a", 3, ["u"], ["t"], partial=True))
    assert col(out, "x") == [0, 0, 0, 2] and col(out, "y") == [0, 1, 2, 2]


def test_strict_prior_hides_peers(spark):
    df = spark.createDataFrame([(1, 5, 1), (1, 5, 1), (1, 6, 1)], "u long, t long, a int")
    assert sorted(col(df.withColumn("x", F.coalesce(W.strict_prior(F.sum("a"), ["u"], "t"), F.lit(0))), "x")) == [0, 0, 2]


def test_rows_since_and_consecutive(spark):
    df = seq(spark, [0, 1, 0, 0, 1, 0])
    assert col(W.rows_since(df, "f", ["u"], ["t"], "x"), "x") == [999, 999, 0, 1, 2, 0]
    assert col(W.consecutive_prior(df, "f", ["u"], ["t"], "x"), "x") == [0, 1, 0, 1, 2, 0]


def test_runs_and_trailing_streak(spark):
    df = seq(spark, [1, 1, 0, 1, 1, 1])
    assert sorted((r["first"], r["length"]) for r in W.runs(df, "f", ["u"], ["t"]).collect()) == [(0, 2), (3, 3)]
    assert W.trailing_streak(df, "f", ["u"], ["t"]).first()["streak"] == 3


def test_shift_stays_inside_user(spark):
    df = seq(spark, [1, 1]).unionByName(seq(spark, [0, 0], 2)).withColumn("a", F.col("f").cast("int"))
    assert [r["x"] for r in df.withColumn("x", W.exclusive_sum("a", ["u"], ["t"])).orderBy("u", "t").collect()] == [0, 1, 0, 0]


def test_asof_nulls_strict_tolerance_ties(spark):
    left = spark.createDataFrame([(1, 10), (1, 4), (None, 10), (2, 10)], "k long, t long")
    right = spark.createDataFrame([(1, 4, "a", 1), (1, 10, "b", 1), (1, 10, "c", 2), (None, 9, "n", 1)], "k long, t long, v string, i long")
    got = lambda **o: {(r["k"], r["t"]): r["v"] for r in asof_backward(left, right, ["k"], "t", "t", ["v"], "i", **o).collect()}
    assert got() == {(1, 10): "c", (1, 4): "a", (None, 10): None, (2, 10): None}
    assert got(strict=True) == {(1, 10): "a", (1, 4): None, (None, 10): None, (2, 10): None}
    assert got(strict=True, tolerance=5)[(1, 10)] is None


def test_asof_against_python(spark):
    r = random.Random(3)
    ls = [(i, r.randrange(4), r.randrange(50)) for i in range(120)]
    rs = [(i, r.randrange(4), r.randrange(50)) for i in range(80)]
    left, right = spark.createDataFrame(ls, "i long, k long, t long"), spark.createDataFrame(rs, "j long, k long, t long")
    got = {x["i"]: x["j"] for x in asof_backward(left, right, ["k"], "t", "t", ["j"], "j").collect()}
    want = {i: max(((t2, j) for j, k2, t2 in rs if k2 == k and t2 <= t), default=(0, None))[1] for i, k, t in ls}
    assert got == want


def test_cut_sides(spark):
    df = spark.createDataFrame([(7.0,), (8.0,), (None,)], "x double")
    out = df.select(B.cut_right(F.col("x"), [7], ["a", "b"]).alias("r"), B.cut_left(F.col("x"), [7], ["a", "b"]).alias("l")).collect()
    assert [(r["r"], r["l"]) for r in out] == [("a", "b"), ("b", "b"), (None, None)]


def test_equal_chunks_last_takes_rest(spark):
    df = spark.range(23).select(F.col("id").alias("t"))
    sizes = {r["c"]: r["n"] for r in B.equal_chunks(df, ["t"], 10, "c").groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sizes == {**{i: 2 for i in range(9)}, 9: 5}


def test_global_order_helpers(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(200)], "t long, v long").repartition(5)
    numbered, n = with_row_number(df, ["v", "t"], "i")
    assert n == 200 and [r["t"] for r in numbered.orderBy("i").collect()] == [t for t, _ in sorted(((i, i % 7) for i in range(200)), key=lambda x: (x[1], x[0]))]
    summed, total = with_prefix_sums(df, ["t"], {"c": F.col("v")})
    assert [r["c"] for r in summed.orderBy("t").collect()] == list(itertools.accumulate(i % 7 for i in range(200))) and total["c"] == sum(i % 7 for i in range(200))
    ranks = {r["v"]: r["r"] for r in with_average_rank(spark.createDataFrame([(1,), (1,), (3,), (None,)], "v long"), "v", "r").collect()}
    assert ranks == {1: 1.5, 3: 3.0, None: None}


def brute_auc(rows):
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)


def test_auc_with_ties(spark):
    r = random.Random(5)
    rows = [(float(r.randrange(12)), r.randrange(2)) for _ in range(300)]
    df = spark.createDataFrame(rows, "s double, y int")
    assert math.isclose(E.auc(df, "s", "y").first()["auc"], brute_auc(rows))
    assert E.auc(df.where("y = 1"), "s", "y").first()["auc"] is None
    weighted = E.auc(df.withColumn("w", F.lit(3).cast("long")), "s", "y", F.col("w")).first()
    assert math.isclose(weighted["auc"], brute_auc(rows)) and weighted["n_pos"] == 3 * sum(y for _, y in rows)


def test_bootstrap_covers_and_repeats(spark):
    r = random.Random(8)
    df = spark.createDataFrame([(i % 40, r.random() + 0.5 * (i % 3 == 0), int(i % 3 == 0)) for i in range(600)], "u long, s double, y int")
    point = E.auc(df, "s", "y").first()["auc"]
    a, b = (Boot.interval(Boot.bootstrap_auc(df, "s", "y", "u", 60), "auc").first() for _ in range(2))
    assert a == b and a["low"] < point < a["high"]


@pytest.mark.parametrize("n", [1, 7, 1024, 2500, 5000])
def test_draws_of_every_replicate_sum_to_the_clusters(n):
    import numpy as np

    whole = Boot.DrawTree(n, 30, 4).draws(np.arange(n))
    assert whole.shape == (n, 30) and (whole.sum(axis=0) == n).all()
    some = np.random.default_rng(0).integers(0, n, 200)
    assert (Boot.DrawTree(n, 30, 4).draws(some) == whole[some]).all()
    if n >= 1024:
        assert abs(whole.var() - (1 - 1 / n)) < 0.05 and abs((whole == 0).mean() - np.exp(-1)) < 0.01


def numpy_areas(some, weight, k):
    area = sum(weight[p[0]][k] * weight[n[0]][k] * ((p[1] > n[1]) + (p[1] == n[1]) / 2) for p in some if p[2] for n in some if not n[2])
    pos, neg = (sum(weight[x[0]][k] for x in some if x[2] == v) for v in (1, 0))
    return area, pos, neg


@pytest.mark.parametrize("scores", [9, 1, 400])
def test_bootstrap_replays_in_numpy(spark, scores):
    """Every replicate's AUC, from the same tree over the plain rows; groups, null clusters, ties over several partitions."""
    import numpy as np

    r = random.Random(3)
    rows = [(f"u{i % 13}" if i % 13 else None, float(r.randrange(scores)), r.randrange(2), r.choice(["a", "b", None])) for i in range(400)]
    df = spark.createDataFrame(rows, "u string, s double, y int, g string").repartition(7)
    index = {x["_c"]["c"]: x["index"] for x in Boot.cluster_draws(df, "u", 8, 5).collect()}
    tree = Boot.DrawTree(13, 8, 5).draws(np.arange(13))
    weight = {u: tree[i - 1] for u, i in index.items()}
    assert sorted(index.values()) == list(range(1, 14))
    got = {(x["g"], x["replicate"]): x["auc"] for x in Boot.bootstrap_auc(df, "s", "y", "u", 8, 5, ["g"]).collect()}
    for g in ("a", "b", None):
        for k in range(8):
            area, pos, neg = numpy_areas([x for x in rows if x[3] == g], weight, k)
            assert math.isclose(got[g, k], area / pos / neg)
    pooled = Boot.pooled_bootstrap(df, "s", "y", "u", "g", 8, 5).first()
    means = [np.mean([got[g, k] for g in ("a", "b", None)]) for k in range(8)]
    assert np.allclose([pooled["low"], pooled["high"]], np.quantile(means, [0.025, 0.975]))


def test_bootstrap_interval_agrees_with_multinomial(spark):
    """The interval against the same bootstrap with clusters drawn one by one with replacement."""
    import numpy as np

    r = np.random.default_rng(2)
    u = np.arange(3000) % 300
    y = (r.random(3000) < 0.3).astype(int)
    s = r.normal(size=3000) + 0.8 * y + r.normal(size=300)[u] * 0.5
    df = spark.createDataFrame([(int(a), float(b), int(c)) for a, b, c in zip(u, s, y)], "u long, s double, y int")
    got = Boot.interval(Boot.bootstrap_auc(df, "s", "y", "u", 400), "auc").first()
    order = np.argsort(s)
    draws = []
    for _ in range(400):
        w = np.bincount(r.integers(0, 300, 300), minlength=300)[u][order]
        p, n = w * y[order], w * (1 - y[order])
        draws.append((p * (np.cumsum(n) - n)).sum() / p.sum() / n.sum())
    low, high = np.quantile(draws, [0.025, 0.975])
    assert abs(got["low"] - low) < 0.006 and abs(got["high"] - high) < 0.006


def test_keyed_prefix_sums_of_split_keys(spark):
    from causeway.operators.ranking import with_keyed_prefix_sums

    r = random.Random(5)
    rows = [(r.choice(["hot", "hot", "hot", "x", None]), i, r.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, t long, v long").repartition(9)
    got = {x["t"]: x["c"] for x in with_keyed_prefix_sums(df, ["k"], ["t"], {"c": F.col("v")}).collect()}
    run = {}
    for k, t, v in sorted(rows, key=lambda x: x[1]):
        run[k] = run.get(k, 0) + v
        assert got[t] == run[k]


def test_quantiles_match_numpy(spark):
    import numpy as np

    r = random.Random(6)
    rows = [(r.choice(["a", "b", "c"]), r.choice([None, 1.0, 2.5, r.random(), r.random() * 10])) for _ in range(300)] + [("lone", 7.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    shares = [0.0, 0.1, 0.5, 0.99, 1.0]
    for keys, groups in (([], {None: [v for _, v in rows if v is not None]}), (["k"], {k: [v for q, v in rows if q == k and v is not None] for k in "a b c lone".split()})):
        linear = {x["k"] if keys else None: [x[f"q{i}"] for i in range(5)] for x in B.quantile_cuts(df, "v", shares, keys).collect()}
        nearest = {((x["k"] if keys else None), x["share"]): x["value"] for x in B.nearest_quantile(df, "v", shares, keys).collect()}
        assert set(linear) == set(groups)
        for k, vs in groups.items():
            assert np.allclose(linear[k], np.quantile(vs, shares))
            assert [nearest[k, s] for s in shares] == [sorted(vs)[round(s * (len(vs) - 1))] for s in shares]
    assert B.quantile_cuts(df.where("v > 100"), "v", [0.5]).first()["q0"] is None


def test_permutation_is_a_permutation(spark):
    df = spark.range(50).select("id", (F.col("id") % 3).alias("b"), (F.col("id") * 2).alias("v"))
    rows = Boot.permute_within(df, "v", ["b"], "id", "p").collect()
    for b in range(3):
        assert sorted(r["v"] for r in rows if r["b"] == b) == sorted(r["p"] for r in rows if r["b"] == b)
    assert any(r["v"] != r["p"] for r in rows)


def test_kaplan_meier(spark):
    df = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, 1), (4, 0)], "t long, e int")
    got = [(r["time"], r["at_risk"], r["events"], round(r["survival"], 6)) for r in E.kaplan_meier(df, "t", "e").orderBy("time").collect()]
    assert got == [(1, 5, 1, 0.8), (3, 3, 2, round(0.8 / 3, 6))]


def expanded(pairs, members):
    """All pairs of members, from pairs of representatives and membership."""
    of = {}
    for x in members.collect():
        of.setdefault(x["rep"], []).append(x["k"])
    out = [(min(a, b), max(a, b), round(x["similarity"], 9)) for x in pairs.collect() for a in of[x["src"]] for b in of[x["dst"]]]
    return sorted(out + [(a, b, 1.0) for ks in of.values() for a in ks for b in ks if a < b])


def every_pair(v, least):
    by = {}
    for x in v.collect():
        by.setdefault(x["d"], {})[x["term"]] = x["weight"]
    dots = ((a, b, sum(w * by[b].get(t, 0) for t, w in by[a].items())) for a in by for b in by if a < b)
    return sorted((a, b, round(s, 9)) for a, b, s in dots if s >= least)


@pytest.mark.parametrize("seed,n,vocabulary,length,least", [(2, 30, 12, 4, 0.6), (3, 120, 40, 9, 0.5), (5, 80, 300, 20, 0.3)])
def test_all_pairs_prefix_filter_loses_nothing(spark, seed, n, vocabulary, length, least):
    r = random.Random(seed)
    vec = [(d, f"t{t}", r.random()) for d in range(n) for t in {min(int(r.expovariate(1) * vocabulary / 4), vocabulary - 1) for _ in range(length)}]
    v = S.normalized(spark.createDataFrame(vec, "d long, term string, weight double"), "d")
    assert expanded(*S.all_pairs(v, "d", least, 16)) == every_pair(v, least)


def plain_tfidf(texts, min_df, max_df):
    n = len(texts)
    tf = {d: Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]) for d, w in ((d, (t or "").split()) for d, t in texts)}
    df = Counter(t for c in tf.values() for t in c)
    out = {}
    for d, c in tf.items():
        w = {t: (1 + math.log(x)) * (math.log((1 + n) / (1 + df[t])) + 1) for t, x in c.items() if min_df <= df[t] <= max_df * n}
        size = math.sqrt(sum(x * x for x in w.values()))
        out |= {(d, t): round(x / size, 9) for t, x in w.items()}
    return out


def test_tfidf_sends_texts_as_numbers_and_each_term_once_a_block(spark):
    """Texts meet no exchange by term: the only one by term has a row for each block and term."""
    r = random.Random(6)
    texts = [(i, " ".join(f"w{r.randrange(40)}" for _ in range(r.randrange(30)))) for i in range(200)] + [(200, None), (201, "")]
    df = spark.createDataFrame(texts, "d long, t string").repartition(3)
    out = S.tfidf(df, "d", F.col("t"), 3, 0.5)
    want = plain_tfidf(texts, 3, 0.5)
    assert {(x["d"], x["term"]): round(x["weight"], 9) for x in out.collect()} == want
    plan = S.tfidf(df, "d", F.col("t"), 3, 0.5)._jdf.queryExecution().executedPlan().toString()
    by_term = [x for x in plan.splitlines() if "Exchange hashpartitioning(term" in x]
    assert len(by_term) == 1 and "Generate posexplode" in plan
    asked = spark.createDataFrame([("w1",), ("w2 w3",), ("none",)], "term string")
    some = S.tfidf(df, "d", F.col("t"), 3, 0.5, asked=asked).collect()
    assert {(x["d"], x["term"]): round(x["weight"], 9) for x in some} == {k: v for k, v in want.items() if k[1] in ("w1", "w2 w3")}
    few = {x["term"] for x in S.tfidf(df, "d", F.col("t"), 3, 0.5, 5).collect()}
    total = Counter(t for d, x in texts for t in ((x or "").split()) if (d, t) in want)
    assert few == {t for t, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:5]}


def test_tfidf_sends_parts_of_a_block_and_no_strings(spark, monkeypatch):
    """What is counted is a row for each block and part of its terms; no exchange has terms as strings, asked for or not."""
    monkeypatch.setattr(S, "BLOCK_WORDS", 400)
    monkeypatch.setattr(S, "PART_WORDS", 700, raising=False)
    r = random.Random(12)
    texts = [(i, " ".join(f"w{r.randrange(30)}" for _ in range(r.randrange(40)))) for i in range(150)] + [(150, "w1 w1 w2 w2"), (151, None), (152, "the of")]
    df = spark.createDataFrame(texts, "d long, t string").repartition(2)
    want = plain_tfidf([(d, "" if t == "the of" else t) for d, t in texts], 3, 0.5)
    asked = spark.createDataFrame([("w1",), ("w2 w3",), ("none",), ("w1 none",), ("w1 w2 w3",)], "term string")
    for terms in (None, asked):
        out = S.tfidf(df, "d", F.col("t"), 3, 0.5, asked=terms)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(term_part" in plan and "hashpartitioning(term#" not in plan
        got = {(x["d"], x["term"]): round(x["weight"], 9) for x in out.collect()}
        assert got == {k: v for k, v in want.items() if terms is None or k[1] in ("w1", "w2 w3")} and len(got) > 20


def test_a_search_shuffles_no_hits(spark, monkeypatch):
    """Each query meets every document, but a task answers k of a block: hits never meet in an exchange by query and document."""
    monkeypatch.setattr(S, "SEARCH_ROWS", 100)
    monkeypatch.setattr(S, "SEARCH_QUERIES", 3)
    r = random.Random(7)
    docs = [(d, f"t{t}", r.choice([0.25, 0.5, r.random()])) for d in range(150) for t in r.sample(range(8), 3)]
    asks = [(f"q{q}", f"t{t}", r.choice([0.5, 1.0])) for q in range(7) for t in r.sample(range(9), 3)]
    out = S.sparse_top_k(spark.createDataFrame(asks, "q string, term string, weight double"), "q", spark.createDataFrame(docs, "d long, term string, weight double"), "d", 4, 0.3)
    want = []
    for q in sorted({x for x, _, _ in asks}):
        sums = defaultdict(float)
        for _, t, w in (x for x in asks if x[0] == q):
            for d, _, v in (x for x in docs if x[1] == t):
                sums[d] += w * v
        best = sorted((-round(x, 9), d) for d, x in sums.items() if round(x, 9) >= 0.3)[:4]
        want += [(q, d, -x, i + 1) for i, (x, d) in enumerate(best)]
    assert sorted(map(tuple, out.collect()), key=lambda x: (x[0], x[3])) == want
    assert out._jdf.queryExecution().executedPlan().toString().count("HashAggregate") == 0


def test_text_pairs_shuffle_neither_terms_nor_products(spark, monkeypatch):
    """Blocks, parts and pairs of blocks lose nothing, and no exchange deals rows by term or by pair."""
    monkeypatch.setattr(S, "BLOCK_WORDS", 300)
    monkeypatch.setattr(S, "PRODUCTS", 50)
    plans, write = [], S.persist_shared
    monkeypatch.setattr(S, "persist_shared", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    r = random.Random(8)
    texts = [(i, " ".join(f"w{r.randrange(25)}" for _ in range(r.randrange(1, 30)))) for i in range(120)]
    texts += [(120 + i, texts[i][1]) for i in range(30)] + [(150 + i, texts[i][1] + " w1 w2") for i in range(30)] + [(180, None), (181, "")]
    df = spark.createDataFrame(texts, "d long, t string").repartition(3)
    vectors = S.tfidf_vectors(df, "d", F.col("t"), 2, 0.5, part_words=100)
    pairs, members = S.pairs_of_vectors(vectors, 0.4, 200)
    want = [(d, t, w) for (d, t), w in plain_tfidf(texts, 2, 0.5).items()]
    brute = every_pair(spark.createDataFrame(want, "d long, term string, weight double"), 0.4)
    got = expanded(pairs, members)
    assert [x[:2] for x in got] == [x[:2] for x in brute] and len(got) > 60
    assert all(abs(a[2] - b[2]) < 1e-7 for a, b in zip(got, brute))
    assert vectors.where("size(steps) > 0").count() == len({d for d, _, _ in want}) == members.count()
    plans.append(pairs._jdf.queryExecution().executedPlan().toString())
    dealt = {x.split("(")[1].split(",")[0].split("#")[0] for p in plans for x in p.splitlines() if "Exchange hashpartitioning" in x}
    assert dealt <= {"d", "b", "p", "px", "k", "name", "_h"}


def test_frequent_terms_that_cannot_lead_make_no_products(monkeypatch):
    """Mid terms of all texts lie in the heads, but no two texts have enough left there: only rare terms are multiplied. Small portions lose nothing."""
    r, n, least = random.Random(11), 300, 0.5
    of = [sorted({*r.sample(range(3000), 4), *r.sample(range(3000, 3020), 8)}) for _ in range(n)]
    of += [sorted({*x[:-2], *r.sample(range(3000, 3020), 2)}) for x in of[:40]]
    raw = [[1.0 if t < 3000 else 0.6 for t in x] for x in of]
    length = [math.sqrt(sum(w * w for w in x)) for x in raw]
    rows = {"k": range(len(of)), "steps": [np.diff(x, prepend=0).astype(np.int32) for x in of], "raw": raw, "length": length}
    dots = lambda a, b: sum(0.36 if t > 2999 else 1 for t in set(of[a]) & set(of[b])) / length[a] / length[b]
    want = {(a, b) for a in range(len(of)) for b in range(a + 1, len(of)) if dots(a, b) >= least}
    for portion, most, blocks in ((1 << 23, 1_500_000, 1), (300, 20, 2)):
        monkeypatch.setattr(S, "INDEXED", portion, raising=False)
        monkeypatch.setattr(S, "PRODUCTS", most)
        table = pa.table(rows | {"x": [k % blocks for k in rows["k"]]}, schema=pa.schema([("k", pa.int64()), ("steps", pa.list_(pa.int32())), ("raw", pa.list_(pa.float64())), ("length", pa.float64()), ("x", pa.int64())]))
        heads = pa.Table.from_batches(S._pack_heads(0.9 * least)(table.to_batches(max_chunksize=50)))
        made, got, count = [], [], np.bincount
        for x in range(blocks):
            for y in range(x, blocks):
                two = heads.filter(pc.is_in(heads["x"], pa.array([x, y])))
                two = two.append_column("px", pa.array([x] * two.num_rows)).append_column("py", pa.array([y] * two.num_rows))
                monkeypatch.setattr(np, "bincount", lambda v, weights=None, minlength=0: made.append(len(v) * (weights is not None)) or count(v, weights, minlength))
                got += S._meet_heads(least)(two).to_pylist()
                monkeypatch.setattr(np, "bincount", count)
        assert len(got) == len({(g["src"], g["dst"]) for g in got}) < 10 * len(want) and want <= {(g["src"], g["dst"]) for g in got} and len(want) >= 40
        assert sum(made) < 20 * len(of)


def test_all_pairs_of_equal_vectors_cost_no_pairs(spark):
    r = random.Random(4)
    kinds = [[(f"t{t}", r.random()) for t in r.sample(range(8), 3)] for _ in range(6)]
    vec = [(d, t, w) for d in range(60) for t, w in kinds[d % 6 if d > 20 else 0]]
    v = S.normalized(spark.createDataFrame(vec, "d long, term string, weight double"), "d")
    pairs, members = S.all_pairs(v, "d", 0.5, 4)
    assert expanded(pairs, members) == every_pair(v, 0.5)
    assert pairs.count() <= 15 and members.count() == 60
    assert S.pair_report(v, "d", 0.5).where("kind = 'copy'").count() == 54


def test_near_copies_of_many_rows_keep_their_pairs(spark, tmp_path):
    """Copies that hold more than a tenth of all rows lie beyond a vocabulary of rarer terms only."""
    from causeway.plans.all_queries import QUERIES

    rows = [(i, f"shared words of one large group stray{i % 3}") for i in range(12)] + [(i, f"other{i} text{i % 9} line{i % 7}") for i in range(12, 40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(x["src"], x["dst"]) for x in QUERIES["V10_all_pairs"](spark, str(tmp_path)).collect()}
    assert {(0, 1), (0, 2), (1, 2)} | {(i % 3, i) for i in range(3, 12)} <= got


def test_related_by_values_of_more_than_a_million_parts(spark, tmp_path):
    from causeway.plans.all_queries import QUERIES

    parts = spark.range(1, 1_000_003).select(F.col("id").alias("p_partkey"), F.lit("HOT PLATED").alias("p_type"), F.concat(F.lit("n"), F.col("id")).alias("p_name"))
    parts.write.parquet(f"{tmp_path}/part.parquet")
    got = QUERIES["D14_related_by_attribute"](spark, str(tmp_path)).agg(F.count(F.lit(1)).alias("n"), F.min("shared").alias("low"), F.max("shared").alias("high")).first()
    assert tuple(got) == (1_000_001, 2, 2)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31), (40, 40)], "a long, b long")
    got = {r["node"]: r["component"] for r in G.connected_components(edges, "a", "b").collect()}
    assert all(got[i] == 0 for i in range(21)) and got[31] == 30 and got[40] == 40


def test_exact_pairs_each_once(spark):
    df = spark.createDataFrame([(i, [1.0, float(i % 3)]) for i in range(25)], "k long, v array<double>")
    rows = [(r["src"], r["dst"]) for r in exact_pairs(df, "k", "v", -1.0).collect()]
    assert len(rows) == len(set(rows)) == 25 * 24 // 2


def test_quantiles_sort_distinct_values_only(spark, monkeypatch):
    from causeway.operators import ranking

    sorted_rows, persist = [], ranking.persist_shared
    monkeypatch.setattr(ranking, "persist_shared", lambda df, name: sorted_rows.append(persist(df, name)) or sorted_rows[-1])
    df = spark.range(10_001).select((F.col("id") % 7).cast("double").alias("v")).union(spark.createDataFrame([(None,)], "v double"))
    assert tuple(B.quantile_cuts(df, "v", [0.0, 0.25, 0.5, 1.0]).first()) == tuple(np.quantile(np.arange(10_001) % 7, [0.0, 0.25, 0.5, 1.0]))
    assert [x.count() for x in sorted_rows] == [7]


def test_exact_pairs_thinned_in_their_tasks(spark, monkeypatch):
    """Rows are copied to a bounded number of blocks; what blocks keep suffices for the best partners and the components."""
    monkeypatch.setattr(dense, "MOST_BLOCKS", 3)
    monkeypatch.setattr(dense, "TILE", (8, 24))
    monkeypatch.setattr(dense, "HELD_HITS", 40)
    v = np.round(np.random.default_rng(6).normal(size=(150, 4)), 1)
    v[100:130] = v[0]  # ties
    df = spark.createDataFrame([(i * 7 % 151, x.tolist()) for i, x in enumerate(v)], "k long, v array<float>")
    assert dense._placed(df, "k", "v", F.lit(0), 7).agg(F.max("n_b")).first()[0] == 3
    every = exact_pairs(df, "k", "v", 0.4 - 5e-10, block_rows=7).withColumn("similarity", F.round("similarity", 9))
    pairs = [tuple(x) for x in every.collect()]
    ids = [i * 7 % 151 for i in range(150)]
    unit = dict(zip(ids, v.astype(np.float32).astype(float) / np.linalg.norm(v.astype(np.float32).astype(float), axis=1)[:, None]))
    assert {x[:2] for x in pairs} == {(a, b) for a in ids for b in ids if a < b and unit[a] @ unit[b] >= 0.4 - 5e-10} and len(pairs) == len({x[:2] for x in pairs})
    few = exact_pairs(df, "k", "v", 0.4 - 5e-10, block_rows=7, keep=best_partners(5)).withColumn("similarity", F.round("similarity", 9))
    assert few.count() < len(pairs)
    assert sorted(map(tuple, nearest(few, 5).collect())) == sorted(map(tuple, nearest(every, 5).collect()))
    first = lambda pairs: sorted({b: min((-s, a) for a, x, s in pairs if x == b) for _, b, _ in pairs}.items())
    assert first([tuple(x) for x in exact_pairs(df, "k", "v", 0.4 - 5e-10, block_rows=7, keep=best_partners(1, earlier=True)).withColumn("similarity", F.round("similarity", 9)).collect()]) == first(pairs)
    share = lambda e: tuple(G.largest_component_share(e, "src", "dst").first())
    trees = exact_pairs(df, "k", "v", 0.97, block_rows=7, keep=tree_of_hits)
    assert trees.count() <= 6 * 150 and share(trees) == share(exact_pairs(df, "k", "v", 0.97, block_rows=7))


def test_exact_pairs_of_many_blocks_and_groups(spark):
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)], i % 2) for i in range(60)] + [(60, [0.0] * 4, 0), (61, None, 0)]
    df = spark.createDataFrame(rows, "k long, v array<float>, g int")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (math.dist(a, [0] * 4) or 1) / (math.dist(b, [0] * 4) or 1)
    for group in (None, F.col("g")):
        want = {(a, b) for a, v, g in rows for b, w, h in rows if a < b and v and w and cos(v, w) >= 0.4 and (group is None or g == h)}
        got = [(x["src"], x["dst"]) for x in exact_pairs(df, "k", "v", 0.4, group, block_rows=7).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_causal_affinity_uses_earlier_rows_only(spark):
    rows = spark.createDataFrame([(1, 1, 0, 1, True), (2, 1, 1, 2, False), (3, 1, 0, 3, False)], "i long, u long, e long, t long, a boolean")
    vec = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.6, 0.8])], "e long, vector array<double>")
    got = {r["i"]: (r["n_prior"], round(r["affinity"], 6)) for r in causal_affinity(rows, vec, "u", "e", ["t"], "a", "i").collect()}
    assert got == {1: (0, 0.0), 2: (1, 0.6), 3: (1, 1.0)}


def test_causal_affinity_of_histories_over_several_blocks(spark):
    """Small blocks, some without a vector or an action, give what one group of each user gives; no group is larger."""
    r = random.Random(9)
    data = [(i, (None if i % 11 == 0 else r.choice([1, 1, 1, 2, 3])), r.randrange(8), r.randrange(50), r.random() < 0.4 and not 60 < i < 90) for i in range(150)]
    v = {e: [r.gauss(0, 1) for _ in range(3)] for e in range(6)}
    rows = spark.createDataFrame(data, "i long, u long, e long, t long, a boolean")
    vec = spark.createDataFrame(list(v.items()), "e long, vector array<double>")
    mean = [sum(x[j] for x in v.values()) / len(v) for j in range(3)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for shrink in (0.0, 5.0):
        want = {}
        for i, u, e, t, _ in data:
            past = [v[e2] for i2, u2, e2, t2, a2 in data if u2 == u and (t2, i2) < (t, i) and a2 and e2 in v]
            c = [sum(x[j] for x in past) + shrink * mean[j] for j in range(3)]
            ok = e in v and (past or shrink)
            want[i] = (len(past), round(dot(c, v[e]) / math.sqrt(dot(c, c) * dot(v[e], v[e])), 9) if ok else 0.0)
        for block, shipped in ((1, 1 << 20), (7, 0), (7, 1 << 20), (4096, 0)):
            got = {x["i"]: (x["n_prior"], round(x["affinity"], 9)) for x in causal_affinity(rows, vec, "u", "e", ["t", "i"], "a", "i", shrink, block, shipped).collect()}
            assert got == want


def test_block_apply_bounds_a_group(spark):
    from causeway.operators.apply import block_apply

    df = spark.createDataFrame([(i, (None if i % 5 == 0 else i % 2), (i * 7) % 40) for i in range(100)], "i long, u long, t long")

    def number(g):
        assert len(g) <= 8
        g = g.sort_values(["t", "i"])
        return g.assign(n=g["_before"] + range(1, len(g) + 1))[["i", "n"]]

    got = {x["i"]: x["n"] for x in block_apply(df, ["u"], ["t", "i"], number, "i long, n long", 8).collect()}
    rows = [tuple(x) for x in df.collect()]
    assert got == {i: sum(u2 == u and (t2, i2) <= (t, i) for i2, u2, t2 in rows) for i, u, t in rows}


def test_leak_audit_catches_a_leak(spark):
    df = spark.createDataFrame([(1, 1, 1, True), (1, 2, 2, True)], "user_id long, email_id long, day long, actioned_24h boolean").withColumn("date_sent", F.timestamp_seconds(F.col("day") * 86400))
    good = features.confound_scores(df)
    assert features.leak_audit(good, "date_sent").first()["max_diff"] == 0
    for score, value in (("user_prior_engagement_score", math.log(2)), ("email_popularity_score", 0.9)):
        with pytest.raises(gates.GateError):
            features.leak_audit(good.withColumn(score, F.lit(value)), "date_sent")


def test_gates(spark):
    df = spark.createDataFrame([(1, None), (None, None), (3, 1)], "a long, b long")
    seen = gates.null_key_counts(df, ["a", "b"]).first()
    assert (seen["n_rows"], seen["null_cells"], seen["null_rows"]) == (3, 3, 2)
    with pytest.raises(gates.GateError):
        gates.drop_null_keys(df, ["a", "b"])
    with pytest.raises(gates.GateError):
        gates.forbid_columns(df, ["b"])
    with pytest.raises(ValueError):
        require_unique(spark.createDataFrame([(1,), (1,)], "a long"), ["a"])
    assert gates.coverage_gate(df, F.lit(False), F.lit(True), 0.9, 0.5).first()["verdict"] == "SKIP"


def test_variance_components_match_groups(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("b", "x", 10.0), ("b", "y", 12.0)], "g string, h string, y double")
    got = {r["keys"]: round(r["r2"], 6) for r in A.variance_components(df, "y", [["g"], ["h"], ["g", "h"]]).collect()}
    assert got == {"g": round(1 - 4 / 85, 6), "h": round(4 / 85, 6), "g,h": 1.0}


def test_html(spark):
    assert X.visible_text("<p>a &amp; b<script>x<b></script><style>y</style> c</p>") == "a & b c"
    df = spark.createDataFrame([("<p>a &amp;lt; b</p>\n <i>c</i>",)], "h string")
    assert df.select(X.html_to_text(F.col("h")).alias("t")).first()["t"] == "a &lt; b c"
