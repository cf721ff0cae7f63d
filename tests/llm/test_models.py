"""PII, toxicity, quality classifier: brute force for the exact parts, held-out accuracy for the learned ones."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.llm import boosting, gru, pii, quality_model, toxicity
from causeway.llm.doc_stats import NAMES, stats_matrix
from tests.llm.conftest import documents

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_base_pii():
    t = "a.b+c@x-y.co.uk, 1.2.3.256 10.0.0.1.9, 4111 1111 1111 1111 x +1 (988) 555-2485 +12 3 4000-0000-0000-0002"
    got = [(pii.KINDS[k], t[a:b]) for a, k, b in pii.base_spans(t)]
    assert ("email", "a.b+c@x-y.co.uk") in got and ("ip", "10.0.0.1") in got and ("phone", "+1 (988) 555-2485") in got
    assert ("card", "4111 1111 1111 1111") in got and not any(k == "ip" and "256" in s for k, s in got)


def test_base_spans_are_the_patterns_matches():
    r = random.Random(12)
    for _ in range(3000):
        t = "".join(r.choice(["a", "B", "7", "19", "@", ".", "-", "_", "+", "%", " ", "(", ")", "255", "256", "x.y", "@b.c"]) for _ in range(r.randrange(30)))
        want = sorted((m.start(), n, m.end()) for n, (k, p) in enumerate(pii.BASE.items()) for m in p.finditer(t) if pii._passes(k, m[0]))
        assert pii.base_spans(t) == want, t


def test_very_long_runs_take_linear_time():
    import time

    pii.fitted()
    for t in ("a" * 400_000 + " 1", "a" * 400_000 + "@", "1" * 400_000, "a@" * 100_000, "1 " * 200_000, "a@b" + ".c" * 100_000):
        began = time.perf_counter()
        pii.find_pii([t], *pii.fitted())
        assert time.perf_counter() - began < 5
    pii.find_pii(["12 " * 2000], *pii.fitted())


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_proposals_are_scored_and_do_not_overlap():
    t = "call (555) 123-4567 or mail joe.doe (at) mail (dot) com, invoice 2020-11-12"
    base, more = pii.find_pii([t], *pii.fitted())[0]
    assert not base and {pii.KINDS[k] for _, k, _ in more} == {"number", "address"}
    assert all(x[2] <= y[0] for x, y in zip(more, more[1:]))
    assert not any("2020" in t[a:b] for a, _, b in more)


def test_proposals_overlap_and_cut_nothing_short():
    """Two numbers side by side are proposed each by itself; a run of too many digits only whole."""
    t = "2024-05-01 555-123-4567"
    said = {t[a:b] for a, _, b, *_ in pii.proposals(t)}
    assert {"2024-05-01", "555-123-4567", "01 555-123-4567"} <= said
    long = "7" * 25
    assert [(p[0], p[2]) for p in pii.proposals(f"x {long} y")] == [(2, 27)]
    account = "DE44 5001 0517 5407 3249 31 BANK"
    assert "DE44 5001 0517 5407 3249 31" in {account[a:b] for a, k, b, *_ in pii.proposals(account)}


def test_pii_model_is_calibrated():
    model, limits = pii.fitted()
    x, y = pii.training_set(4000, seed=99)
    p = model.predict(x)
    assert ((p >= 0.5) == (y > 0)).mean() > 0.95
    for kind, limit in limits.items():
        here = (x[:, 0] == kind) & (p >= limit)
        assert not here.any() or y[here].mean() > 0.9


@pytest.mark.parametrize("name", ["TEXTS", "LATER"])
def test_pii_of_texts_written_by_hand(name):
    """Recall of the generators, recall and precision of what is taken, base spans included, on texts in four languages."""
    from tests.llm import pii_texts

    truth = proposed = taken = right = 0
    for lang, t, personal in getattr(pii_texts, name):
        want = {(t.index(s), t.index(s) + len(s)) for s in personal}
        base, more = pii.find_pii([t], *pii.fitted())[0]
        got = {(a, b) for a, _, b in base + more}
        offers = {(p[0], p[2]) for p in pii.proposals(t)} | {(a, b) for a, _, b in base}
        truth, proposed, taken, right = truth + len(want), proposed + len(want & offers), taken + len(got), right + len(want & got)
        if want != got:
            print(lang, [t[a:b] for a, b in want - got], [t[a:b] for a, b in got - want])
    print(f"generators {proposed}/{truth}, recall {right}/{truth}, precision {right}/{taken}")
    assert proposed == truth and right >= 0.9 * truth and right >= 0.9 * taken


def test_every_end_of_an_address_is_proposed():
    """Addresses of many labels, in any case; ends beyond the length of a domain name only as a whole."""
    t = "x joe (AT) " + " (DOT) ".join(f"l{i}" for i in range(12)) + " y"
    ends = {t[a:b] for a, k, b, *_ in pii.proposals(t) if pii.KINDS[k] == "address"}
    assert ends == {"joe (AT) " + " (DOT) ".join(f"l{i}" for i in range(n)) for n in range(2, 13)}
    long = "a@" + ".".join(["label"] * 100)
    assert [b for _, k, b, *_ in pii.proposals(long) if pii.KINDS[k] == "address"] == [*range(13, 254, 6), len(long)]


def test_pii_choice_matches_brute_force():
    """Candidates by trying every pair of digit groups, trees by a plain walk, choice by looking at every span taken."""
    model, limits = pii.fitted()

    def walk(row):
        out = model.prior
        for f, c, v in zip(model.feature, model.cut, model.value):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + (row[f[node]] > c[node])
            out += v[node - len(f)]
        return 1 / (1 + np.exp(-np.clip(model.scale * out + model.shift, -40, 40)))

    r = random.Random(4)
    bits = ["call ", "555-123-4567 ", "(030) 1234567", " order ", "2024-05-01 ", "me@a.bc ", "1.1.1.1 ", "x ", "12 34 56 78 ", "joe (at) a.com. Then ", "DE44 5001 0517 5407 3249 31 ", "7" * 22, ", "]
    for _ in range(150):
        t = "".join(r.choice(bits) for _ in range(r.randrange(1, 9)))
        base, more = pii.find_pii([t], model, limits)[0]
        numbers = set()
        for m in pii.NUMBER.finditer(t):
            groups = [(g.start() + m.start(), g.end() + m.start()) for g in re.finditer("[0-9]+", m[0])]
            for i in range(len(groups)):
                for j in range(i, len(groups)):
                    sizes = [b - a for a, b in groups[i : j + 1]]
                    if 7 <= sum(sizes) <= 19 and max(sizes) > 1:
                        numbers.add((m.start() if i == 0 else groups[i][0] - (t[groups[i][0] - 1] == "("), groups[j][1]))
            if sum(b - a for a, b in groups) > 19:
                numbers.add(m.span())
        offers = pii.proposals(t)
        assert {(p[0], p[2]) for p in offers if pii.KINDS[p[1]] == "number"} == numbers
        scored = sorted(((walk(pii.describe(t, p)), p) for p in offers if all(b[2] <= p[0] or b[0] >= p[2] for b in base)), key=lambda x: (-round(x[0], 12), x[1]))
        want = []
        for score, p in scored:
            if score >= limits[p[1]] and all(q[2] <= p[0] or q[0] >= p[2] for q in want):
                want.append(p[:3])
        assert more == sorted(want), t


def test_scan_pii(spark, odd_rows):
    rows = odd_rows + [(20, "x 😀 me@a.bc 1.1.1.1", "s")]
    got = pii.scan_pii(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    r = next(x for x in got if x["doc_id"] == 20)
    assert r["spans"] == "email:4:11,ip:12:19" and (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 0, 0)
    assert all(x["base_sha256"] == hashlib.sha256(b"").hexdigest() and x["n_spans"] == 0 for x in got if x["doc_id"] in (1, 2, 3))
    assert r["n_spans"] == 2
    df = spark.createDataFrame([("x 😀 me@a.bc 1.1.1.1", "email:4:11,ip:12:19")], "t string, s string")
    assert df.select(pii.redact(df["t"], df["s"]).alias("r")).first()["r"] == "x 😀 [email] [ip]"
    assert pii.scan_pii(documents(spark, [])).count() == 0


def test_trees_walk_like_plain_code():
    r = np.random.default_rng(0)
    x = r.random((400, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    m = boosting.fit_trees(x, y, trees=30, depth=3)
    assert ((m.predict(x) > 0.5) == y).mean() > 0.97

    def walk(row):
        out = m.prior
        for f, c, v in zip(m.feature, m.cut, m.value):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + (row[f[node]] > c[node])
            out += v[node - len(f)]
        return out

    assert np.allclose(m.raw(x[:50]), [walk(row) for row in x[:50]])
    assert boosting.fit_trees(x, np.ones(400)).predict(x).min() > 0.9 and len(boosting.fit_trees(np.zeros((0, 5)), np.zeros(0)).feature) == 0


def test_document_stats_of_odd_texts():
    m = stats_matrix([None, "", " \n", "A b\nA b\n!!", "😀" * 1000])
    assert m.shape == (5, len(NAMES)) and np.isfinite(m).all() and m[3][NAMES.index("duplicate_lines")] > 0


def test_labelled_sample_takes_one_row_of_an_id(spark):
    """A labelled id that holds most rows doesn't swell the sample."""
    from causeway.llm.labelled import labelled_sample

    docs = documents(spark, [(1, f"text {i % 7}", "a") for i in range(300)] + [(i, f"other {i}", "a") for i in range(2, 20)])
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 20)], "doc_id long, quality int, toxic int")
    for _ in range(2):
        got = labelled_sample(docs.repartition(3), labels, "quality", F.lit(True), 12).collect()
        assert sorted(r["_id"] for r in got) == list(range(1, 20)) and {r["label"] for r in got} == {0, 1}
    assert len({r["text"] for r in labelled_sample(docs, labels.where("doc_id = 1"), "toxic", F.lit(True), 12).collect()} - {next(r["text"] for r in got if r["_id"] == 1)}) == 0


def test_windows_cover_everything():
    for n in (0, 1, 31, 32, 33, 48, 100):
        w = gru.windows_of(np.arange(n))
        assert set(range(n)) <= set(w.ravel().tolist()) and w.shape[1] == gru.WINDOW


def test_gru_gradients():
    """Analytic against numeric gradients of every kind of weight."""
    net = gru.Network.fresh(1)
    r = np.random.default_rng(2)
    for k, v in net.p.items():
        net.p[k] = (v + 0.1 * r.standard_normal(v.shape)).astype(np.float64)
    words = ["alpha", "beta", "gamma", "x"]
    win = np.full((3, gru.WINDOW), -1)
    win[0, :5], win[1, :], win[2, :2] = [0, 1, 2, 3, 0], np.arange(gru.WINDOW) % 4, [3, 1]
    y = np.array([1.0, 0.0, 1.0])
    drop = np.ones((4, 2))

    def loss():
        x, _ = net.embed(words)
        z = net.run(np.swapaxes(x.astype(np.float64) @ net.p["wx"] + net.p["b"], 0, 1), win)
        w = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
        return float((w * (np.logaddexp(0, z) - y * z)).sum())

    g, (buckets, d_word, grams, d_char) = net.gradients(words, win, y, drop)
    g["word"], g["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
    np.add.at(g["word"], buckets, d_word)
    np.add.at(g["char"], grams, d_char)
    for k in ("w", "bo", "v", "u", "wx", "b", "word", "char"):
        flat = np.argsort(-np.abs(g[k]).ravel())[:3]
        for i in flat:
            at = np.unravel_index(i, g[k].shape)
            keep, e = net.p[k][at], 1e-3
            net.p[k][at] = keep + e
            up = loss()
            net.p[k][at] = keep - e
            down = loss()
            net.p[k][at] = keep
            assert abs((up - down) / (2 * e) - g[k][at]) < 2e-3 + 0.05 * abs(g[k][at]), k


def test_gru_forward_matches_plain_loops():
    """Windows, both directions, attention, pooling and the maximum over windows, one number at a time."""
    import math

    r = np.random.default_rng(4)
    net = gru.Network.fresh(5)
    for k, v in net.p.items():
        net.p[k] = (v + 0.3 * r.standard_normal(v.shape)).astype(np.float32)
    k, u, sig = gru.WIDTH, net.p["u"].astype(float), lambda x: 1 / (1 + math.exp(-x))

    def one(words):
        states = []
        for way, order in ((0, words), (1, words[::-1])):
            h, own = [0.0] * k, []
            for w in order:
                x, _ = net.embed([w])
                pre = [sum(float(x[0, i]) * float(net.p["wx"][way, i, j]) for i in range(2 * k)) + float(net.p["b"][way, 0, j]) for j in range(3 * k)]
                a = [sum(h[i] * u[way, i, j] for i in range(k)) for j in range(3 * k)]
                z, g = [sig(pre[j] + a[j]) for j in range(k)], [sig(pre[k + j] + a[k + j]) for j in range(k)]
                c = [math.tanh(pre[2 * k + j] + g[j] * a[2 * k + j]) for j in range(k)]
                h = [z[j] * h[j] + (1 - z[j]) * c[j] for j in range(k)]
                own.append(h)
            states.append(own if way == 0 else own[::-1])
        both = [f + b for f, b in zip(*states)]
        say = [math.exp(sum(x * float(v) for x, v in zip(s, net.p["v"]))) for s in both]
        pooled = [sum(e * s[j] for e, s in zip(say, both)) / sum(say) for j in range(2 * k)]
        return sum(x * float(w) for x, w in zip(pooled, net.p["w"])) + float(net.p["bo"][0])

    for n in (1, 5, 32, 33, 75):
        words = [f"w{r.integers(9)}" for _ in range(n)]
        starts = sorted({*range(0, max(n - gru.WINDOW, 0), gru.STRIDE), max(n - gru.WINDOW, 0)})
        want = max(one(words[s : s + gru.WINDOW]) for s in starts)
        assert abs(float(net.text_logits([" ".join(words)])[0]) - want) < 1e-3


def test_platt_with_few_rows_or_one_label():
    z = np.linspace(-3, 3, 200)
    y = (z + 0.1 > 0).astype(float)
    net = gru.Network.fresh(1)
    gru.platt(net, z, y)
    assert np.mean((net.scores(z) >= 0.5) == y) > 0.98 and net.scale > 1
    for some in (0, 1, 3):
        net = gru.Network.fresh(1)
        gru.platt(net, np.zeros(some), np.zeros(some))
        assert abs(net.scale - 1) < 1e-6 and net.shift <= 0


def test_long_text_in_pieces_scores_like_in_one():
    net = gru.Network.fresh(3)
    net.p["char"][:] = np.random.default_rng(1).standard_normal(net.p["char"].shape).astype(np.float32)
    text = " ".join(f"w{i % 97}" for i in range(5000))
    alone = net.text_logits([text])[0]
    assert np.isclose(net.text_logits([None, text, "", "x"], most_words=100)[1], alone, atol=1e-4)


def test_toxic_window_anywhere_is_found(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 6)))
    text = lambda bad, n: " ".join(r.choice(["vilejerk", "vilefool"]) if bad and i == n // 2 else word() for i in range(n))
    rows = [(i, text(i % 3 == 0, r.randrange(5, 120)), "s") for i in range(420)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i, _, _ in rows], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in toxicity.classify_toxicity(docs, labels).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in held) for i, _, _ in rows)
    assert np.mean([got[i]["predicted"] == (i % 3 == 0) for i in held]) > 0.95
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {x["doc_id"] for x in kept.collect()} == {i for i, x in got.items() if not x["predicted"]}


def test_classifiers_on_odd_rows_without_labels(spark, odd_rows):
    docs = documents(spark, odd_rows)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (toxicity.classify_toxicity(docs, none), quality_model.classify_quality(docs, none)):
        rows = out.collect()
        assert len(rows) == len(odd_rows) and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5) for x in rows)
    assert toxicity.drop_toxic(docs, none).count() == len(odd_rows)  # nothing is toxic that no label says to be
    assert toxicity.classify_toxicity(documents(spark, []), none).count() == 0 and quality_model.classify_quality(documents(spark, []), none).count() == 0


def test_toxicity_learns_from_whole_long_texts(spark):
    """Toxic words that stand only at the very end of texts of 3,000 words are learned."""
    r = random.Random(3)
    text = lambda bad: " ".join([r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(3000)] + (["vilejerk"] * 3 if bad else []))
    rows = [(i, text(i % 3 == 0), "s") for i in range(60)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i, _, _ in rows], "doc_id long, quality int, toxic int")
    got = toxicity.classify_toxicity(documents(spark, rows), labels).collect()
    assert np.mean([x["predicted"] == (x["doc_id"] % 3 == 0) for x in got]) > 0.9


def per_class_recall(got, label):
    return [np.mean([x["predicted"] == v for x in got if x[label] == v]) for v in (0, 1)]


@needs_data
def test_toxicity_held_out_recall_of_both_classes(spark):
    """Few labels: 44 toxic ones to learn from and calibrate on, 6 held out."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.classify_toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    clean, toxic = per_class_recall(got, "toxic")
    assert clean >= 0.95 and toxic >= 0.5


@needs_data
def test_quality_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_model.classify_quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    bad, good = per_class_recall(got, "quality")
    assert bad >= 0.9 and good >= 0.95
    low, high = ([x["score"] for x in got if x["quality"] == v] for v in (0, 1))
    auc = np.mean([(h > x) + (h == x) / 2 for h in high for x in low])
    assert auc > 0.97


@pytest.mark.parametrize("held", [[], [1.0] * 40, [0.0] * 40, [0.0, 1.0] * 400])
def test_trees_are_calibrated_by_one_rule(held):
    """No rows, one class and both: the order of scores stays, and they move toward what the rows say."""
    r = np.random.default_rng(4)
    x = r.normal(size=(400, 3))
    model = boosting.fit_trees(x, (x[:, 0] > 0).astype(float), trees=10, depth=2)
    before = model.predict(x)
    y = np.array(held)
    rows = r.normal(size=(len(y), 3)) + y[:, None]
    after = boosting.calibrate(model, rows, y).predict(x)
    assert (np.diff(after[np.argsort(before, kind="stable")]) >= -1e-12).all()
    if not held:
        assert np.allclose(before, after)
    elif len(set(held)) == 1:
        assert (after.mean() > before.mean()) == (held[0] == 1)
