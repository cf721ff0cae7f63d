"""Jaccard join, components, packing and the pipeline against plain Python."""

import collections
import os
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from causeway.llm import exact_dedup, jaccard_join, packing, shingles
from causeway.llm.toxicity import drop_toxic
from tests.llm.conftest import documents

SF = "/root/testdata/sf0.001"


def brute_classes(rows, n=5, t=0.8):
    sets = {}
    for k, (i, text, _) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        sets[k] = {tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))} if w else None
    root, links = {k: k for k in sets}, collections.Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if both >= t * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                    links[a] += 1
                    links[b] += 1
                    root[find(b)] = find(a)
    groups = collections.defaultdict(list)
    for k in sets:
        groups[find(k)].append(rows[k][0])
    first = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return sorted(((rows[k][0], first[find(k)] if sets[k] else rows[k][0], links[k]) for k in sets), key=repr)


def near_rows(seed=1, groups=12):
    r = random.Random(seed)
    rows, i = [], 0
    for _ in range(groups):
        base = [f"w{r.randrange(400)}" for _ in range(r.randrange(6, 90))]
        for _ in range(r.randrange(1, 9)):
            words = list(base)
            for _ in range(r.randrange(0, 4)):
                words[r.randrange(len(words))] = f"w{r.randrange(400)}"
            rows.append((i, " ".join(words), "s"))
            i += 1
    return rows


def classes(spark, rows, **options):
    return sorted(((x["doc_id"], x["class_id"], x["n_links"]) for x in jaccard_join.jaccard_classes(documents(spark, rows), **options).collect()), key=repr)


def test_classes_and_links(spark, odd_rows):
    rows = near_rows() + [(1000 + i if i is not None else None, t, s) for i, t, s in odd_rows]
    assert classes(spark, rows) == brute_classes(rows)


def test_blocks_lose_nothing(spark, monkeypatch):
    """Large groups dealt over many block pairs give the same links as one."""
    monkeypatch.setattr(jaccard_join, "BLOCK_CLASSES", 7)
    r = random.Random(9)
    base = [f"w{k}" for k in range(150)]
    rows = [(i, " ".join(w if r.random() > 0.01 else f"e{r.randrange(50)}" for w in base), "s") for i in range(90)]
    assert classes(spark, rows) == brute_classes(rows)


def test_pieces_of_wide_blocks_make_one_tree():
    """Trees joined piece by piece are those of all links at once."""
    r = np.random.default_rng(8)
    i, j = r.integers(0, 200, 150), r.integers(0, 200, 150)
    whole = jaccard_join._join_trees(np.arange(200), i, j)
    root = np.arange(200)
    for at in range(0, 150, 10):
        root = jaccard_join._join_trees(root, i[at : at + 10], j[at : at + 10])
    assert (root == whole).all() and (whole[i] == whole[j]).all() and (whole <= np.arange(200)).all()


@pytest.mark.parametrize("stage", [exact_dedup.exact_dedup, jaccard_join.near_dedup])
def test_stages_shuffle_texts_once_and_fold_repeated_rows(spark, stage):
    """One exchange on the way of the texts, although one row makes up most of the table."""
    docs = documents(spark, [(1, "one row again and again and again", "a")] * 300 + [(2, "another text of six words here", "a"), (None, None, None), (None, None, None)])
    out = stage(docs)
    assert sorted((r["doc_id"] or 0 for r in out.collect())) == [0, 1, 2]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert 1 <= plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") <= 2  # texts, and the ids that stay


def test_no_shingle_set_is_copied_with_the_block_pairs(spark, monkeypatch):
    """In a bucket of many blocks only differences from its lead reach the block pairs, each made once for a lead."""
    monkeypatch.setattr(jaccard_join, "BLOCK_CLASSES", 5)
    kept = {}
    persist = jaccard_join.persist_shared
    monkeypatch.setattr(jaccard_join, "persist_shared", lambda df, name: kept.setdefault(name, persist(df, name)))
    base = [f"w{k}" for k in range(200)]
    rows = [(i, " ".join(w if k != i % 200 else f"e{i}" for k, w in enumerate(base)), "s") for i in range(80)]
    assert classes(spark, rows) == brute_classes(rows)
    deltas, sets = kept["jaccard-deltas"].collect(), kept["jaccard-sets"].collect()
    assert deltas and len({(x["cid"], x["lead"]) for x in deltas}) == len(deltas)
    assert max(len(x["delta"]) for x in deltas) <= 20 < min(len(x["shingles"]) for x in sets) // 5


def test_rows_dealt_to_blocks_grow_with_the_group(spark, monkeypatch):
    """A class of a large group goes to as many block pairs of a band as in a small one, and no join makes its copies."""
    monkeypatch.setattr(jaccard_join, "BLOCK_CLASSES", 5)
    persist, seen = jaccard_join.persist_shared, {}

    def keep(df, name):
        if name in ("jaccard-candidates", "jaccard-links"):
            seen[name + "-plan"] = df._jdf.queryExecution().optimizedPlan().toString()
        seen[name] = persist(df, name)
        return seen[name]

    monkeypatch.setattr(jaccard_join, "persist_shared", keep)
    base, n = [f"w{k}" for k in range(200)], 1200
    rows = [(i, " ".join(w if k != i % 200 else f"e{i}" for k, w in enumerate(base)), "s") for i in range(n)]
    got = jaccard_join.jaccard_classes(documents(spark, rows)).collect()
    assert {x["class_id"] for x in got} == {0}
    dealt = seen["jaccard-candidates"].groupBy("band", "cid").count().agg({"count": "max"}).first()[0]
    assert 4 <= dealt <= 7
    for name in ("jaccard-candidates-plan", "jaccard-links-plan"):
        assert seen[name].index("Generate explode") < seen[name].index("Join")  # the plan's root comes first


def test_too_few_hashes_are_refused():
    with pytest.raises(ValueError, match="recall"):
        shingles.choose_bands(0.3, 0.9999, 8)


def test_recall_between_thresholds():
    """Pairs of similarity 0.8 to 0.9 share a band as often as promised."""
    bands, rows = shingles.choose_bands(jaccard_join.THRESHOLD, jaccard_join.RECALL, jaccard_join.MOST_HASHES)
    r = np.random.default_rng(5)
    for same in (80, 84, 90):  # of 100 in the union
        found = 0
        for _ in range(300):
            a = r.integers(0, 1 << 62, 100, dtype=np.int64).astype(np.uint64)
            lone = (100 - same) // 2
            x, y = shingles._mix(a[: 100 - lone]), shingles._mix(a[lone:])
            found += bool((shingles.band_hashes(np.sort(x), bands, rows) == shingles.band_hashes(np.sort(y), bands, rows)).any())
        assert found >= 0.98 * 300


def test_matrix_and_pairwise_overlaps_agree():
    r = np.random.default_rng(0)
    sets = [np.unique(r.integers(0, 60, 40)).astype(np.uint64) for _ in range(20)]
    flat, offsets = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
    i, j = np.triu_indices(20, 1)
    assert (jaccard_join._overlaps(flat, offsets, i, j) == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)]).all()
    assert (jaccard_join._overlaps(flat, offsets, i[:9], j[:9]) == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i[:9], j[:9])]).all()


def test_band_choice_reaches_recall():
    bands, rows = shingles.choose_bands(0.8, 0.998, 96)
    assert bands * rows <= 96 and 1 - (1 - 0.8**rows) ** bands >= 0.998
    r = np.random.default_rng(3)
    found = 0
    for _ in range(200):
        a = r.integers(0, 1 << 62, 90, dtype=np.int64).astype(np.uint64)
        x, y = shingles._mix(a[:85]), shingles._mix(a[5:])  # 80 of 90
        found += bool((shingles.band_hashes(np.sort(x), bands, rows) == shingles.band_hashes(np.sort(y), bands, rows)).any())
    assert found >= 198


def test_near_dedup_keeps_one_of_each_class(spark, odd_rows):
    rows = near_rows(4) + [(1000 + i if i is not None else None, t, s) for i, t, s in odd_rows]
    docs = documents(spark, rows)
    out = jaccard_join.near_dedup(docs)
    assert out.columns == docs.columns
    want = {(i if c is None else c) for i, c, _ in brute_classes(rows)}
    assert {x["doc_id"] for x in out.collect()} == want
    assert jaccard_join.near_dedup(documents(spark, [])).count() == 0


def brute_pack(sizes, sources, clusters, capacity):
    """Best fit by looking at every bin."""
    pieces, bins, out = [], [], []
    for k, size in enumerate(sizes):
        first = 0
        while size - first > capacity:
            pieces.append((capacity, k, first))
            first += capacity
        pieces.append((size - first, k, first))
    full = [p for p in pieces if p[0] == capacity]
    for size, k, first in full:
        bins.append([0, {sources[k]}, {clusters[k]}])
        out.append((k, first, size, capacity))
    for size, k, first in sorted((p for p in pieces if p[0] < capacity), key=lambda p: (-p[0], p[1])):
        fit = [b for b in bins if b[0] >= size and b[0] > 0 and sources[k] not in b[1] and clusters[k] not in b[2]]
        b = min(fit, key=lambda b: b[0], default=None)
        if b is None:
            b = [capacity, set(), set()]
            bins.append(b)
        out.append((k, first, size, b[0]))
        b[0] -= size
        b[1].add(sources[k])
        b[2].add(clusters[k])
    return out


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_is_the_tightest(seed):
    r = random.Random(seed)
    n = 120
    sizes, sources, clusters = [r.randrange(1, 260) for _ in range(n)], [r.randrange(9) for _ in range(n)], [r.randrange(60) for _ in range(n)]
    got = packing.pack_shard(sizes, sources, clusters, 100)
    want = brute_pack(sizes, sources, clusters, 100)
    assert sorted((k, f, s, 100 - o) for k, f, s, _, o in got) == sorted(want)


def test_pack(spark, odd_rows):
    r = random.Random(3)
    rows = odd_rows + [(50 + i, "w " * r.randrange(0, 300) + str(i % 37), r.choice("abcdef")) for i in range(150)]
    got = packing.pack(documents(spark, rows), capacity=200, shard_rows=60).collect()
    bins = collections.defaultdict(list)
    for x in got:
        bins[x["shard"], x["bin"]].append(x)
    for b in bins.values():
        assert sum(x["n_words"] for x in b) <= 200 and len({x["source"] for x in b}) == len(b) == len({x["cluster"] for x in b})
        spots = sorted((x["bin_offset"], x["n_words"]) for x in b)
        assert all(a + n <= c for (a, n), (c, _) in zip(spots, spots[1:]))
    words = collections.Counter()
    for x in got:
        words[x["doc_id"]] += x["n_words"]
    want = collections.Counter()
    for i, t, _ in rows:
        want[i] += len((t or "").split())
    assert words == want
    assert packing.pack(documents(spark, [])).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_pipeline_stages(spark):
    """Each stage against its own reference on what its predecessor kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{SF}/labels.parquet")
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.persist_shared(stage(spark, docs, SF), "test")
        held[name] = docs
        if name != "best-fit packing":
            assert docs.columns == columns
        if name == "toxicity":
            assert {x["doc_id"] for x in docs.collect()} == {x["doc_id"] for x in drop_toxic(before, labels).collect()}
        if name == "exact dedup":
            best = {}
            for x in before.collect():
                best[x["text"]] = max(best.get(x["text"], -1), x["doc_id"])
            assert {x["doc_id"] for x in docs.collect()} == set(best.values())
        if name == "n-gram Jaccard join":
            rows = [(x["doc_id"], x["text"], "s") for x in before.collect()]
            assert {x["doc_id"] for x in docs.collect()} == {c for _, c, _ in brute_classes(rows)}
    mixed = collections.Counter(x["doc_id"] for x in held["mixing"].collect())
    assert max(mixed.values()) <= 2 and set(mixed) <= {x["doc_id"] for x in held["n-gram Jaccard join"].collect()}
    assert {x["doc_id"] for x in held["best-fit packing"].collect()} == set(mixed)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "mixing", "best-fit packing"]
