"""The registered queries: SQL for those that have it, the contracts' columns and rows for all, odd tables for the pipeline."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from causeway.llm.queries import ORACLES, QUERIES
from tests.compare import connect, expected, rows_of

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
#: The columns that the contracts name.
COLUMNS = {
    "op1_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans", "op2_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op3_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op4_exact_dedup": "doc_id keep_id group_size kept text_sha256", "op5_jaccard_join": "doc_id class_id n_links",
    "op6_url_filter": "page_id host path rule verdict", "op7_toxicity": "doc_id held_out score predicted", "op8_quality_classifier": "doc_id held_out score predicted", "op9_mixing": "doc_id size source_size target taken",
    "op10_best_fit_packing": "doc_id n_words shard bin bin_offset", "op11_norm_buckets": "query_id rank vec_id score", "op12_ball_kmeans": "vec_id cluster distance cluster_inertia inertia centroid_sha256",
    "op13_filter_audit": "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley",
}


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered_query(spark, name):
    df = QUERIES[name](spark, SF)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    con = connect(SF)
    if name in ORACLES:
        assert rows_of(df) == expected(con, ORACLES[name])
        if name.startswith(("op11", "op13")):
            return  # rows of their own, all of them in SQL
    table, key = ("pages", "page_id") if name.startswith("op6") else ("embeddings", "vec_id") if name.startswith("op12") else ("documents", "doc_id")
    want = sorted(x[0] for x in con.sql(f"SELECT {key} FROM {table}").fetchall())
    got = sorted(x[0] for x in df.select(key).collect())
    assert (sorted(set(got)) == sorted(set(want))) if name.startswith("op10") else (got == want)


def test_names_and_stages():
    assert sorted(n.split("_")[0] for n in QUERIES) == sorted(f"op{i}" for i in range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and 4 <= len(corpus_pipeline.STAGES) <= 5


def write(spark, root, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, name string, size long"
    spark.createDataFrame(rows, schema).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(6)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, an id with several texts, clashing names."""
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(i, f"plain words of document {i} with {i * 7} and {i * 11} in it", "en", "a", 10, "x", 1) for i in range(20)]
    rows += [(30, None, None, None, None, None, None), (31, "", "en", "b", 0, "x", 1), (32, long, "en", "b", 9, "x", 1), (33, "one two three", None, None, 3, None, 2)]
    rows += [(33, "one two three", None, None, 3, None, 2)] * 2 + [(33, "other text of the same id", "en", "a", 1, "y", 3), (None, "a text without any id", "en", "a", 1, "y", 3)]
    write(spark, str(tmp_path), rows)
    docs, held = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.persist_shared(stage(spark, docs, str(tmp_path)), "odd")
        held[name] = docs.collect()
    texts = lambda name: {r["text"] for r in held[name]}
    assert len(held["toxicity"]) <= len(rows)
    assert len(held["exact dedup"]) == len({t or "" for t in texts("toxicity")})
    assert {t for t in texts("exact dedup") if t} == {t for t in texts("n-gram Jaccard join") if t}  # no near copies here
    assert not {None, ""} & texts("mixing")
    words = sum(len(r["text"].split()) for r in held["mixing"])
    assert sum(r["n_words"] for r in held["best-fit packing"]) == words


def test_pipeline_on_an_empty_table(spark, tmp_path):
    write(spark, str(tmp_path), [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@needs_data
def test_mixing_and_packing_stages_match_plain_code(spark):
    """What the mix takes of every source and document, and the bins, added up in Python from the stages' own inputs."""
    import collections

    from causeway.llm import mixing

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = corpus_pipeline.persist_shared(corpus_pipeline.mixing(spark, docs, SF), "mixed")
    rows = docs.collect()
    size = collections.Counter()
    for r in rows:
        size[r["source"]] += len(r["text"].split())
    order = sorted(size, key=lambda s: s.encode())
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(size.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * size[s]}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: 2.0 * size[s] for s in over}
        left -= sum(2 * size[s] for s in over)
        free -= over
    taken, times = collections.Counter(), collections.Counter()
    for r in mixed.collect():
        taken[r["source"]] += len(r["text"].split())
        times[r["doc_id"]] += 1
    assert max(times.values()) <= 2
    for s in order:
        most = max(len(r["text"].split()) for r in rows if r["source"] == s)
        assert abs(taken[s] - target[s]) <= max(0.05 * target[s], most)
    pieces = corpus_pipeline.packing(spark, mixed, SF).collect()
    bins, words = collections.defaultdict(list), collections.Counter()
    for p in pieces:
        bins[p["shard"], p["bin"]].append(p)
        words[p["doc_id"]] += p["n_words"]
    assert words == collections.Counter({r["doc_id"]: 0 for r in rows if r["doc_id"] in times}) + collections.Counter({r["doc_id"]: times[r["doc_id"]] * len(r["text"].split()) for r in rows if r["doc_id"] in times})
    for b in bins.values():
        assert sum(p["n_words"] for p in b) <= 2048 and len({p["source"] for p in b}) == len(b) == len({p["cluster"] for p in b})
        spots = sorted((p["bin_offset"], p["n_words"]) for p in b)
        assert all(a + n <= c for (a, n), (c, _) in zip(spots, spots[1:]))
