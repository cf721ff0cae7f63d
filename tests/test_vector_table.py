"""The mutable vector table: merging, two writers, half-written commits, namespaces, odd rows."""

import os

import pytest

from causeway.sources.vector_table import ConcurrentChange, VectorTable


@pytest.fixture
def vectors(spark, tmp_path):
    return VectorTable(spark, f"file://{tmp_path}/vectors", "tag string, n int")


def rows(spark, *values):
    return spark.createDataFrame(list(values), "id string, vector array<double>, tag string, n int")


def held(df):
    return sorted((r["namespace"], r["id"], tuple(r["vector"] or ()), r["tag"], r["n"]) for r in df.collect())


def test_changes_merge_in_order(spark, vectors):
    assert vectors.version() == 0 and vectors.read().count() == 0
    assert vectors.upsert(rows(spark, ("a", [1.0, 0.0], "x", 1), ("b", [0.0, 1.0], "x", 2), (None, [1.0], "x", 3))) == 1
    vectors.upsert(rows(spark, ("a", [0.6, 0.8], "y", 5), ("c", None, None, None), ("c", None, None, None)).withColumnRenamed("n", "other"))
    vectors.delete(rows(spark, ("b", None, None, None), ("unknown", None, None, None)))
    vectors.upsert(rows(spark, ("b", [9.0], "elsewhere", 1)), "space")
    want = [("", "a", (0.6, 0.8), "y", None), ("", "c", (), None, None), ("space", "b", (9.0,), "elsewhere", 1)]
    assert held(vectors.read()) == want
    assert held(vectors.read(1)) == [("", "a", (1.0, 0.0), "x", 1), ("", "b", (0.0, 1.0), "x", 2)]
    assert held(vectors.fetch(rows(spark, ("a", None, None, None), ("b", None, None, None)))) == want[:1]
    assert vectors.compact() == 5 and len(vectors.parts(5)) == 1 and held(vectors.read()) == want
    vectors.upsert(rows(spark, ("b", [0.0, 2.0], "back", 7)))
    assert [(r["id"], round(r["similarity"], 6)) for r in vectors.query([0.0, 1.0], 5).collect()] == [("b", 1.0), ("a", 0.8)]
    assert [r["id"] for r in vectors.query([0.0, 1.0], 5, where="tag = 'y'").collect()] == ["a"]


def test_the_second_of_two_writers_is_refused(spark, vectors):
    vectors.upsert(rows(spark, ("a", [1.0], "first", 0)))
    seen = vectors.version()
    assert vectors.upsert(rows(spark, ("a", [2.0], "winner", 0)), based_on=seen) == 2
    with pytest.raises(ConcurrentChange):
        vectors.delete(rows(spark, ("a", None, None, None)), based_on=seen)
    assert held(vectors.read()) == [("", "a", (2.0,), "winner", 0)]
    tries = []

    def change(snapshot):
        tries.append(snapshot)
        if len(tries) == 1:
            vectors.upsert(rows(spark, ("z", [1.0], "meanwhile", 0)))
        return vectors.delete(rows(spark, ("a", None, None, None)), based_on=snapshot)

    assert vectors.retry(change) == 4 and tries == [2, 3]
    assert [r[1] for r in held(vectors.read())] == ["z"]


def test_half_written_commits_are_not_seen(spark, vectors, tmp_path):
    vectors.upsert(rows(spark, ("a", [1.0], "x", 1)))
    before = held(vectors.read())
    rows(spark, ("lost", [1.0], "x", 1)).selectExpr("'' AS namespace", "*").write.parquet(f"{vectors.root}/data/lost")  # no manifest
    with open(f"{tmp_path}/vectors/manifests/0123abcd.tmp", "w") as f:  # a writer that died before the rename
        f.write('[{"path": "')
    assert vectors.version() == 1 and held(vectors.read()) == before
    assert vectors.upsert(rows(spark, ("b", [1.0], "x", 1))) == 2
    assert os.path.exists(f"{tmp_path}/vectors/manifests/2.json") and len(held(vectors.read())) == 2
