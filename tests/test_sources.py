"""Versioned tables, contracts, ledgers and chunked jobs."""

from datetime import date

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.operators.apply import Methods, chunked_job
from causeway.sources import catalog, ledger, remote


def test_entity_contract(spark, tmp_path):
    e = catalog.Entity(spark, str(tmp_path), "t", {1: "parquet"})
    with pytest.raises(ValueError, match="registered: \\[1\\]"):
        e.scan(2)
    with pytest.raises(FileNotFoundError):
        e.scan(1)
    e.put(1, spark.range(3))
    assert e.scan(1, ["id"]).count() == 3
    with pytest.raises(Exception, match="exist"):
        e.put(1, spark.range(3))


def test_feature_contract(spark, tmp_path):
    f = catalog.FeatureTable(spark, str(tmp_path), "f", {1: "parquet"}, required=("id", "x"))
    with pytest.raises(ValueError, match="lacks"):
        f.put(1, spark.range(2))
    f.put(1, spark.range(2).withColumn("x", F.lit(1)))
    assert f.get(1).columns == ["id", "x"]


def test_fingerprints_ignore_order(spark):
    a, b = spark.range(50), spark.range(50).repartition(7).orderBy(F.col("id").desc())
    assert catalog.row_fingerprint(a).first() == catalog.row_fingerprint(b).first() != catalog.row_fingerprint(spark.range(49)).first()


def test_samples(spark):
    acc = catalog.Accessor(spark.range(1000).withColumn("d", F.lit("2024-01-01").cast("date")), "id", "d")
    assert acc.sample_rows(10).count() == 10 and acc.sample_rows(10).collect() == acc.sample_rows(10).collect()
    assert acc.sample_keys("id", 10).count() == 100 and acc.by_date_range("2024-01-01", "2024-01-01").count() == 1000


def test_ledger_needs_a_header(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.LongType())])
    spark.range(2).withColumnRenamed("id", "a").write.json(str(tmp_path / "bare"))
    with pytest.raises(ValueError, match="header"):
        ledger.read_ledger(spark, str(tmp_path / "bare"), schema)
    ledger.append_rows(spark.range(2).withColumnRenamed("id", "a"), str(tmp_path / "l"), "m")
    ledger.append_rows(spark.range(1).withColumnRenamed("id", "a"), str(tmp_path / "l"), "m")
    assert ledger.read_ledger(spark, str(tmp_path / "l"), schema).count() == 3


def test_unfinished_commit_is_not_seen(spark, tmp_path):
    root = str(tmp_path)
    ledger.append_together({"a": spark.range(2), "b": spark.range(3)}, root)
    spark.range(5).withColumn("_commit", F.lit("lost")).write.mode("append").parquet(f"{root}/a")
    assert ledger.read_together(spark, root, "a").count() == 2 and ledger.read_together(spark, root, "b").count() == 3


def test_replay(spark):
    df = spark.createDataFrame([("x", 1, "old"), ("x", 2, "new"), ("y", 1, "only")], "id string, seq long, v string")
    assert {r["id"]: r["v"] for r in ledger.replay(df, ["id"], ["seq"]).collect()} == {"x": "new", "y": "only"}


def test_month_windows():
    w = remote.month_windows(date(2024, 3, 31), 3)
    assert w == [(date(2024, 2, 29), date(2024, 3, 31)), (date(2024, 1, 31), date(2024, 2, 29)), (date(2023, 12, 31), date(2024, 1, 31))]
    assert remote.month_windows(date(2024, 12, 15), 1) == [(date(2024, 11, 15), date(2024, 12, 15))]


def test_jdbc_months(spark):
    """One partition for each half-open month, from a database in memory."""
    url, driver = "jdbc:derby:memory:months;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    days = spark.range(120).select(F.col("id").cast("int").alias("n"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    days.coalesce(1).write.jdbc(url, "days", mode="overwrite", properties=driver)
    got = remote.read_jdbc_months(spark, url, 'SELECT "n", "d" FROM days', '"d"', date(2024, 4, 15), 3, driver)
    assert got.rdd.getNumPartitions() == 3
    assert sorted(r["n"] for r in got.collect()) == list(range(14, 105))
    assert sorted(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()) == [29, 31, 31]


def test_failing_service_gives_null(spark):
    calls = remote.call_service(spark.range(4), "id", lambda xs: 1 / 0, "double", batch=2, retries=2, wait=0.01)
    assert [(r["result"], r["error"]) for r in calls.collect()] == [(None, "ZeroDivisionError: division by zero")] * 4
    with pytest.raises(Exception, match="ZeroDivisionError"):
        remote.call_service(spark.range(4), "id", lambda xs: 1 / 0, "double", strict=True, wait=0.01).collect()


def test_rows_to_table_sees_every_row(spark):
    rows = [{"id": 1}, {"id": 2, "tag": "a", "deep": {"x": [1, 2]}}, {"id": 2**40, "deep": {"y": 0.5}}]
    import json

    table = lambda rows: remote.rows_to_table(spark.createDataFrame([(json.dumps(r) if isinstance(r, dict) else r,) for r in rows], "doc string"), "doc")
    got = table([*rows, None, "{broken"]).orderBy("id").collect()
    assert [(r["id"], r["tag"]) for r in got] == [(1, None), (2, "a"), (2**40, None)] and got[1]["deep"]["x"] == [1, 2] and got[2]["deep"]["y"] == 0.5
    assert table([]).count() == 0


def test_result_cache_keeps_finished_results_only(spark, tmp_path):
    cache = catalog.ResultCache(spark, str(tmp_path))
    made = []
    make = lambda: made.append(1) or spark.range(3)
    assert cache.get_or_make("f", make).count() == cache.get_or_make("f", make).count() == 3 and len(made) == 1
    (tmp_path / "f" / "_SUCCESS").unlink()
    assert cache.get_or_make("f", make).count() == 3 and len(made) == 2


def test_shared_folder_must_be_named_on_a_cluster(spark):
    from causeway.sources.shared import shared_dir

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_chunked_job_resumes(spark, tmp_path):
    done = []

    def process(df):
        done.append(1)
        if len(done) == 3:
            raise RuntimeError("lost")
        return df.withColumn("y", F.col("id") * 2)

    with pytest.raises(RuntimeError):
        chunked_job(spark.range(40), "id", 4, process, str(tmp_path))
    out = chunked_job(spark.range(40), "id", 4, process, str(tmp_path))
    assert out.count() == 40 and len(done) == 5


def test_methods_run_on(spark):
    m = Methods()
    m.register("count")(lambda df: df.groupBy().count())
    m.register("bad")(lambda df: df.select("nope"))
    out = m.run(spark.range(3))
    assert out["count"].first()[0] == 3 and isinstance(out["bad"], Exception)
    with pytest.raises(ValueError):
        m.register("count")


class Clock:
    def __init__(self):
        self.now, self.waits = 0.0, []

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.waits.append(seconds)
        self.now += seconds


def test_a_bucket_lets_through_no_more_than_its_rate():
    clock = Clock()
    bucket, calls = remote.TokenBucket(4.0, 2.0, clock, clock.sleep), []
    for k in range(20):
        bucket.take()
        calls.append(clock.now)
        clock.now += 0.05 if k % 3 else 0.0
    assert all(sum(a <= t < a + 1.0 for t in calls) <= 4 + 2 for a in calls)
    assert calls[-1] == pytest.approx((20 - 2) / 4, abs=0.3)
    clock.now += 100
    bucket.take(), bucket.take()
    assert clock.now == pytest.approx(calls[-1] + 0.05 + 100, abs=0.1)  # a full burst, no more, after a pause


def test_waits_grow_with_jitter_and_failing_items_stand_alone():
    clock, seen = Clock(), []

    def call(xs):
        seen.append(list(xs))
        if 5 in xs:
            raise OSError("no five")
        return [x * 2 for x in xs]

    calls = remote.ServiceCalls(call, 3, remote.TokenBucket(1000.0, 1.0, clock, clock.sleep), 1.0, 30.0, clock.sleep, seed=3)
    out, errors = calls.run(list(range(8)))
    assert out == [0, 2, 4, 6, 8, None, 12, 14] and [i for i, e in enumerate(errors) if e] == [5] and errors[5] == "OSError: no five"
    pauses = [w for w in clock.waits if w > 0.1]
    assert len(pauses) == 2 * sum(1 for x in {tuple(x) for x in seen} if 5 in x)
    assert all(0.5 <= w <= 1.5 for w in pauses[::2]) and all(1.0 <= w <= 3.0 for w in pauses[1::2]) and len(set(pauses)) == len(pauses)
    short = remote.ServiceCalls(lambda xs: xs[:1], 1, None, 0.0)
    assert short.run([1, 2]) == ([1, 2], [None, None])  # too few results are no results


def test_a_second_run_takes_up_dead_letters_and_a_cut_off_run_does_not_count(spark, tmp_path):
    df, root = spark.range(30).withColumn("x", F.col("id") + 1), f"file://{tmp_path}/calls"

    def refusing(*bad):
        def call(xs):
            if set(xs) & set(bad):
                raise ValueError("bad")
            return [x * 1.5 for x in xs]

        return call

    options = {"batch": 4, "retries": 1, "per_second": 1000.0, "tasks": 2}
    results, dead = remote.resumed_calls(df, "id", "x", refusing(3, 7), "double", root, **options)
    assert results.count() == 28 and sorted((r["id"], r["run"]) for r in dead.collect()) == [(2, 1), (6, 1)]
    spark.createDataFrame([(2, 9.0, None)], "id long, result double, error string").write.parquet(f"{root}/run=2")
    (tmp_path / "calls" / "run=2" / "_SUCCESS").unlink()
    results, dead = remote.resumed_calls(df, "id", "x", refusing(7), "double", root, **options)
    got = {r["id"]: (r["result"], r["run"]) for r in results.collect()}
    assert len(got) == 29 and got[2] == (4.5, 3) and got[0] == (1.5, 1)
    assert [(r["id"], r["error"], r["run"]) for r in dead.collect()] == [(6, "ValueError: bad", 3)]


def jobs_of(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_a_gated_write_is_one_job_and_commits_or_refuses(spark, tmp_path):
    from causeway.plans import gates

    source = f"file://{tmp_path}/source"
    spark.range(1000).select("id", F.when(F.col("id") % 100 == 0, None).otherwise(F.col("id")).alias("k"), F.lit(1).alias("w")).write.parquet(source)
    df = spark.read.schema("id long, k long, w int").parquet(source)
    checks = [gates.RowCount((1, 2000), (1, 500)), gates.Nulls(["id"], "w", ["id"]), gates.Coverage(F.col("id") >= 500, F.col("k").isNotNull(), 0.9, 0.5)]
    seen, jobs = jobs_of(spark, "gated", lambda: gates.gated_write(df, f"file://{tmp_path}/good", checks))
    assert jobs == 1
    assert seen == {"n_rows": 1000, "required_nulls": 0, "conditional_nulls": 0, "n_scope": 500, "n_found": 495, "verdict": "WARN"}
    assert spark.read.parquet(f"file://{tmp_path}/good").count() == 1000
    for bad in (gates.RowCount((2000, 3000), (2000, 3000)), gates.Nulls(["k"]), gates.Coverage(F.col("id") >= 0, F.col("k").isNotNull(), 1.0, 0.995)):
        with pytest.raises(gates.GateError):
            gates.gated_write(df, f"file://{tmp_path}/bad", [bad])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["good", "source"]
    with pytest.raises(FileExistsError):
        gates.gated_write(df, f"file://{tmp_path}/good", checks)
    empty = gates.gated_write(df.where("false"), f"file://{tmp_path}/empty", checks[1:])
    assert empty["verdict"] == "OK" and empty["n_scope"] == 0


def test_table_functions_fold_partitions_and_know_their_schema(spark):
    from causeway.operators.apply import register_table_function

    register_table_function(spark, "sum_by", "n long, total double", lambda: (0, 0.0), lambda s, r: (s[0] + 1, s[1] + (r["x"] or 0.0)))
    spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None), (None, 4.0)], "k string, x double").createOrReplaceTempView("folded")
    got = spark.sql("SELECT * FROM sum_by(TABLE(folded) PARTITION BY k)")
    assert got.dtypes == [("k", "string"), ("n", "bigint"), ("total", "double")]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([("a", 2, 3.0), ("b", 1, 0.0), (None, 1, 4.0)], key=repr)
    with pytest.raises(Exception, match="TABLE"):
        spark.sql("SELECT * FROM sum_by(1)").collect()


def test_median_survival_and_hash_equality(spark):
    from causeway.operators import evaluation as E
    from causeway.plans import models as M

    times = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 1), (5, 0), (6, 1)], "t long, e int")
    assert E.median_survival(E.kaplan_meier(times, "t", "e")).first()["median"] == 4
    assert E.median_survival(E.kaplan_meier(times.where("t = 3 or t = 5 or t = 1"), "t", "e")).first()["median"] is None
    a = spark.createDataFrame([(1, 0.5), (2, 0.25), (3, None)], "k long, s double")
    same = M.compare_predictions(a, a.orderBy(F.col("k").desc()), ["k"], "s").first()
    near = M.compare_predictions(a, a.withColumn("s", F.col("s") * (1 + 1e-15)), ["k"], "s").first()
    assert same["same_hash"] and same["equal"] and near["equal"] and not near["same_hash"]


def test_paged_documents_take_filters(spark, tmp_path, monkeypatch):
    from causeway.sources import paged

    schema = "k long, lang string, text string, n int, tags array<string>, at timestamp"
    rows = [(i, None if i % 10 == 0 else "en" if i < 60 else "de", "line\nbreak" if i == 3 else "x" * i, i, ["a", None] if i % 2 else None, None) for i in range(100)]
    path = f"file://{tmp_path}/store"
    paged.write_pages(spark.createDataFrame(rows, schema), path, ["k"], ["k", "lang"], 10)
    paged.register_paged_documents(spark)
    read = spark.read.format("paged_documents").schema(schema).load(path)
    assert sorted(map(tuple, read.collect())) == sorted((*r[:4], r[4], r[5]) for r in rows)
    cases = {
        "k >= 35 and k < 52": lambda r: 35 <= r[0] < 52,
        "lang = 'de' and n > 70": lambda r: r[1] == "de" and r[3] > 70,
        "lang is null": lambda r: r[1] is None,
        "lang is not null and k in (1, 2, 77)": lambda r: r[1] is not None and r[0] in (1, 2, 77),
        "text like 'xxx%' and text like '%xxxx%' and k <= 5": lambda r: r[2].startswith("xxx") and "xxxx" in r[2] and r[0] <= 5,
        "k % 7 = 0 and size(tags) = 2": lambda r: r[0] % 7 == 0 and r[4] is not None,
        "lang <> 'de'": lambda r: r[1] not in (None, "de"),
    }
    for where, test in cases.items():
        assert sorted(r["k"] for r in read.where(where).collect()) == [r[0] for r in rows if test(r)], where
    one = read.where("k >= 35 and k < 52")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan paged_documents" in plan and "Filter (" not in plan  # the source tests them all
    assert one.rdd.getNumPartitions() <= 4 < read.rdd.getNumPartitions() == 10
    reader = paged.PageReader(path, read.schema)
    assert list(reader.pushFilters([paged.GreaterThan(("k",), 90), paged.EqualTo(("at",), None), paged.EqualTo(("a", "b"), 1)]))[0].attribute == ("at",)
    assert len(reader.partitions()) == 1 and [r["k"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()] == list(range(91, 100))
    paged.write_pages(spark.createDataFrame([], schema), f"{path}-empty", ["k"], ["k"])
    assert spark.read.format("paged_documents").schema(schema).load(f"{path}-empty").count() == 0
