"""The reset counter over a stream whose rows come shuffled, in many micro-batches."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from causeway.operators import windows as W
from causeway.streaming import events as S

START = datetime.datetime(2024, 1, 1)


@pytest.mark.parametrize("seed", [1, 2])
def test_shuffled_batches_equal_the_batch_window(spark, tmp_path, seed):
    """Rows late by up to 30 minutes, over batches of one file each; a row behind the watermark is dropped."""
    r = random.Random(seed)
    rows = [(r.randrange(5), i, START + datetime.timedelta(minutes=i // 2, microseconds=r.randrange(10**6)), r.random() < 0.2) for i in range(400)]
    arriving = sorted(rows, key=lambda x: x[2] + datetime.timedelta(minutes=r.randrange(30)))
    schema = "u long, row long, at timestamp, hit boolean"
    for k in range(8):
        spark.createDataFrame(arriving[k * 50 : k * 50 + 50], schema).coalesce(1).write.parquet(f"{tmp_path}/in/batch={k}")
    lost = (0, 999, START, True)
    spark.createDataFrame([lost], schema).coalesce(1).write.parquet(f"{tmp_path}/in/batch=8")

    def build():
        raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
        return S.rows_since_flag(S.timed(raw, "at", "1 hour"), "u", "at", "hit", "row")

    out = S.run_to_table(build, "shuffled", conf=S.ROCKSDB)
    got = {x["row"]: x["since"] for x in out.collect()}
    end = max(x[2] for x in rows) - datetime.timedelta(hours=1)
    want, since = {}, {}
    for u, row, at, hit in sorted(rows, key=lambda x: (x[2], x[1])):
        want[row] = since.get(u, 0)
        since[u] = 0 if hit else want[row] + 1
    passed = {row: want[row] for _, row, at, _ in rows if at < end}
    assert (sorted(set(got) - set(passed)), sorted(set(passed) - set(got))) == ([], [])
    assert got == passed
    assert 200 < len(got) < 400 and out.count() == len(got)
    batch = W.rows_since(spark.createDataFrame(rows, schema).withColumn("f", F.col("hit")), "f", ["u"], ["at", "row"], "x").collect()
    assert all(x["x"] == got[x["row"]] for x in batch if x["row"] in got and x["x"] != 999)


def test_keys_share_states(spark, tmp_path, monkeypatch):
    """A state serves a group of keys, null among them, so calls don't grow with the keys."""
    monkeypatch.setattr(S, "STATE_GROUPS", 2, raising=False)
    rows = [(None if i % 50 == 7 else 2**53 + i % 50, i, START + datetime.timedelta(seconds=i), i % 3 == 0) for i in range(300)] + [(1, 300, START + datetime.timedelta(days=1), False)]
    schema = "u long, row long, at timestamp, hit boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    build = lambda: S.rows_since_flag(S.timed(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"), "at", "1 hour"), "u", "at", "hit", "row")
    got = {(x["u"], x["row"]): x["since"] for x in S.run_to_table(build, "shared", conf=S.ROCKSDB).collect()}
    want, since = {}, {}
    for u, row, _, hit in rows[:300]:
        want[u, row] = since.get(u, 0)
        since[u] = 0 if hit else want[u, row] + 1
    assert got == want
    assert "pmod(xxhash64(u" in build()._jdf.queryExecution().analyzed().toString()
