"""Boundaries of attribution on literal rows."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from causeway.plans.attribution import attribute

T0 = datetime(2026, 1, 1)


def at(h, m=0, s=0):
    return T0 + timedelta(hours=h, minutes=m, seconds=s)


def run(spark, sends, signs, **options):
    s = spark.createDataFrame([(i, 10 + i, 1, t) for i, t in enumerate(sends)], "activity_id long, email_id long, user_id long, send_time timestamp_ntz")
    a = spark.createDataFrame([(i, 1, 5, t) for i, t in signs], "signature_id long, user_id long, petition_id long, created_at timestamp_ntz")
    return {r["signature_id"]: r for r in attribute(a, s, **options).collect()}


def test_inside_window(spark):
    r = run(spark, [at(0), at(5)], [(1, at(1))])[1]
    assert (r["email_id"], r["lag_seconds"], r["window_seconds"], r["is_first_in_window"], r["is_attributed"]) == (10, 3600, 18000, True, True)


def test_exactly_at_capped_window_end_is_unattributed(spark):
    r = run(spark, [at(0), at(24 * 10)], [(1, at(24 * 7))], cap_days=7)[1]
    assert r["email_id"] is None and r["send_time"] is None and r["lag_seconds"] is None and r["window_seconds"] is None and not r["is_attributed"]


def test_one_second_before_window_end(spark):
    assert run(spark, [at(0), at(24 * 10)], [(1, at(24 * 7 - 1, 59, 59))], cap_days=7)[1]["email_id"] == 10


def test_signature_at_next_send_belongs_to_it(spark):
    assert run(spark, [at(0), at(5), at(9)], [(1, at(5))])[1]["email_id"] == 11


def test_only_earliest_of_a_window_is_first(spark):
    r = run(spark, [at(0), at(5)], [(1, at(2)), (2, at(1))])
    assert [r[i]["is_first_in_window"] for i in (1, 2)] == [False, True] and r[1]["email_id"] == r[2]["email_id"] == 10


def test_tie_goes_to_smaller_id(spark):
    r = run(spark, [at(0), at(5)], [(7, at(1)), (3, at(1))])
    assert r[3]["is_attributed"] and not r[7]["is_attributed"]


def test_single_send_needs_a_cutoff(spark):
    assert run(spark, [at(0)], [(1, at(1))])[1]["email_id"] is None
    assert run(spark, [at(0)], [(1, at(1))], cutoff=F.lit("2026-01-02").cast("timestamp_ntz"))[1]["email_id"] == 10


def test_before_any_send(spark):
    assert run(spark, [at(3), at(5)], [(1, at(1))])[1]["email_id"] is None


def test_bot_lag(spark):
    r = run(spark, [at(0), at(5)], [(1, at(0, 0, 9)), (2, at(0, 0, 10))])
    assert r[1]["is_bot_lag"] and not r[2]["is_bot_lag"]
