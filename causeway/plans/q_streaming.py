"""Queries: streaming extensions over the events table, read as a stream until its present end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import events as S
from .registry import query, table


def _stream(spark, d, late="1 hour"):
    schema = table(spark, d, "events").schema
    return S.timed(spark.readStream.schema(schema).option("pathGlobFilter", "events*").option("recursiveFileLookup", "true").parquet(f"{d}/"), "ts", late)


@query("T01_tumbling_stream", """WITH w AS (SELECT date_trunc('day', ts) AS d, event_type, count(*) AS n FROM events GROUP BY ALL)
    SELECT strftime(d, '%Y-%m-%d') AS day, event_type, n FROM w WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")  # fmt: skip
def t01(spark, d):
    out = S.run_to_table(lambda: S.tumbling_counts(_stream(spark, d), "ts", "1 day", ["event_type"]), "tumbling")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("T02_session_stream", """WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
    g AS (SELECT user_id, ts, sum((p IS NULL OR ts - p > INTERVAL 30 MINUTE)::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e),
    s AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 30 MINUTE AS b, count(*) AS n FROM g GROUP BY user_id, k)
    SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(b, '%Y-%m-%d %H:%M:%S.%f') AS stop, n FROM s WHERE b <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")  # fmt: skip
def t02(spark, d):
    out = S.run_to_table(lambda: S.session_counts(_stream(spark, d), "ts", "30 minutes", ["user_id"]), "sessions")
    said = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return out.select("user_id", said("start").alias("start"), said("end").alias("stop"), "n")


@query("T03_dedup_stream", "SELECT event_id, user_id FROM events")
def t03(spark, d):
    return S.run_to_table(lambda: S.deduplicated(_stream(spark, d), ["event_id"]).select("event_id", "user_id"), "dedup")


@query("T04_interval_join_stream", """SELECT a.event_id AS signed, b.event_id AS sent FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'view' AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 24 HOUR""")
def t04(spark, d):
    def build():
        l = _stream(spark, d, "24 hours").where("event_type = 'purchase'")
        r = _stream(spark, d, "24 hours").where("event_type = 'view'")
        return S.interval_join(l, r, "user_id", "ts", "ts", "24 hours").select(F.col("l.event_id").alias("signed"), F.col("r.event_id").alias("sent"))

    return S.run_to_table(build, "interval")


@query("T05_reset_counter_stream", """WITH e AS (SELECT event_id, user_id, coalesce(sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ep, ts FROM events)
    SELECT event_id, user_id, since FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ep ORDER BY ts, event_id) - 1 AS since FROM e) WHERE ts < (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")  # fmt: skip
def t05(spark, d):
    """The rows that the watermark has passed, as T01 and T02 answer closed windows."""

    def build():
        s = _stream(spark, d).select("user_id", "event_id", "ts", (F.col("event_type") == "purchase").alias("flag"))
        return S.rows_since_flag(s, "user_id", "ts", "flag", "event_id")

    return S.run_to_table(build, "counter", conf=S.ROCKSDB)
