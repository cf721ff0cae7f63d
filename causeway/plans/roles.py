"""The engagement tables that the pipelines work on, read from an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table

#: What each event type stands for.
ACTION_TYPES = {"view": "sent", "signup": "open", "click": "click", "purchase": "signature", "error": "unsubscribe"}
N_PETITIONS = 25

#: The same tables as SQL common table expressions.
ACT = """act AS (SELECT event_id AS activity_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS email_id, user_id,
    CASE event_type WHEN 'view' THEN 'sent' WHEN 'signup' THEN 'open' WHEN 'click' THEN 'click' WHEN 'purchase' THEN 'signature'
    WHEN 'error' THEN 'unsubscribe' END AS action_type, ts AS created_at, value FROM events)"""
SIGN = "sign AS (SELECT event_id AS signature_id, user_id, event_id % 25 AS petition_id, ts AS created_at FROM events WHERE event_type = 'purchase')"


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """activity_id, email_id, user_id, action_type, created_at, value."""
    e = table(spark, sf_dir, "events")
    kind = F.create_map(*[F.lit(x) for pair in ACTION_TYPES.items() for x in pair])
    return e.select(
        F.col("event_id").alias("activity_id"), F.from_json("props", "k bigint").getField("k").alias("email_id"), "user_id",
        F.try_element_at(kind, F.col("event_type")).alias("action_type"), F.col("ts").alias("created_at"), "value",
    )


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signature_id, user_id, petition_id, created_at."""
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return e.select(F.col("event_id").alias("signature_id"), "user_id", (F.col("event_id") % N_PETITIONS).alias("petition_id"), F.col("ts").alias("created_at"))


def sends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """activity_id, email_id, user_id, send_time."""
    return activities(spark, sf_dir).where("action_type = 'sent'").select("activity_id", "email_id", "user_id", F.col("created_at").alias("send_time"))


#: user x send rows with a label: whether a signature follows within 24 hours; as SQL.
SENDS = f"""{ACT}, sends AS (SELECT activity_id, email_id, user_id, created_at AS date_sent FROM act WHERE action_type = 'sent'),
  hits AS (SELECT s.activity_id, count(*) AS n FROM act a ASOF JOIN sends s ON a.user_id = s.user_id AND a.created_at >= s.date_sent
    WHERE a.action_type = 'signature' AND a.created_at - s.date_sent <= INTERVAL 24 HOUR GROUP BY ALL),
  ue AS (SELECT s.*, coalesce(n, 0) AS n_actions_24h, coalesce(n, 0) > 0 AS actioned_24h FROM sends s LEFT JOIN hits USING (activity_id))"""
