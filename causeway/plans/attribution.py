"""Attribution of signatures to the latest earlier send, and the user-by-email tables built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import DAY, seconds_between
from ..operators.asof import asof_backward
from ..operators.windows import is_first, next_value

BOT_LAG_SECONDS = 10
_FOUND = ("email_id", "send_time", "window_seconds", "_end")


def send_windows(sends: DataFrame, cutoff: Column | None = None, cap_days: int | None = None) -> DataFrame:
    """Sends with next_send_time and window_seconds.

    The last send of a user ends at ``cutoff``; without one it is left out. ``cap_days`` bounds a window's length.
    """
    out = sends.withColumn("next_send_time", next_value("send_time", ["user_id"], ["send_time", "activity_id"], cutoff))
    out = out.where("next_send_time is not null")
    seconds = seconds_between(F.col("send_time"), F.col("next_send_time"))
    return out.withColumn("window_seconds", F.least(seconds, F.lit(cap_days * 86_400)) if cap_days else seconds)


def attribute(actions: DataFrame, sends: DataFrame, cutoff: Column | None = None, cap_days: int | None = None, bot_lag: bool = True) -> DataFrame:
    """One row per signature: its send, lag, window, and whether it is the window's first.

    A signature belongs to the latest send at or before it, and only while it is strictly inside that send's window;
    otherwise all attribution columns are null. Of simultaneous signatures the smaller id is first.
    """
    windows = send_windows(sends, cutoff, cap_days).withColumn("_end", F.col("window_seconds"))
    hit = asof_backward(actions, windows, ["user_id"], "created_at", "send_time", _FOUND, tie_break="activity_id")
    lag = seconds_between(F.col("send_time"), F.col("created_at"))
    inside = F.coalesce(lag < F.col("window_seconds"), F.lit(False))
    # One condition blanks the whole group of columns.
    found = F.when(inside, F.struct("email_id", "send_time", lag.alias("lag_seconds"), "window_seconds"))
    out = hit.select("signature_id", "user_id", "petition_id", F.col("created_at").alias("sign_time"), found.alias("_f"))
    out = out.select("signature_id", "user_id", "petition_id", "sign_time", "_f.*")
    first = F.col("email_id").isNotNull() & is_first(["user_id", "email_id", "send_time"], ["sign_time", "signature_id"])
    out = out.withColumn("is_first_in_window", first).withColumn("is_attributed", F.col("is_first_in_window"))
    return out.withColumn("is_bot_lag", F.coalesce(F.col("lag_seconds") < BOT_LAG_SECONDS, F.lit(False))) if bot_lag else out


def user_emails_24h(sends: DataFrame, actions: DataFrame) -> DataFrame:
    """One row per send with n_actions_24h and actioned_24h: signatures whose latest send it is, within 24 hours."""
    s = sends.withColumnRenamed("send_time", "date_sent")
    hit = asof_backward(actions, s, ["user_id"], "created_at", "date_sent", ["activity_id"], tie_break="activity_id", tolerance=DAY)
    counts = hit.where("activity_id is not null").groupBy("activity_id").agg(F.count(F.lit(1)).alias("n_actions_24h"))
    out = s.join(counts, "activity_id", "left").withColumn("n_actions_24h", F.coalesce("n_actions_24h", F.lit(0)))
    return out.select("activity_id", "email_id", "user_id", "date_sent", "n_actions_24h", (F.col("n_actions_24h") > 0).alias("actioned_24h"))


def user_emails_flags(activities: DataFrame, attributed: DataFrame) -> DataFrame:
    """One row per (user, email): date_sent, opened, verified_opened, clicked, actioned, unsubscribed.

    One conditional aggregation instead of a chain of marker joins. A click or an action implies an open. An
    unsubscribe counts for the latest send of at most 7 days before it.
    """
    sent = activities.where("action_type = 'sent'")
    gone = activities.where("action_type = 'unsubscribe'").select("user_id", F.col("created_at").alias("at"))
    first = sent.groupBy("user_id", "email_id").agg(F.min("created_at").alias("date_sent"))
    hit = asof_backward(gone, sent.select("user_id", "email_id", "created_at", "activity_id"), ["user_id"], "at", "created_at", ["email_id"], "activity_id", 7 * DAY)
    marks = (
        activities.where("action_type in ('open', 'click')").select("user_id", "email_id", "action_type")
        .unionByName(attributed.where("is_attributed").select("user_id", "email_id", F.lit("action").alias("action_type")))
        .unionByName(hit.where("email_id is not null").select("user_id", "email_id", F.lit("gone").alias("action_type")))
    )
    flags = marks.groupBy("user_id", "email_id").agg(*[F.bool_or(F.col("action_type") == k).alias(k) for k in ("open", "click", "action", "gone")])
    out = first.join(flags, ["user_id", "email_id"], "left").na.fill(False, ["open", "click", "action", "gone"])
    implied = F.col("click") | F.col("action")
    return out.select(
        "user_id", "email_id", "date_sent", (F.col("open") | implied).alias("opened"), (F.col("open") | implied).alias("verified_opened"), implied.alias("clicked"), F.col("action").alias("actioned"), F.col("gone").alias("unsubscribed")
    )
