"""Email rollups: totals, consistency flags, rates, unusualness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.buckets import quantiles_of

SENT_TOLERANCE = 0.25
STD_EPSILON = 1e-9


def sent_in_range(total: str, stats: str, tolerance: float = SENT_TOLERANCE) -> Column:
    """The counted total is at most the reported one and short of it by less than the tolerance."""
    t, s = F.col(total), F.col(stats)
    return F.coalesce((s > 0) & (t <= s) & (F.try_divide(s - t, s) < tolerance), F.lit(False))


def in_range(total: str, stats: str) -> Column:
    t, s = F.col(total), F.col(stats)
    return F.coalesce(((t == 0) & (s == 0)) | (t <= s), F.lit(False))


def email_totals(activities: DataFrame, attributed: DataFrame) -> DataFrame:
    """email_id, total_sent, total_opens, total_clicks (distinct users), total_actions (attributed signatures).

    Null users are left out before counting; one aggregation over the activities, one over the attributions.
    """
    known = activities.where("user_id is not null")
    kinds = {"total_sent": "sent", "total_opens": "open", "total_clicks": "click"}
    users = known.groupBy("email_id").agg(*[F.count_distinct(F.when(F.col("action_type") == v, F.col("user_id"))).alias(k) for k, v in kinds.items()])
    acts = attributed.groupBy("email_id").agg(F.count_if("is_attributed").alias("total_actions"))
    return users.join(acts, "email_id", "left").withColumn("total_actions", F.coalesce("total_actions", F.lit(0)))


def rates(df: DataFrame) -> DataFrame:
    """Funnel rates, each null where its denominator is 0."""
    pairs = {"open_rate": ("total_opens", "total_sent"), "click_rate": ("total_clicks", "total_sent"), "action_rate": ("total_actions", "total_sent"),
             "click_per_open": ("total_clicks", "total_opens"), "action_per_click": ("total_actions", "total_clicks")}
    return df.withColumns({k: F.try_divide(a, b) for k, (a, b) in pairs.items()})


def unusualness(df: DataFrame, cohort: str, cols: Sequence[str], epsilon: float = STD_EPSILON) -> DataFrame:
    """Sum over the columns of the distance to the cohort's median in cohort standard deviations; null counts as 0."""
    stats = df.groupBy(cohort).agg(*[F.stddev_samp(c).alias(f"_s_{c}") for c in cols])
    stats = stats.join(quantiles_of(df, cols, 0.5, [cohort]).withColumnsRenamed({c: f"_m_{c}" for c in cols}), cohort, "left")
    z = [F.coalesce(F.abs((F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > epsilon, F.col(f"_s_{c}")).otherwise(epsilon)), F.lit(0.0)) for c in cols]
    return df.join(stats, cohort, "left").withColumn("unusualness", sum(z[1:], z[0])).select(*df.columns, "unusualness")


def most_unusual(df: DataFrame, cohort: str, cols: Sequence[str], key: str, n: int) -> DataFrame:
    scored = unusualness(df, cohort, cols)
    place = F.row_number().over(Window.partitionBy(cohort).orderBy(F.col("unusualness").desc(), key))
    return scored.withColumn("place", place).where(F.col("place") <= n)
