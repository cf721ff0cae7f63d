"""Causal features of user-by-email rows: recency, RFM windows, confound scores, hazards, competing risks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.times import day_number, days_between, micros
from ..operators.aggregates import crosstab
from ..operators.asof import asof_backward
from ..operators.buckets import TENURE_BREAKS, TENURE_LABELS, cut_right, quantile_cuts
from ..operators.joins import left_with_domain, require_unique
from ..operators.ranking import with_keyed_prefix_sums
from ..operators.windows import exclusive_sum, last_before, rolling_prior_sum, rows_since, trailing_days
from ..sources.shared import persist_shared
from .gates import GateError


def prior_action_recency(df: DataFrame, order: Sequence[str] = ("date_sent", "email_id"), windows: Sequence[int] = (1, 3, 5, 10), partial: bool = False) -> DataFrame:
    """user_id, email_id, date_sent and eight features of the rows before each row, from ``actioned_24h``."""
    rows = df.withColumn("_a", F.col("actioned_24h").cast("int"))
    rows = rows.withColumns({f"actioned_last_{n}": rolling_prior_sum("_a", n, ["user_id"], order, partial) for n in windows})
    rows = rows.withColumn("lifetime_actions_prior", exclusive_sum("_a", ["user_id"], order))
    rows = rows_since(rows, "_a", ["user_id"], order, "sends_since_last_action", None)
    return rows.withColumn("action_in_last_5", F.col("actioned_last_5") >= 1).withColumn("is_in_action_streak", F.col("actioned_last_3") == 3).drop("_a")


def _strictly_prior(df: DataFrame, key: str, sums: dict[str, Column]) -> DataFrame:
    """key, _t and the sums over the key's rows at earlier instants: rows of one instant are summed first, and a key's
    instants may lie in many partitions, so one large mailing isn't one task. Null keys are one key."""
    by = df.groupBy(key, "_t").agg(*[v.alias(k) for k, v in sums.items()])
    upto = with_keyed_prefix_sums(by, [key], ["_t"], {f"_upto_{k}": F.col(k) for k in sums})
    return upto.select(F.col(key).alias("_key"), F.col("_t").alias("_at"), *[(F.col(f"_upto_{k}") - F.col(k)).alias(k) for k in sums])


def _with_prior(rows: DataFrame, key: str, prior: DataFrame) -> DataFrame:
    return rows.join(prior, rows[key].eqNullSafe(prior["_key"]) & (rows["_t"] == prior["_at"])).drop("_key", "_at")


def confound_scores(df: DataFrame, at: str = "date_sent") -> DataFrame:
    """The rows with user_prior_engagement_score and email_popularity_score, from strictly earlier instants only."""
    rows = persist_shared(require_unique(df, ["user_id", "email_id", at]).withColumn("_t", micros(F.col(at))), "confound-rows")
    acted = F.sum(F.col("actioned_24h").cast("long"))
    out = _with_prior(rows, "user_id", _strictly_prior(rows, "user_id", {"_user_acts": F.coalesce(acted, F.lit(0))}))
    out = _with_prior(out, "email_id", _strictly_prior(rows, "email_id", {"_sends": F.count(F.lit(1)), "_acts": F.coalesce(acted, F.lit(0))}))
    out = out.withColumn("user_prior_engagement_score", F.log1p("_user_acts")).withColumn("email_popularity_score", (F.col("_acts") + 1) / (F.col("_sends") + 2))
    return out.select(*df.columns, "user_prior_engagement_score", "email_popularity_score")


def leak_audit(df: DataFrame, at: str, tolerance: float = 1e-9) -> DataFrame:
    """n_checked, max_diff of both confound scores against scores derived anew, by another way: totals up to each instant
    are looked up strictly before a row's own by an as-of join.

    GateError if a score differs: it then knows its own or a later instant.
    """
    rows = df.withColumn("_t", micros(F.col(at)))
    checked = rows
    for key, n, a in (("user_id", "_n_user", "_a_user"), ("email_id", "_n_email", "_a_email")):
        steps = rows.where(F.col(key).isNotNull()).groupBy(key, "_t").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("actioned_24h").cast("long")).alias("a"))
        upto = Window.partitionBy(key).orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
        totals = steps.select(key, "_t", F.sum("n").over(upto).alias(n), F.sum("a").over(upto).alias(a))
        checked = asof_backward(checked, totals, [key], "_t", "_t", [n, a], strict=True)
    engaged, popular = F.log1p(F.coalesce("_a_user", F.lit(0))), (F.coalesce("_a_email", F.lit(0)) + 1) / (F.coalesce("_n_email", F.lit(0)) + 2)
    diff = F.greatest(F.abs(engaged - F.col("user_prior_engagement_score")), F.abs(popular - F.col("email_popularity_score")))
    out = persist_shared(checked.agg(F.count(F.lit(1)).alias("n_checked"), F.max(diff).alias("max_diff")), "leak-audit")
    seen = out.first()
    if seen["max_diff"] is not None and seen["max_diff"] > tolerance:
        raise GateError(f"scores look ahead: they differ by up to {seen['max_diff']}")
    return out


def rfm(sends: DataFrame, events: DataFrame, days: Sequence[int] = (7, 30, 90)) -> DataFrame:
    """Send rows with action, open and click rates of trailing day windows that end yesterday.

    Sends and events are unioned as daily counts, so one shuffle by user serves every RANGE frame; no as-of lookups.
    ``sends`` has activity_id, user_id, email_id, date_sent, actioned_24h; ``events`` user_id, action_type, created_at.
    """
    zero = {c: F.lit(0).cast("long") for c in ("n_act", "n_sends", "n_opens", "n_clicks")}
    s = sends.select("user_id", day_number(F.col("date_sent")).alias("day"), F.col("actioned_24h").cast("long").alias("n_act"), F.lit(1).cast("long").alias("n_sends"))
    e = events.where("action_type in ('open', 'click')").select(
        "user_id", day_number(F.col("created_at")).alias("day"), (F.col("action_type") == "open").cast("long").alias("n_opens"), (F.col("action_type") == "click").cast("long").alias("n_clicks")
    )
    daily = s.unionByName(e, allowMissingColumns=True).groupBy("user_id", "day").agg(*[F.coalesce(F.sum(c), zero[c]).alias(c) for c in zero])
    totals = daily.withColumns({f"{c}_{k}": F.coalesce(trailing_days(F.sum(c), ["user_id"], "day", k), F.lit(0)) for c in zero for k in days})
    upto = Window.partitionBy("user_id").orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    # Rates are over 1e-9 more than the sends, and so 0 without any.
    rates = {f"{name}_rate_{k}d": F.col(f"{c}_{k}") / (F.col(f"n_sends_{k}") + 1e-9) for name, c in (("action", "n_act"), ("open", "n_opens"), ("click", "n_clicks")) for k in days}
    last = {f"days_since_last_{n}": F.coalesce(F.col("day") - F.max(F.when(F.col(c) > 0, F.col("day"))).over(upto), F.lit(999)) for n, c in (("open", "n_opens"), ("click", "n_clicks"))}
    totals = totals.withColumns(rates | last).select("user_id", "day", *rates, *last, F.col("n_sends_30").alias("sends_last_30d") if 30 in days else F.lit(None).alias("sends_last_30d"))
    order = ["date_sent", "activity_id"]
    rows = sends.withColumn("day", day_number(F.col("date_sent"))).withColumn("_a", F.col("actioned_24h").cast("long"))
    rows = rows.withColumn("log1p_prior_action_count", F.log1p(exclusive_sum("_a", ["user_id"], order)))
    acted = last_before(F.when(F.col("actioned_24h"), F.col("day")), ["user_id"], order)
    rows = rows.withColumn("days_since_last_action", F.coalesce(F.col("day") - acted, F.lit(999)))
    tenure = F.col("day") - F.min("day").over(Window.partitionBy("user_id"))
    rows = rows.withColumn("tenure_days", tenure).withColumn("tenure_bucket", cut_right(F.col("tenure_days"), TENURE_BREAKS, TENURE_LABELS))
    return rows.drop("_a").join(totals, ["user_id", "day"]).drop("day")


def hazard_curve(df: DataFrame, most: int = 60, order: Sequence[str] = ("date_sent", "activity_id")) -> DataFrame:
    """sends_since_last_action 0..most, hazard (null where nothing was seen), n."""
    lagged = rows_since(df.withColumn("_a", F.col("actioned_24h").cast("int")), "_a", ["user_id"], order, "sends_since_last_action", None)
    seen = lagged.where(F.col("sends_since_last_action") <= most).groupBy(F.col("sends_since_last_action").cast("long").alias("sends_since_last_action"))
    return left_with_domain(seen.agg(F.avg("_a").alias("hazard"), F.count(F.lit(1)).alias("n")), "sends_since_last_action", 0, most + 1, {"n": 0})


def user_risk_stats(df: DataFrame) -> DataFrame:
    """Per user: total_actions, action_rate, ever_unsubbed, send_count, active_days."""
    return df.groupBy("user_id").agg(
        F.sum(F.col("actioned").cast("long")).alias("total_actions"), F.avg(F.col("actioned").cast("double")).alias("action_rate"), F.bool_or("unsubscribed").alias("ever_unsubbed"),
        F.count(F.lit(1)).alias("send_count"), days_between(F.min("date_sent"), F.max("date_sent")).alias("active_days"),
    )


def risk_crosstab(stats: DataFrame, a: str, b: str) -> DataFrame:
    """Tertiles of two measures against each other: n, share and the unsubscribe rate of all nine cells."""
    bands = ["low", "mid", "high"]
    out = stats = persist_shared(stats, "risk-stats")
    for c in (a, b):
        cuts = quantile_cuts(stats, c, [0.3333, 0.6667])
        label = F.when(F.col(c) <= F.col("q0"), "low").when(F.col(c) <= F.col("q1"), "mid").otherwise("high")
        out = out.crossJoin(F.broadcast(cuts)).withColumn(f"{c}_band", label).drop("q0", "q1")  # cuts is one row
    return crosstab(out, f"{a}_band", f"{b}_band", bands, bands, unsub_rate=F.avg(F.col("ever_unsubbed").cast("double")))
