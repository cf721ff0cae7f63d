"""Queries: window functions and the feature pipelines built on them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.times import day_number, days_between, micros, seconds_between
from ..operators import windows as W
from ..operators.ranking import with_average_rank, with_row_number
from ..sources.shared import persist_shared
from . import features as X
from .attribution import attribute, send_windows, user_emails_24h, user_emails_flags
from .emails import email_totals, in_range, most_unusual, rates, sent_in_range
from .ledger_queries import champions
from .registry import query, table
from .roles import ACT, SENDS, SIGN, actions, activities, sends

_UE = f"WITH {SENDS}"
_W = "OVER (PARTITION BY user_id ORDER BY date_sent, activity_id"


def user_emails(spark, d):
    return user_emails_24h(sends(spark, d), actions(spark, d))


@query("W01_next_send", f"WITH {SENDS} SELECT activity_id, coalesce(lead(date_sent) {_W}), TIMESTAMP '2024-02-01') AS next_send_time FROM sends")
def w01(spark, d):
    return send_windows(sends(spark, d), F.lit("2024-02-01").cast("timestamp_ntz")).select("activity_id", "next_send_time")


@query("W02_window_seconds", f"WITH {SENDS}, n AS (SELECT activity_id, date_sent, lead(date_sent) {_W}) AS e FROM sends) SELECT activity_id, least(epoch_us(e) - epoch_us(date_sent), 604800000000) // 1000000 AS window_seconds FROM n WHERE e IS NOT NULL")
def w02(spark, d):
    return send_windows(sends(spark, d), cap_days=7).select("activity_id", "window_seconds")


@query("W03_first_in_window", f"WITH {SIGN} SELECT signature_id, row_number() OVER (PARTITION BY user_id, CAST(created_at AS DATE) ORDER BY created_at, signature_id) = 1 AS is_first FROM sign")
def w03(spark, d):
    a = actions(spark, d).withColumn("day", F.col("created_at").cast("date"))
    return a.select("signature_id", W.is_first(["user_id", "day"], ["created_at", "signature_id"]).alias("is_first"))


@query("W04_exclusive_sum", f"{_UE} SELECT activity_id, CAST(coalesce(sum(actioned_24h::INT) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prior FROM ue")
def w04(spark, d):
    ue = user_emails(spark, d).withColumn("a", F.col("actioned_24h").cast("int"))
    return ue.select("activity_id", W.exclusive_sum("a", ["user_id"], ["date_sent", "activity_id"]).alias("prior"))


@query("W05_strict_prior", f"""{_UE} SELECT activity_id, CAST(coalesce(sum(actioned_24h::INT) OVER (PARTITION BY user_id ORDER BY CAST(date_sent AS DATE) RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING), 0) AS BIGINT) AS prior FROM ue""")
def w05(spark, d):
    ue = user_emails(spark, d).withColumn("day", day_number(F.col("date_sent")))
    # A user's days are few; its rows are not: they are summed by day before the window.
    daily = ue.groupBy("user_id", "day").agg(F.sum(F.col("actioned_24h").cast("int")).alias("n"))
    prior = daily.select("user_id", "day", F.coalesce(W.strict_prior(F.sum("n"), ["user_id"], "day"), F.lit(0)).alias("prior"))
    return ue.join(prior, ["user_id", "day"]).select("activity_id", "prior")


_CONF = """RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING"""


@query("W06_confound_scores", f"""{_UE} SELECT activity_id, round(ln(1 + coalesce(sum(actioned_24h::INT) OVER (PARTITION BY user_id ORDER BY date_sent {_CONF}), 0)), 6) AS engagement,
    round((coalesce(sum(actioned_24h::INT) OVER (PARTITION BY email_id ORDER BY date_sent {_CONF}), 0) + 1) / (count(*) OVER (PARTITION BY email_id ORDER BY date_sent {_CONF}) + 2), 6) AS popularity FROM ue""")  # fmt: skip
def w06(spark, d):
    return X.confound_scores(user_emails(spark, d)).select("activity_id", F.round("user_prior_engagement_score", 6).alias("engagement"), F.round("email_popularity_score", 6).alias("popularity"))


def _roll(n):
    f = f"{_W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count(*) {f} = {n} THEN CAST(sum(actioned_24h::INT) {f} AS BIGINT) ELSE 0 END AS actioned_last_{n}"


@query("W07_rolling_prior", f"{_UE} SELECT activity_id, {_roll(3)}, {_roll(5)} FROM ue")
def w07(spark, d):
    ue = user_emails(spark, d).withColumn("a", F.col("actioned_24h").cast("int"))
    order = ["date_sent", "activity_id"]
    return ue.select("activity_id", *[W.rolling_prior_sum("a", n, ["user_id"], order).alias(f"actioned_last_{n}") for n in (3, 5)])


@query("W08_trailing_days", f"""WITH {ACT} SELECT activity_id, count(*) FILTER (action_type = 'open') OVER (PARTITION BY user_id ORDER BY CAST(created_at AS DATE) RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS opens_7d,
    count(*) OVER (PARTITION BY user_id ORDER BY CAST(created_at AS DATE) RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS events_30d FROM act""")  # fmt: skip
def w08(spark, d):
    a = activities(spark, d).withColumn("day", day_number(F.col("created_at")))
    return a.select("activity_id", W.trailing_days(F.count_if(F.col("action_type") == "open"), ["user_id"], "day", 7).alias("opens_7d"), W.trailing_days(F.count(F.lit(1)), ["user_id"], "day", 30).alias("events_30d"))


_EPOCH = f"SELECT *, coalesce(sum(actioned_24h::INT) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ep FROM ue"


@query("W09_reset_counter", f"{_UE}, e AS ({_EPOCH}) SELECT activity_id, CASE WHEN ep = 0 THEN 999 ELSE row_number() OVER (PARTITION BY user_id, ep ORDER BY date_sent, activity_id) - 1 END AS since FROM e")
def w09(spark, d):
    ue = user_emails(spark, d).withColumn("a", F.col("actioned_24h").cast("int"))
    return W.rows_since(ue, "a", ["user_id"], ["date_sent", "activity_id"], "since").select("activity_id", "since")


@query("W10_streaks", f"""{_UE}, r AS (SELECT user_id, date_sent, actioned_24h, row_number() {_W}) - sum(actioned_24h::INT) {_W}) AS g FROM ue)
    SELECT user_id, min(date_sent) AS first, count(*) AS length FROM r WHERE actioned_24h GROUP BY user_id, g HAVING count(*) >= 3""")  # fmt: skip
def w10(spark, d):
    return W.runs(user_emails(spark, d), "actioned_24h", ["user_id"], ["date_sent", "activity_id"]).where("length >= 3")


@query("W11_consecutive_prior", f"{_UE}, e AS ({_EPOCH}) SELECT activity_id, row_number() OVER (PARTITION BY user_id, ep ORDER BY date_sent, activity_id) - 1 AS quiet FROM e")
def w11(spark, d):
    return W.consecutive_prior(user_emails(spark, d), "actioned_24h", ["user_id"], ["date_sent", "activity_id"], "quiet").select("activity_id", "quiet")


@query("W12_days_since_last", f"""{_UE}, l AS (SELECT activity_id, CAST(date_sent AS DATE) AS day, max(CASE WHEN actioned_24h THEN CAST(date_sent AS DATE) END) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM ue)
    SELECT activity_id, coalesce(day - last, 999) AS days_since FROM l""")  # fmt: skip
def w12(spark, d):
    ue = user_emails(spark, d).withColumn("day", day_number(F.col("date_sent")))
    last = W.last_before(F.when(F.col("actioned_24h"), F.col("day")), ["user_id"], ["date_sent", "activity_id"])
    return ue.withColumn("last", last).select("activity_id", F.coalesce((F.col("day") - F.col("last")).cast("long"), F.lit(999)).alias("days_since"))


@query("W13_tenure_days", f"WITH {ACT} SELECT activity_id, (epoch_us(created_at) - min(epoch_us(created_at)) OVER (PARTITION BY user_id)) // 86400000000 AS tenure_days FROM act")
def w13(spark, d):
    first = F.min("created_at").over(Window.partitionBy("user_id"))
    return activities(spark, d).select("activity_id", days_between(first, F.col("created_at")).alias("tenure_days"))


@query("W14_row_index", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS idx FROM orders")
def w14(spark, d):
    numbered, _ = with_row_number(table(spark, d, "orders"), ["o_orderdate", "o_orderkey"], "idx")
    return numbered.select("o_orderkey", "idx")


@query("W15_unusualness", """WITH s AS (SELECT c_mktsegment, median(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer GROUP BY 1),
    z AS (SELECT c.c_mktsegment, c_custkey, abs((c_acctbal - m) / CASE WHEN s > 1e-9 THEN s ELSE 1e-9 END) AS u FROM customer c JOIN s USING (c_mktsegment)),
    r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY u DESC, c_custkey) AS place FROM z) SELECT c_mktsegment, c_custkey, round(u, 6) AS unusualness, place FROM r WHERE place <= 5""")  # fmt: skip
def w15(spark, d):
    out = most_unusual(table(spark, d, "customer"), "c_mktsegment", ["c_acctbal"], "c_custkey", 5)
    return out.select("c_mktsegment", "c_custkey", F.round("unusualness", 6).alias("unusualness"), "place")


@query("W16_min_max", "WITH m AS (SELECT min(s_acctbal) AS a, max(s_acctbal) AS b FROM supplier) SELECT s_suppkey, CASE WHEN b > a THEN round((s_acctbal - a) / (b - a), 6) ELSE 1.0 END AS scaled FROM supplier, m")
def w16(spark, d):
    from ..functions.vectors import min_max

    return min_max(table(spark, d, "supplier"), "s_acctbal", "scaled").select("s_suppkey", F.round("scaled", 6).alias("scaled"))


@query("W17_last_row_wins", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def w17(spark, d):
    return W.last_row_wins(table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("W18_average_rank", "SELECT p_partkey, (rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2) / (SELECT count(*) FROM part) AS pct FROM part")
def w18(spark, d):
    p = table(spark, d, "part")
    n = p.agg(F.count(F.lit(1)).alias("n"))
    return with_average_rank(p, "p_size", "r").crossJoin(F.broadcast(n)).select("p_partkey", (F.col("r") / F.col("n")).alias("pct"))  # one row


@query("W19_trailing_streak", f"""WITH {ACT}, b AS (SELECT user_id, sum((value <= 10)::INT) OVER (PARTITION BY user_id ORDER BY created_at DESC, activity_id DESC) AS broken FROM act)
    SELECT user_id, count(*) FILTER (broken = 0) AS streak FROM b GROUP BY user_id""")  # fmt: skip
def w19(spark, d):
    a = activities(spark, d).withColumn("good", F.col("value") > 10)
    return W.trailing_streak(a, "good", ["user_id"], ["created_at", "activity_id"])


@query("W20_running_best", """SELECT o_orderkey, max(o_totalprice) OVER w AS best_so_far, coalesce(o_totalprice > max(o_totalprice) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_champion
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")  # fmt: skip
def w20(spark, d):
    return champions(table(spark, d, "orders"), "o_custkey", "o_orderkey", "o_totalprice", "o_orderdate").select("o_orderkey", "best_so_far", "is_champion")


# Pipelines


def _attributed(cutoff, cap):
    last = f"coalesce(lead(created_at) OVER (PARTITION BY user_id ORDER BY created_at, activity_id), {cutoff})"
    length = "epoch_us(nxt) - epoch_us(created_at)"
    return f"""{ACT}, {SIGN}, w0 AS (SELECT user_id, email_id, activity_id, created_at, {last} AS nxt FROM act WHERE action_type = 'sent'),
      w AS (SELECT user_id, email_id, created_at AS send_time, {f'least({length}, {cap} * 86400000000)' if cap else length} AS len FROM w0 WHERE nxt IS NOT NULL),
      j AS (SELECT sign.*, w.email_id, send_time, len, epoch_us(sign.created_at) - epoch_us(send_time) AS lag FROM sign ASOF LEFT JOIN w ON sign.user_id = w.user_id AND sign.created_at >= w.send_time),
      k AS (SELECT signature_id, user_id, petition_id, created_at AS sign_time, CASE WHEN lag // 1000000 < len // 1000000 THEN struct_pack(e := email_id, s := send_time, l := lag // 1000000, w := len // 1000000) END AS f FROM j),
      att AS (SELECT signature_id, user_id, petition_id, sign_time, f.e AS email_id, f.s AS send_time, f.l AS lag_seconds, f.w AS window_seconds,
        f.e IS NOT NULL AND row_number() OVER (PARTITION BY user_id, f.e, f.s ORDER BY sign_time, signature_id) = 1 AS is_first_in_window FROM k)"""


_V2 = _attributed("TIMESTAMP '2024-02-01'", None)
CUTOFF = "2024-02-01"


def attributed(spark, d):
    return attribute(actions(spark, d), sends(spark, d), F.lit(CUTOFF).cast("timestamp_ntz"))


@query("D01_attribution_v1", f"WITH {_attributed('NULL', 7)} SELECT *, is_first_in_window AS is_attributed FROM att")
def d01(spark, d):
    return attribute(actions(spark, d), sends(spark, d), cap_days=7, bot_lag=False)


@query("D02_attribution_v2", f"WITH {_V2} SELECT *, is_first_in_window AS is_attributed, coalesce(lag_seconds < 10, false) AS is_bot_lag FROM att")
def d02(spark, d):
    return attributed(spark, d)


@query("D03_user_emails_flags", f"""WITH {_V2}, f AS (SELECT user_id, email_id, min(created_at) AS date_sent FROM act WHERE action_type = 'sent' GROUP BY ALL),
    ev AS (SELECT user_id, email_id, bool_or(action_type = 'open') AS o, bool_or(action_type = 'click') AS c FROM act WHERE action_type IN ('open', 'click') GROUP BY ALL),
    ac AS (SELECT DISTINCT user_id, email_id FROM att WHERE is_first_in_window), s AS (SELECT user_id, email_id, created_at AS t FROM act WHERE action_type = 'sent'),
    un AS (SELECT DISTINCT a.user_id, s.email_id FROM act a ASOF JOIN s ON a.user_id = s.user_id AND a.created_at >= s.t WHERE a.action_type = 'unsubscribe' AND a.created_at - s.t <= INTERVAL 7 DAY)
    SELECT f.user_id, f.email_id, date_sent, coalesce(o, false) OR coalesce(c, false) OR ac.user_id IS NOT NULL AS opened, coalesce(o, false) OR coalesce(c, false) OR ac.user_id IS NOT NULL AS verified_opened,
      coalesce(c, false) OR ac.user_id IS NOT NULL AS clicked, ac.user_id IS NOT NULL AS actioned, un.user_id IS NOT NULL AS unsubscribed
    FROM f LEFT JOIN ev ON f.user_id = ev.user_id AND f.email_id = ev.email_id LEFT JOIN ac ON f.user_id = ac.user_id AND f.email_id = ac.email_id LEFT JOIN un ON f.user_id = un.user_id AND f.email_id = un.email_id""")  # fmt: skip
def d03(spark, d):
    return user_emails_flags(activities(spark, d), attributed(spark, d))


@query("D04_user_emails_24h", f"{_UE} SELECT activity_id, email_id, user_id, date_sent, n_actions_24h, actioned_24h FROM ue")
def d04(spark, d):
    return user_emails(spark, d)


_TOTALS = f"""WITH {_V2}, u AS (SELECT email_id, count(DISTINCT user_id) FILTER (action_type = 'sent') AS total_sent, count(DISTINCT user_id) FILTER (action_type = 'open') AS total_opens,
    count(DISTINCT user_id) FILTER (action_type = 'click') AS total_clicks FROM act WHERE user_id IS NOT NULL GROUP BY 1), a AS (SELECT email_id, count(*) FILTER (is_first_in_window) AS n FROM att GROUP BY 1),
    tot AS (SELECT u.*, coalesce(n, 0) AS total_actions FROM u LEFT JOIN a USING (email_id))"""


@query("D05_email_totals", f"""{_TOTALS} SELECT *, coalesce(total_sent + 2 > 0 AND total_sent <= total_sent + 2 AND 2 / (total_sent + 2) < 0.25, false) AS sent_in_range, total_opens <= total_sent OR (total_opens = 0 AND total_sent = 0) AS opens_in_range FROM tot""")
def d05(spark, d):
    t = email_totals(activities(spark, d), attributed(spark, d)).withColumn("stats_sent", F.col("total_sent") + 2)
    return t.withColumn("sent_in_range", sent_in_range("total_sent", "stats_sent")).withColumn("opens_in_range", in_range("total_opens", "total_sent")).drop("stats_sent")


@query("D07_prior_action_recency", f"""{_UE}, e AS ({_EPOCH}), f AS (SELECT activity_id, {_roll(1)}, {_roll(3)}, {_roll(5)}, {_roll(10)}, CAST(ep AS BIGINT) AS lifetime_actions_prior,
    row_number() OVER (PARTITION BY user_id, ep ORDER BY date_sent, activity_id) - 1 AS sends_since_last_action FROM e) SELECT *, actioned_last_5 >= 1 AS action_in_last_5, actioned_last_3 = 3 AS is_in_action_streak FROM f""")  # fmt: skip
def d07(spark, d):
    return X.prior_action_recency(user_emails(spark, d), ["date_sent", "activity_id"]).drop("user_id", "email_id", "date_sent", "n_actions_24h", "actioned_24h")


def _days(c, k):
    return f"coalesce((SELECT sum({c}) FROM daily x WHERE x.user_id = r.user_id AND x.day BETWEEN r.day - {k} AND r.day - 1), 0)"


_RATES = {f"{name}_rate_{k}d": f"round({_days(c, k)} / ({_days('n_sends', k)} + 1e-9), 6)" for name, c in (("action", "n_act"), ("open", "n_opens"), ("click", "n_clicks")) for k in (7, 30, 90)}
_SINCE = {f"days_since_last_{n}": f"coalesce(day - (SELECT max(day) FROM daily x WHERE x.user_id = r.user_id AND x.day < r.day AND {c} > 0), 999)" for n, c in (("open", "n_opens"), ("click", "n_clicks"))}


@query("D09_rfm", f"""{_UE}, ev AS (SELECT user_id, CAST(date_sent AS DATE) AS day, actioned_24h::INT AS n_act, 1 AS n_sends, 0 AS n_opens, 0 AS n_clicks FROM ue
    UNION ALL SELECT user_id, CAST(created_at AS DATE), 0, 0, (action_type = 'open')::INT, (action_type = 'click')::INT FROM act WHERE action_type IN ('open', 'click')),
    daily AS (SELECT user_id, day, sum(n_act) AS n_act, sum(n_sends) AS n_sends, sum(n_opens) AS n_opens, sum(n_clicks) AS n_clicks FROM ev GROUP BY ALL),
    r AS (SELECT *, CAST(date_sent AS DATE) AS day, coalesce(sum(actioned_24h::INT) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior,
      max(CASE WHEN actioned_24h THEN CAST(date_sent AS DATE) END) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS acted, min(CAST(date_sent AS DATE)) OVER (PARTITION BY user_id) AS first FROM ue)
    SELECT activity_id, user_id, email_id, date_sent, actioned_24h, {', '.join(f'{v} AS {k}' for k, v in (_RATES | _SINCE).items())}, CAST({_days('n_sends', 30)} AS BIGINT) AS sends_last_30d, round(ln(1 + prior), 6) AS log1p_prior_action_count,
      coalesce(day - acted, 999) AS days_since_last_action, day - first AS tenure_days, CASE WHEN day - first <= 7 THEN '0-7d' WHEN day - first <= 30 THEN '8-30d' ELSE '31-90d' END AS tenure_bucket FROM r""")  # fmt: skip
def d09(spark, d):
    out = X.rfm(user_emails(spark, d), activities(spark, d))
    long = ["sends_last_30d", "days_since_last_action", "days_since_last_open", "days_since_last_click", "tenure_days"]
    return out.select("activity_id", "user_id", "email_id", "date_sent", "actioned_24h", *[F.round(c, 6).alias(c) for c in (*_RATES, "log1p_prior_action_count")], *[F.col(c).cast("long").alias(c) for c in long], "tenure_bucket")


@query("D10_leak_audit", f"""{_UE}, s AS (SELECT *, ln(1 + coalesce(sum(actioned_24h::INT) OVER (PARTITION BY user_id ORDER BY date_sent {_CONF}), 0)) AS e,
      (coalesce(sum(actioned_24h::INT) OVER (PARTITION BY email_id ORDER BY date_sent {_CONF}), 0) + 1) / (count(*) OVER (PARTITION BY email_id ORDER BY date_sent {_CONF}) + 2) AS p FROM ue),
    pu AS (SELECT a.activity_id, sum(b.actioned_24h::INT) AS n FROM ue a JOIN ue b ON a.user_id = b.user_id AND b.date_sent < a.date_sent GROUP BY 1),
    pe AS (SELECT a.activity_id, sum(b.actioned_24h::INT) AS n, count(*) AS c FROM ue a JOIN ue b ON a.email_id = b.email_id AND b.date_sent < a.date_sent GROUP BY 1)
    SELECT count(*) AS n_checked, round(max(greatest(abs(e - ln(1 + coalesce(pu.n, 0))), abs(p - (coalesce(pe.n, 0) + 1) / (coalesce(pe.c, 0) + 2)))), 9) AS max_diff FROM s LEFT JOIN pu USING (activity_id) LEFT JOIN pe USING (activity_id)""")  # fmt: skip
def d10(spark, d):
    return X.leak_audit(X.confound_scores(user_emails(spark, d)), "date_sent").withColumn("max_diff", F.round("max_diff", 9))


@query("D11_hazard_curve", f"""{_UE}, e AS ({_EPOCH}), g AS (SELECT row_number() OVER (PARTITION BY user_id, ep ORDER BY date_sent, activity_id) - 1 AS lag, actioned_24h FROM e), h AS (SELECT lag, avg(actioned_24h::INT) AS hazard, count(*) AS n FROM g GROUP BY 1)
    SELECT range AS sends_since_last_action, round(hazard, 6) AS hazard, coalesce(n, 0) AS n FROM range(0, 61) LEFT JOIN h ON range = lag""")  # fmt: skip
def d11(spark, d):
    return X.hazard_curve(user_emails(spark, d)).withColumn("hazard", F.round("hazard", 6))


@query("D12_competing_risks", f"""{_UE}, st AS (SELECT user_id, count(*) AS send_count, avg(actioned_24h::INT) AS action_rate, bool_or(email_id % 17 = 0) AS ever_unsubbed FROM ue GROUP BY 1),
    q AS (SELECT quantile_cont(send_count, 0.3333) AS a, quantile_cont(send_count, 0.6667) AS b, quantile_cont(action_rate, 0.3333) AS c, quantile_cont(action_rate, 0.6667) AS e FROM st),
    z AS (SELECT CASE WHEN send_count <= a THEN 'low' WHEN send_count <= b THEN 'mid' ELSE 'high' END AS send_count_band, CASE WHEN action_rate <= c THEN 'low' WHEN action_rate <= e THEN 'mid' ELSE 'high' END AS action_rate_band, ever_unsubbed FROM st, q),
    g AS (SELECT send_count_band, action_rate_band, count(*) AS n, avg(ever_unsubbed::INT) AS u FROM z GROUP BY ALL)
    SELECT s.b AS send_count_band, r.b AS action_rate_band, coalesce(n, 0) AS n, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (), 6) AS share, round(u, 6) AS unsub_rate
    FROM (VALUES ('low'), ('mid'), ('high')) s(b) CROSS JOIN (VALUES ('low'), ('mid'), ('high')) r(b) LEFT JOIN g ON g.send_count_band = s.b AND g.action_rate_band = r.b""")  # fmt: skip
def d12(spark, d):
    ue = user_emails(spark, d).select("user_id", "date_sent", F.col("actioned_24h").alias("actioned"), (F.col("email_id") % 17 == 0).alias("unsubscribed"))
    out = X.risk_crosstab(X.user_risk_stats(ue), "send_count", "action_rate")
    return out.withColumns({"share": F.round("share", 6), "unsub_rate": F.round("unsub_rate", 6)})


@query("D13_rate_sanity", f"""{_TOTALS}, q AS (SELECT quantile_cont(total_sent, [0.2, 0.4, 0.6, 0.8]) AS q FROM tot)
    SELECT (total_sent > q[1])::INT + (total_sent > q[2])::INT + (total_sent > q[3])::INT + (total_sent > q[4])::INT AS bucket, count(*) AS n, round(median(CASE WHEN total_sent > 0 THEN total_opens / total_sent END), 6) AS open_rate, round(median(CASE WHEN total_sent > 0 THEN total_clicks / total_sent END), 6) AS click_rate,
      count(*) FILTER (total_clicks > total_opens) AS clicks_gt_opens, count(*) FILTER (total_actions = 0) AS zero_actions FROM tot, q GROUP BY 1""")  # fmt: skip
def d13(spark, d):
    from ..operators.buckets import quantile_bucket, quantiles_of

    r = persist_shared(quantile_bucket(persist_shared(rates(email_totals(activities(spark, d), attributed(spark, d))), "email-rates"), "total_sent", 5, "bucket"), "email-buckets")
    out = r.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("total_clicks") > F.col("total_opens")).alias("clicks_gt_opens"), F.count_if(F.col("total_actions") == 0).alias("zero_actions"))
    medians = quantiles_of(r, ["open_rate", "click_rate"], 0.5, ["bucket"])
    return out.join(medians, "bucket", "left").withColumns({c: F.round(c, 6) for c in ("open_rate", "click_rate")})
