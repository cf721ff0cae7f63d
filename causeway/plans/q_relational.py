"""Queries: scans, projections, filters, joins, sorting, limits, sets."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.times import DAY, day_number, seconds_between
from ..operators.asof import asof_backward
from ..operators.joins import attach_marker, co_occurrence, duplicate_keys, left_with_domain
from ..operators.ranking import with_row_number
from ..operators.topk import last_per, ranked, retention_set, threshold_top_k, top_k_per
from ..operators.windows import is_first, last_row_wins
from ..sources.catalog import Accessor, row_fingerprint, table_stats
from ..sources.ledger import missing_pairs
from ..sources.paged import register_paged_documents, write_pages
from ..sources.remote import Documents, month_windows, union_windows
from ..sources.shared import shared_dir
from .registry import query, table
from .roles import ACT, SENDS, SIGN, actions, activities, sends


@query("S01_scan_pruned", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def s01(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")


@query("S10_month_chunks", """SELECT o_orderkey, CASE WHEN o_orderdate >= '2001-07-01' THEN 0 WHEN o_orderdate >= '2001-06-01' THEN 1 ELSE 2 END AS chunk
    FROM orders WHERE o_orderdate >= '2001-05-01' AND o_orderdate < '2001-08-01'""")  # fmt: skip
def s10(spark, d):
    return union_windows(table(spark, d, "orders"), "o_orderdate", month_windows(date(2001, 8, 1), 3)).select("o_orderkey", "chunk")


def _collection(spark, d):
    """The documents written to a store of pages, as a client reads it."""
    docs, path = table(spark, d, "documents"), f"{shared_dir(spark)}/documents-{uuid.uuid4().hex}"
    register_paged_documents(spark)
    write_pages(docs, path, ["lang", "n_chars"], ["lang", "n_chars"], 500)
    return Documents(spark.read.format("paged_documents").schema(docs.schema).load(path))


@query("S11_document_find", "SELECT doc_id, source FROM documents WHERE lang = 'en' AND n_chars > 500 ORDER BY n_chars DESC, doc_id LIMIT 50")
def s11(spark, d):
    return _collection(spark, d).find("lang = 'en' and n_chars > 500", ["doc_id", "source"], [F.col("n_chars").desc(), "doc_id"], 50)


@query("S11_document_aggregate", "SELECT source, count(*) AS n, max(n_chars) AS longest FROM documents GROUP BY source")
def s11b(spark, d):
    return _collection(spark, d).aggregate(["source"], n=F.count(F.lit(1)), longest=F.max("n_chars"))


@query("S17_row_fingerprint")
def s17(spark, d):
    return row_fingerprint(table(spark, d, "orders"))


@query("S18_table_stats", """SELECT count(*) AS n_rows, CAST(min(o_orderdate) AS VARCHAR) AS first, CAST(max(o_orderdate) AS VARCHAR) AS last,
    round(sum(o_totalprice), 2) AS outcome_sum FROM orders""")  # fmt: skip
def s18(spark, d):
    s = table_stats(table(spark, d, "orders"), "o_orderdate", "o_totalprice")
    return s.select("n_rows", F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"), F.round("outcome_sum", 2).alias("outcome_sum"))


# Projections and predicates


@query("P01_select_cast", "SELECT CAST(c_custkey AS VARCHAR) AS customer, c_mktsegment AS segment, CAST(c_acctbal AS DOUBLE) AS balance, 'x' AS origin FROM customer")
def p01(spark, d):
    c = table(spark, d, "customer").withColumnRenamed("c_mktsegment", "segment").drop("c_name", "not_there")
    return c.select(F.col("c_custkey").cast("string").alias("customer"), "segment", F.col("c_acctbal").cast("double").alias("balance"), F.lit("x").alias("origin"))


@query("P02_filter_conjunction", f"WITH {ACT} SELECT activity_id FROM act WHERE action_type = 'click' AND value IS NOT NULL AND value > 10")
def p02(spark, d):
    return activities(spark, d).where("action_type = 'click' and value is not null and value > 10").select("activity_id")


@query("P03_is_in", "SELECT p_partkey FROM part WHERE p_size IN (1, 4, 9, 16, 25)")
def p03(spark, d):
    return table(spark, d, "part").where(F.col("p_size").isin(1, 4, 9, 16, 25)).select("p_partkey")


@query("P04_between", "SELECT event_id FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'")
def p04(spark, d):
    return table(spark, d, "events").where(F.col("ts").cast("date").between(F.lit("2024-01-05").cast("date"), F.lit("2024-01-12").cast("date"))).select("event_id")


@query("P05_by_date_range", "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-06-30'")
def p05(spark, d):
    return Accessor(table(spark, d, "orders"), "o_orderkey", "o_orderdate").by_date_range("1997-01-01", "1997-06-30").select("o_orderkey")


@query("P06_when_chain", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN 'none' WHEN l_discount <= 0.05 THEN 'low' ELSE 'high' END AS band FROM lineitem")
def p06(spark, d):
    band = F.when(F.col("l_discount") == 0, "none").when(F.col("l_discount") <= 0.05, "low").otherwise("high")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", band.alias("band"))


@query("P07_null_out_group", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN l_tax END AS tax, CASE WHEN l_quantity > 25 THEN l_shipdate END AS shipped FROM lineitem")
def p07(spark, d):
    kept = F.when(F.col("l_quantity") > 25, F.struct(F.col("l_tax").alias("tax"), F.col("l_shipdate").alias("shipped")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", kept.alias("k")).select("l_orderkey", "l_linenumber", "k.*")


@query("P08_fill_null", """SELECT d.doc_id, coalesce(quality, -1) AS quality, coalesce(toxic = 1, false) AS toxic FROM documents d LEFT JOIN labels USING (doc_id)""")
def p08(spark, d):
    j = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return j.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"))


_EMAILS = f"""{ACT}, em AS (SELECT email_id, count(*) FILTER (action_type = 'sent') AS sent, count(*) FILTER (action_type = 'open') AS opens,
    count(*) FILTER (action_type = 'click') AS clicks, count(*) FILTER (action_type = 'signature') AS acts, min(created_at) AS first_at FROM act GROUP BY email_id)"""


def _emails(spark, d):
    kinds = {"sent": "sent", "opens": "open", "clicks": "click", "acts": "signature"}
    return activities(spark, d).groupBy("email_id").agg(*[F.count_if(F.col("action_type") == v).alias(k) for k, v in kinds.items()], F.min("created_at").alias("first_at"))


@query("P09_safe_ratio", f"WITH {_EMAILS} SELECT email_id, CASE WHEN sent > 0 THEN opens / sent END AS open_rate, CASE WHEN opens > 0 THEN clicks / opens END AS click_per_open FROM em")
def p09(spark, d):
    return _emails(spark, d).select("email_id", F.try_divide("opens", "sent").alias("open_rate"), F.try_divide("clicks", "opens").alias("click_per_open"))


@query("P10_epsilon_ratio", f"WITH {_EMAILS} SELECT email_id, round(opens / (sent + 1e-9), 6) AS eps, clicks / greatest(opens, 1) AS floored FROM em")
def p10(spark, d):
    return _emails(spark, d).select("email_id", F.round(F.col("opens") / (F.col("sent") + 1e-9), 6).alias("eps"), (F.col("clicks") / F.greatest("opens", F.lit(1))).alias("floored"))


@query("P11_horizontal", "SELECT l_orderkey, l_linenumber, least(l_quantity, l_tax * 100) AS low, greatest(l_quantity, l_tax * 100) AS high FROM lineitem")
def p11(spark, d):
    a, b = F.col("l_quantity"), F.col("l_tax") * 100
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))


@query("P13_in_range_flags", f"""WITH {_EMAILS} SELECT email_id, coalesce(sent > 0 AND opens <= sent AND (sent - opens) / sent < 0.25, false) AS sent_in_range,
    coalesce((clicks = 0 AND acts = 0) OR clicks <= acts, false) AS clicks_in_range FROM em""")  # fmt: skip
def p13(spark, d):
    from .emails import in_range, sent_in_range

    return _emails(spark, d).select("email_id", sent_in_range("opens", "sent").alias("sent_in_range"), in_range("clicks", "acts").alias("clicks_in_range"))


@query("P14_tail_cut", "SELECT event_id FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def p14(spark, d):
    e = table(spark, d, "events")
    end = e.agg((F.max("ts") - F.expr("interval 24 hours")).alias("end"))
    return e.join(F.broadcast(end), e["ts"] < end["end"]).select("event_id")  # one row


@query("P15_zero_to_null", f"WITH {_EMAILS} SELECT email_id, CASE WHEN acts = 0 THEN NULL ELSE clicks END AS total_vo FROM em")
def p15(spark, d):
    return _emails(spark, d).select("email_id", F.when(F.col("acts") != 0, F.col("clicks")).alias("total_vo"))


@query("P16_drop_null_rows", "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def p16(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").dropna(subset=["quality", "toxic"]).select("doc_id")


@query("P17_null_key_gate", """SELECT count(*) AS n_rows, count(*) FILTER (quality IS NULL) + count(*) FILTER (toxic IS NULL) AS null_cells,
    count(*) FILTER (quality IS NULL OR toxic IS NULL) AS null_rows FROM documents LEFT JOIN labels USING (doc_id)""")  # fmt: skip
def p17(spark, d):
    from .gates import null_key_counts

    return null_key_counts(table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left"), ["quality", "toxic"])


# Joins


@query("J01_left_join", "SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def j01(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer").where("c_acctbal > 0")
    return o.join(c, o["o_custkey"] == c["c_custkey"], "left").select("o_orderkey", "c_mktsegment")


@query("J02_inner_join", "SELECT l_orderkey, l_linenumber, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'")
def j02(spark, d):
    l, o = table(spark, d, "lineitem").where("l_returnflag = 'R'"), table(spark, d, "orders")
    return l.join(o, l["l_orderkey"] == o["o_orderkey"]).select("l_orderkey", "l_linenumber", "o_orderdate")


@query("J03_dimension_lookup", """SELECT r_name, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")  # fmt: skip
def j03(spark, d):
    l, s, n, r = (table(spark, d, t) for t in ("lineitem", "supplier", "nation", "region"))
    # Pre-aggregated by supplier before the lookups; small dimensions are broadcast by Spark's own size check.
    by = l.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("price"))
    j = by.join(s, by["l_suppkey"] == s["s_suppkey"]).join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return j.groupBy("r_name").agg(F.sum("n").alias("n"), F.round(F.sum("price"), 2).alias("price"))


@query("J04_asof_backward", f"""WITH {ACT}, {SIGN}, s AS (SELECT user_id, email_id, created_at AS send_time FROM act WHERE action_type = 'sent')
    SELECT signature_id, email_id, send_time FROM sign ASOF LEFT JOIN s ON sign.user_id = s.user_id AND sign.created_at >= s.send_time""")  # fmt: skip
def j04(spark, d):
    out = asof_backward(actions(spark, d), sends(spark, d), ["user_id"], "created_at", "send_time", ["email_id", "send_time"], tie_break="activity_id")
    return out.select("signature_id", "email_id", "send_time")


def _tolerance(hours, kind):
    return f"""WITH {ACT}, s AS (SELECT user_id, email_id, created_at AS send_time FROM act WHERE action_type = 'sent'),
        j AS (SELECT activity_id, a.created_at, s.email_id, send_time FROM act a ASOF LEFT JOIN s ON a.user_id = s.user_id AND a.created_at >= s.send_time WHERE action_type = '{kind}')
        SELECT activity_id, CASE WHEN created_at - send_time <= INTERVAL {hours} HOUR THEN email_id END AS email_id FROM j"""


@query("J05_asof_24h", _tolerance(24, "signature"))
def j05(spark, d):
    left = activities(spark, d).where("action_type = 'signature'").drop("email_id")
    return asof_backward(left, sends(spark, d), ["user_id"], "created_at", "send_time", ["email_id"], "activity_id", tolerance=DAY).select("activity_id", "email_id")


@query("J06_asof_7d", _tolerance(168, "unsubscribe"))
def j06(spark, d):
    left = activities(spark, d).where("action_type = 'unsubscribe'").drop("email_id")
    return asof_backward(left, sends(spark, d), ["user_id"], "created_at", "send_time", ["email_id"], "activity_id", tolerance=7 * DAY).select("activity_id", "email_id")


@query("J07_asof_cumulative", f"""WITH {ACT}, o AS (SELECT user_id, CAST(created_at AS DATE) AS day, count(*) AS n FROM act WHERE action_type = 'open' GROUP BY ALL),
    c AS (SELECT user_id, day, sum(n) OVER (PARTITION BY user_id ORDER BY day) AS total FROM o), s AS (SELECT activity_id, user_id, CAST(created_at AS DATE) - 7 AS day FROM act WHERE action_type = 'sent')
    SELECT activity_id, CAST(coalesce(total, 0) AS BIGINT) AS opens_by_then FROM s ASOF LEFT JOIN c ON s.user_id = c.user_id AND s.day >= c.day""")  # fmt: skip
def j07(spark, d):
    a = activities(spark, d).withColumn("day", day_number(F.col("created_at")))
    daily = a.where("action_type = 'open'").groupBy("user_id", "day").count()
    total = daily.withColumn("total", F.sum("count").over(Window.partitionBy("user_id").orderBy("day")))
    s = a.where("action_type = 'sent'").select("activity_id", "user_id", (F.col("day") - 7).alias("day"))
    return asof_backward(s, total, ["user_id"], "day", "day", ["total"]).select("activity_id", F.coalesce("total", F.lit(0)).alias("opens_by_then"))


@query("J08_asof_strict", f"""WITH {ACT}, o AS (SELECT DISTINCT user_id, CAST(created_at AS DATE) AS day FROM act WHERE action_type = 'open'),
    s AS (SELECT activity_id, user_id, CAST(created_at AS DATE) AS day FROM act WHERE action_type = 'sent')
    SELECT activity_id, CAST(o.day AS VARCHAR) AS last_open FROM s ASOF LEFT JOIN o ON s.user_id = o.user_id AND s.day > o.day""")  # fmt: skip
def j08(spark, d):
    a = activities(spark, d).withColumn("day", F.col("created_at").cast("date"))
    opens = a.where("action_type = 'open'").select("user_id", F.col("day").alias("last_open")).distinct()
    out = asof_backward(a.where("action_type = 'sent'").select("activity_id", "user_id", "day"), opens, ["user_id"], "day", "last_open", ["last_open"], strict=True)
    return out.select("activity_id", F.col("last_open").cast("string").alias("last_open"))


@query("J09_co_occurrence", f"""WITH {ACT}, pairs AS (SELECT DISTINCT email_id, user_id FROM act WHERE email_id IS NOT NULL)
    SELECT b.email_id, count(*) AS shared FROM pairs a JOIN pairs b ON a.user_id = b.user_id AND b.email_id <> a.email_id WHERE a.email_id = 7 GROUP BY b.email_id HAVING count(*) >= 3""")  # fmt: skip
def j09(spark, d):
    return co_occurrence(activities(spark, d), "email_id", ["user_id"], 7, 3)


@query("J10_enrich_with_marker", """SELECT d.doc_id, l.doc_id IS NOT NULL AS matched, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def j10(spark, d):
    return attach_marker(table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"], "matched").select("doc_id", "matched", "quality")


@query("J11_semi_join", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def j11(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    return o.join(c, o["o_custkey"] == c["c_custkey"], "left_semi").select("o_orderkey")


@query("J12_marker_flags", f"""WITH {ACT} SELECT user_id, email_id, coalesce(bool_or(action_type = 'open'), false) AS opened, coalesce(bool_or(action_type = 'click'), false) AS clicked,
    coalesce(bool_or(action_type = 'signature'), false) AS signed FROM act GROUP BY user_id, email_id""")  # fmt: skip
def j12(spark, d):
    kinds = {"opened": "open", "clicked": "click", "signed": "signature"}
    return activities(spark, d).groupBy("user_id", "email_id").agg(*[F.coalesce(F.bool_or(F.col("action_type") == v), F.lit(False)).alias(k) for k, v in kinds.items()])


@query("J13_dense_domain", """SELECT lag, coalesce(n, 0) AS n FROM (SELECT range AS lag FROM range(0, 61)) LEFT JOIN
    (SELECT l_linenumber * 7 AS lag, count(*) AS n FROM lineitem GROUP BY 1) USING (lag)""")  # fmt: skip
def j13(spark, d):
    seen = table(spark, d, "lineitem").groupBy((F.col("l_linenumber") * 7).cast("long").alias("lag")).agg(F.count(F.lit(1)).alias("n"))
    return left_with_domain(seen, "lag", 0, 61, {"n": 0})


@query("J14_both_endpoints", """SELECT a.s_name AS src, b.s_name AS dst FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey""")
def j14(spark, d):
    s = table(spark, d, "supplier")
    edges = s.select(F.col("s_suppkey").alias("a"), "s_nationkey").join(s.select(F.col("s_suppkey").alias("b"), "s_nationkey"), "s_nationkey").where("a < b")
    names = s.select("s_suppkey", "s_name")
    out = edges.join(names.withColumnsRenamed({"s_suppkey": "a", "s_name": "src"}), "a").join(names.withColumnsRenamed({"s_suppkey": "b", "s_name": "dst"}), "b")
    return out.select("src", "dst")


@query("J15_join_integrity", """SELECT count(*) AS n_rows, count(DISTINCT (user_id, event_type)) AS n_keys, count(*) - count(DISTINCT (user_id, event_type)) AS n_surplus FROM events""")
def j15(spark, d):
    return duplicate_keys(table(spark, d, "events"), ["user_id", "event_type"])


@query("J16_in_subquery", """WITH big AS (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 200000)
    SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM big)""")  # fmt: skip
def j16(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_totalprice > 200000")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi").select("c_custkey", "c_name")


@query("J17_ledger_pairing", """SELECT o_orderkey, f.k IS NULL AS missing_finished, l.k IS NULL AS missing_lines FROM orders
    LEFT JOIN (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F') f ON o_orderkey = f.k
    LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) l ON o_orderkey = l.k WHERE f.k IS NULL OR l.k IS NULL""")  # fmt: skip
def j17(spark, d):
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return missing_pairs(o, {"finished": o.where("o_orderstatus = 'F'"), "lines": l}, ["o_orderkey"])


@query("J18_metadata_in_hit_order", """SELECT o_orderkey, place, c_name FROM (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders)
    JOIN customer ON o_custkey = c_custkey WHERE place <= 20""")  # fmt: skip
def j18(spark, d):
    hits = ranked(table(spark, d, "orders"), [F.col("o_totalprice").desc(), "o_orderkey"], 20, "place")
    c = table(spark, d, "customer")
    return hits.join(c, hits["o_custkey"] == c["c_custkey"], "left").select("o_orderkey", "place", "c_name")


# Sorting, limits, samples


@query("K01_multi_sort", "SELECT p_partkey, p_brand, p_size FROM part ORDER BY p_brand, p_size DESC, p_partkey")
def k01(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_brand", "p_size").orderBy(F.col("p_brand").asc_nulls_last(), F.col("p_size").desc_nulls_last(), "p_partkey")


@query("K02_smoke_test", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 100")
def k02(spark, d):
    return Accessor(table(spark, d, "orders"), "o_orderkey", "o_orderdate").smoke_test()


@query("K03_threshold_top_k", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def k03(spark, d):
    return threshold_top_k(table(spark, d, "orders"), "o_totalprice", 100000.0, 25, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("K04_top_k_per_query", """SELECT o_custkey, o_orderkey, place FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders)
    WHERE place <= 3""")  # fmt: skip
def k04(spark, d):
    return top_k_per(table(spark, d, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), "o_orderkey"], 3, "place").select("o_custkey", "o_orderkey", "place")


@query("K05_top_bottom_rates", f"""WITH {_EMAILS}, r AS (SELECT email_id, opens / sent AS rate FROM em WHERE sent >= 5)
    SELECT * FROM (SELECT 'top' AS side, email_id, rate FROM r ORDER BY rate DESC, email_id LIMIT 10) UNION ALL SELECT * FROM (SELECT 'bottom', email_id, rate FROM r ORDER BY rate, email_id LIMIT 10)""")  # fmt: skip
def k05(spark, d):
    r = _emails(spark, d).where("sent >= 5").select("email_id", (F.col("opens") / F.col("sent")).alias("rate"))
    top = r.orderBy(F.col("rate").desc(), "email_id").limit(10).withColumn("side", F.lit("top"))
    return top.unionByName(r.orderBy("rate", "email_id").limit(10).withColumn("side", F.lit("bottom")))


@query("K06_exact_sample", "SELECT o_orderkey FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 500")
def k06(spark, d):
    return Accessor(table(spark, d, "orders"), "o_orderkey", "o_orderdate").sample_rows(500).select("o_orderkey")


@query("K07_user_sample", "SELECT event_id, user_id FROM events WHERE user_id % 100 < 10")
def k07(spark, d):
    return Accessor(table(spark, d, "events"), "user_id", "ts").sample_keys("user_id", 10).select("event_id", "user_id")


@query("K08_pop_best", "SELECT event_id, value FROM events WHERE event_type = 'view' ORDER BY value DESC, event_id LIMIT 1")
def k08(spark, d):
    return table(spark, d, "events").where("event_type = 'view'").orderBy(F.col("value").desc(), "event_id").limit(1).select("event_id", "value")


@query("K09_leaderboard", """SELECT o_clerk_run AS run, metric, row_number() OVER (ORDER BY metric DESC, o_clerk_run) AS place, metric - max(metric) OVER () AS lift FROM
    (SELECT o_custkey AS o_clerk_run, round(avg(o_totalprice), 6) AS metric FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY o_custkey) ORDER BY metric DESC, run LIMIT 20""")  # fmt: skip
def k09(spark, d):
    from .ledger_queries import leaderboard

    runs = table(spark, d, "orders").where("o_orderpriority like '1%'").groupBy(F.col("o_custkey").alias("run")).agg(F.round(F.avg("o_totalprice"), 6).alias("metric"))
    return leaderboard(runs, "run", "metric", 20)


@query("K10_retention", """WITH r AS (SELECT p_brand AS grp, p_partkey AS run, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place FROM part)
    SELECT grp, run, place <= 3 OR run = 7 AS kept FROM r""")  # fmt: skip
def k10(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("run"), F.col("p_retailprice").alias("metric"))
    return retention_set(p, "grp", "run", "metric", 3, [7])


@query("K11_spread_folds", "SELECT fold FROM (SELECT DISTINCT year(o_orderdate) AS fold FROM orders) WHERE (fold - 1995) % 3 = 0")
def k11(spark, d):
    folds = table(spark, d, "orders").select(F.year("o_orderdate").alias("fold")).distinct()
    return last_per(folds, "fold", 3)


# Sets


@query("U01_union", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def u01(spark, d):
    return table(spark, d, "nation").select(F.col("n_name").alias("name")).union(table(spark, d, "region").select("r_name"))


@query("U02_union_relaxed", "SELECT CAST(n_nationkey AS DOUBLE) AS x FROM nation UNION ALL SELECT s_acctbal FROM supplier")
def u02(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("double").alias("x")).unionByName(table(spark, d, "supplier").select(F.col("s_acctbal").alias("x")))


@query("U03_union_diagonal", "SELECT n_name, n_nationkey, NULL::VARCHAR AS r_name FROM nation UNION ALL SELECT NULL, NULL, r_name FROM region")
def u03(spark, d):
    return table(spark, d, "nation").select("n_name", "n_nationkey").unionByName(table(spark, d, "region").select("r_name"), allowMissingColumns=True)


@query("U04_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def u04(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query("U05_first_per_key", "SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS n FROM lineitem) WHERE n = 1")
def u05(spark, d):
    return top_k_per(table(spark, d, "lineitem"), ["l_orderkey"], [F.col("l_extendedprice").desc(), "l_linenumber", "l_partkey"], 1, "n").select("l_orderkey", "l_linenumber")


@query("U06_intersect_except", "(SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders) EXCEPT SELECT s_suppkey FROM supplier")
def u06(spark, d):
    c, o, s = table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select("o_custkey"), table(spark, d, "supplier").select("s_suppkey")
    return c.intersect(o).subtract(s)
