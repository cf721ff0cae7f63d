"""Queries: aggregations and buckets."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.times import month_label, quarter_label
from ..operators import aggregates as A
from ..operators import buckets as B
from .emails import email_totals, most_unusual, rates
from .ledger_queries import cost_sums
from .registry import query, table
from .roles import ACT, SIGN, actions, activities


def _lines(spark, d):
    return table(spark, d, "lineitem")


def _orders(spark, d):
    return table(spark, d, "orders")


@query("A01_group_stats", """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS total, round(avg(l_extendedprice), 4) AS mean, min(l_discount) AS low, max(l_discount) AS high
    FROM lineitem GROUP BY ALL""")  # fmt: skip
def a01(spark, d):
    return _lines(spark, d).groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"), F.round(F.avg("l_extendedprice"), 4).alias("mean"), F.min("l_discount").alias("low"), F.max("l_discount").alias("high"))


@query("A02_global_stats", "SELECT min(o_orderkey) AS low, max(o_orderkey) AS high, count(*) AS n FROM orders")
def a02(spark, d):
    return _orders(spark, d).agg(F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"), F.count(F.lit(1)).alias("n"))


@query("A03_conditional_distinct", f"""WITH {ACT} SELECT email_id, count(DISTINCT user_id) FILTER (action_type = 'sent') AS total_sent, count(DISTINCT user_id) FILTER (action_type = 'open') AS total_opens,
    count(DISTINCT user_id) FILTER (action_type = 'click') AS total_clicks FROM act WHERE user_id IS NOT NULL GROUP BY email_id""")  # fmt: skip
def a03(spark, d):
    from .attribution import attribute
    from .roles import sends

    a = activities(spark, d)
    return email_totals(a, attribute(actions(spark, d), sends(spark, d))).drop("total_actions")


@query("A04_filtered_count", f"WITH {ACT} SELECT email_id, count(*) FILTER (action_type = 'signature') AS n_signed FROM act GROUP BY email_id")
def a04(spark, d):
    return activities(spark, d).groupBy("email_id").agg(F.count_if(F.col("action_type") == "signature").alias("n_signed"))


@query("A05_pair_flags", f"""WITH {ACT} SELECT user_id, email_id, min(CASE WHEN action_type = 'sent' THEN created_at END) AS date_sent, coalesce(bool_or(action_type = 'open'), false) AS opened
    FROM act GROUP BY user_id, email_id""")  # fmt: skip
def a05(spark, d):
    sent = F.col("action_type") == "sent"
    return activities(spark, d).groupBy("user_id", "email_id").agg(F.min(F.when(sent, F.col("created_at"))).alias("date_sent"), F.coalesce(F.bool_or(F.col("action_type") == "open"), F.lit(False)).alias("opened"))


@query("A06_rollup", """SELECT s_nationkey, coalesce(sum(s_acctbal), 0) > 0 AS positive, round(avg(s_acctbal), 4) AS mean, min(s_acctbal) AS low, count(DISTINCT s_suppkey % 7) FILTER (s_acctbal > 0) AS n_kinds,
    avg(CASE WHEN s_acctbal > 0 THEN 1.0 ELSE 0.0 END) AS share_positive, list_sort(list(DISTINCT s_suppkey % 7)) AS kinds, count(*) AS n FROM supplier GROUP BY s_nationkey""")  # fmt: skip
def a06(spark, d):
    kind = F.col("s_suppkey") % 7
    return table(spark, d, "supplier").groupBy("s_nationkey").agg(
        (F.coalesce(F.sum("s_acctbal"), F.lit(0)) > 0).alias("positive"), F.round(F.avg("s_acctbal"), 4).alias("mean"), F.min("s_acctbal").alias("low"),
        F.count_distinct(F.when(F.col("s_acctbal") > 0, kind)).alias("n_kinds"), F.avg((F.col("s_acctbal") > 0).cast("double")).alias("share_positive"), F.array_sort(F.collect_set(kind)).alias("kinds"), F.count(F.lit(1)).alias("n"))


@query("A07_distinct_structs", "SELECT count(DISTINCT (l_partkey, l_suppkey)) AS pairs, count(DISTINCT l_partkey) AS parts FROM lineitem")
def a07(spark, d):
    return _lines(spark, d).agg(F.count_distinct(F.struct("l_partkey", "l_suppkey")).alias("pairs"), F.count_distinct("l_partkey").alias("parts"))


@query("A08_value_counts", """WITH c AS (SELECT source AS value, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source)
    SELECT value, n, n / (SELECT sum(n) FROM c) AS share, (SELECT count(*) FROM c) AS cardinality FROM c ORDER BY n DESC, value LIMIT 10""")  # fmt: skip
def a08(spark, d):
    return A.value_counts(table(spark, d, "documents"), "source", 10)


@query("A09_quantiles_linear", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 6) AS q0, round(quantile_cont(l_extendedprice, 0.5), 6) AS q1, round(quantile_cont(l_extendedprice, 0.9), 6) AS q2 FROM lineitem GROUP BY 1")
def a09(spark, d):
    return B.quantile_cuts(_lines(spark, d), "l_extendedprice", [0.25, 0.5, 0.9], ["l_returnflag"]).withColumns({f"q{i}": F.round(f"q{i}", 6) for i in range(3)})


@query("A09_quantiles_nearest", """WITH r AS (SELECT l_returnflag, l_extendedprice AS value, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS pos, count(*) OVER (PARTITION BY l_returnflag) AS n
    FROM lineitem) SELECT l_returnflag, CAST(share AS DOUBLE) AS share, value FROM r, (SELECT unnest([0.25::DOUBLE, 0.5::DOUBLE, 0.99::DOUBLE]) AS share) WHERE pos = round_even(share * (n - 1), 0)""")  # fmt: skip
def a09b(spark, d):
    return B.nearest_quantile(_lines(spark, d), "l_extendedprice", [0.25, 0.5, 0.99], ["l_returnflag"])


@query("A10_median_by_month", "SELECT strftime(o_orderdate, '%Y-%m') AS month, median(o_totalprice) AS mid FROM orders GROUP BY 1")
def a10(spark, d):
    o = _orders(spark, d).select(month_label(F.col("o_orderdate")).alias("month"), "o_totalprice")
    return B.quantile_cuts(o, "o_totalprice", [0.5], ["month"]).withColumnRenamed("q0", "mid")


@query("A11_spread", "SELECT c_mktsegment, round(var_pop(c_acctbal), 4) AS v0, round(stddev_samp(c_acctbal), 6) AS s1, round(stddev_pop(c_acctbal), 6) AS s0 FROM customer GROUP BY 1")
def a11(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.round(F.var_pop("c_acctbal"), 4).alias("v0"), F.round(F.stddev_samp("c_acctbal"), 6).alias("s1"), F.round(F.stddev_pop("c_acctbal"), 6).alias("s0"))


@query("A12_moment_skew", "WITH m AS (SELECT avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM lineitem) SELECT round(avg(power((l_extendedprice - m) / (s + 1e-9), 3)), 6) AS skew FROM lineitem, m")
def a12(spark, d):
    return A.moment_skew(_lines(spark, d), "l_extendedprice").select(F.round("skew", 6).alias("skew"))


@query("A13_correlations", """SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) FROM lineitem
    UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) FROM lineitem""")  # fmt: skip
def a13(spark, d):
    return A.correlations(_lines(spark, d), ["l_quantity", "l_extendedprice", "l_discount"]).withColumn("r", F.round("r", 6))


@query("A14_spearman_ordinal", """WITH r AS (SELECT row_number() OVER (ORDER BY n_chars, doc_id) AS a, row_number() OVER (ORDER BY quality, doc_id) AS b FROM documents JOIN labels USING (doc_id) WHERE n_chars IS NOT NULL AND quality IS NOT NULL)
    SELECT round(corr(a, b), 6) AS rho FROM r""")  # fmt: skip
def a14(spark, d):
    j = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return A.spearman(j, "n_chars", "quality", "doc_id").select(F.round("rho", 6).alias("rho"))


@query("A14_spearman_average", """WITH r AS (SELECT rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS a, rank() OVER (ORDER BY quality) + (count(*) OVER (PARTITION BY quality) - 1) / 2 AS b
    FROM documents JOIN labels USING (doc_id)) SELECT round(corr(a, b), 6) AS rho FROM r""")  # fmt: skip
def a14b(spark, d):
    j = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return A.spearman(j, "n_chars", "quality", "doc_id", "average").select(F.round("rho", 6).alias("rho"))


@query("A15_mutual_information", """WITH j AS (SELECT source AS a, lang AS b, count(*) AS n FROM documents GROUP BY ALL), t AS (SELECT sum(n) AS t FROM j), m AS (SELECT n, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb FROM j)
    SELECT round(sum(n / t * ln(n * t / (na * nb))), 6) AS mi FROM m, t""")  # fmt: skip
def a15(spark, d):
    return A.mutual_information(table(spark, d, "documents"), "source", "lang").select(F.round("mi", 6).alias("mi"))


_R2 = "SELECT '{0}' AS keys, round(greatest(0, 1 - sum(power(y - g, 2)) / sum(power(y - m, 2))), 6) AS r2 FROM (SELECT l_extendedprice AS y, avg(l_extendedprice) OVER (PARTITION BY {0}) AS g, avg(l_extendedprice) OVER () AS m FROM lineitem)"


@query("A16_variance_components", " UNION ALL ".join(_R2.format(k) for k in ("l_suppkey", "l_returnflag", "l_linenumber,l_returnflag")))
def a16(spark, d):
    return A.variance_components(_lines(spark, d), "l_extendedprice", [["l_suppkey"], ["l_returnflag"], ["l_linenumber", "l_returnflag"]]).withColumn("r2", F.round("r2", 6))


@query("A17_residual_variance", """SELECT l_returnflag, count(*) AS n, round(var_pop(r), 4) AS resid_var FROM (SELECT l_returnflag, l_quantity - avg(l_quantity) OVER (PARTITION BY l_suppkey) AS r FROM lineitem) GROUP BY 1""")
def a17(spark, d):
    return A.group_residual_variance(_lines(spark, d), "l_quantity", "l_suppkey", "l_returnflag").withColumn("resid_var", F.round("resid_var", 4))


@query("A18_concentration", """WITH v AS (SELECT o_custkey, sum(o_totalprice) AS v FROM orders GROUP BY 1), r AS (SELECT v, row_number() OVER (ORDER BY v, o_custkey) AS i, count(*) OVER () AS n, sum(v) OVER () AS t FROM v)
    SELECT 'top_1pct' AS measure, round(sum(v) FILTER (i > ceil((1 - 0.01) * n)) / any_value(t), 6) AS value FROM r UNION ALL SELECT 'top_10pct', round(sum(v) FILTER (i > ceil((1 - 0.1) * n)) / any_value(t), 6) FROM r
    UNION ALL SELECT 'gini', round(2 * sum(i * v) / (any_value(n) * any_value(t)) - (any_value(n) + 1) / any_value(n), 6) FROM r""")  # fmt: skip
def a18(spark, d):
    v = _orders(spark, d).groupBy("o_custkey").agg(F.sum("o_totalprice").alias("v"))
    return A.concentration(v, "v", "o_custkey", (0.01, 0.1)).withColumn("value", F.round("value", 6))


@query("A19_count_of_counts", "SELECT times, count(*) AS n_keys FROM (SELECT count(*) AS times FROM orders GROUP BY o_custkey) GROUP BY 1")
def a19(spark, d):
    return A.count_of_counts(_orders(spark, d), "o_custkey")


@query("A20_crosstab", """WITH dom AS (SELECT * FROM (VALUES ('A'), ('N'), ('R'), ('X')) a(flag), (VALUES ('F'), ('O')) b(status)), c AS (SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, round(avg(l_discount), 6) AS mean FROM lineitem GROUP BY ALL)
    SELECT flag, status, coalesce(n, 0) AS n, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (), 6) AS share, mean FROM dom LEFT JOIN c USING (flag, status)""")  # fmt: skip
def a20(spark, d):
    l = _lines(spark, d).withColumnsRenamed({"l_returnflag": "flag", "l_linestatus": "status"})
    return A.crosstab(l, "flag", "status", ["A", "N", "R", "X"], ["F", "O"], mean=F.round(F.avg("l_discount"), 6)).withColumn("share", F.round("share", 6))


@query("A21_binned_counts", """WITH u AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT b.label AS bin, count(user_id) AS n_users FROM (VALUES ('0-49', 0, 50), ('50-64', 50, 65), ('65-79', 65, 80), ('80+', 80, 1000000)) b(label, lo, hi)
    LEFT JOIN u ON n >= lo AND n < hi GROUP BY 1""")  # fmt: skip
def a21(spark, d):
    u = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    labels = ["0-49", "50-64", "65-79", "80+"]
    seen = u.groupBy(B.cut_left(F.col("n"), [50, 65, 80], labels).alias("bin")).agg(F.count(F.lit(1)).alias("n_users"))
    return spark.createDataFrame([(x,) for x in labels], "bin string").join(seen, "bin", "left").na.fill(0, ["n_users"])


@query("A22_joint_quartiles", """WITH q AS (SELECT quantile_cont(l_quantity, [0.25, 0.5, 0.75]) AS a, quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS b FROM lineitem),
    c AS (SELECT (l_quantity >= a[1])::INT + (l_quantity >= a[2])::INT + (l_quantity >= a[3])::INT AS qa, (l_extendedprice >= b[1])::INT + (l_extendedprice >= b[2])::INT + (l_extendedprice >= b[3])::INT AS qb FROM lineitem, q)
    SELECT qa, qb, count(*) AS n FROM c GROUP BY ALL""")  # fmt: skip
def a22(spark, d):
    l = _lines(spark, d).select("l_quantity", "l_extendedprice")
    a, b = (B.quantile_cuts(l, c, [0.25, 0.5, 0.75]).withColumnsRenamed({f"q{i}": f"{n}{i}" for i in range(3)}) for c, n in (("l_quantity", "a"), ("l_extendedprice", "b")))
    cuts = a.crossJoin(b)  # one row each
    side = lambda c, n: sum(((F.col(c) >= F.col(f"{n}{i}")).cast("int") for i in range(1, 3)), (F.col(c) >= F.col(f"{n}0")).cast("int"))
    return l.crossJoin(F.broadcast(cuts)).groupBy(side("l_quantity", "a").alias("qa"), side("l_extendedprice", "b").alias("qb")).agg(F.count(F.lit(1)).alias("n"))  # cuts is one row


@query("A23_stratum_cells", """WITH c AS (SELECT c_mktsegment AS seg, CASE WHEN c_acctbal < 0 THEN 'neg' WHEN c_acctbal < 5000 THEN 'mid' ELSE 'high' END AS band, count(*) AS n, count(*) FILTER (c_acctbal > 9000) AS pos FROM customer GROUP BY ALL),
    dom AS (SELECT * FROM (SELECT DISTINCT c_mktsegment AS seg FROM customer), (VALUES ('neg'), ('mid'), ('high')) b(band)) SELECT seg, band, coalesce(n, 0) AS n, coalesce(pos, 0) AS pos, coalesce(pos, 0) < 5 AS excluded FROM dom LEFT JOIN c USING (seg, band)""")  # fmt: skip
def a23(spark, d):
    c = table(spark, d, "customer").withColumn("band", F.when(F.col("c_acctbal") < 0, "neg").when(F.col("c_acctbal") < 5000, "mid").otherwise("high"))
    seen = c.groupBy(F.col("c_mktsegment").alias("seg"), "band").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") > 9000).alias("pos"))
    domain = c.select(F.col("c_mktsegment").alias("seg")).distinct().withColumn("band", F.explode(F.array(*map(F.lit, ("neg", "mid", "high")))))
    return domain.join(seen, ["seg", "band"], "left").na.fill(0, ["n", "pos"]).withColumn("excluded", F.col("pos") < 5)


_FUNNEL = f"WITH {ACT} SELECT {{0}}, round(avg((action_type = 'open')::INT), 6) AS open_rate, round(avg((action_type = 'click')::INT), 6) AS click_rate, count(*) AS n FROM act {{1}} GROUP BY 1"


def _funnel():
    rate = lambda k: F.round(F.avg((F.col("action_type") == k).cast("int")), 6)
    return rate("open").alias("open_rate"), rate("click").alias("click_rate"), F.count(F.lit(1)).alias("n")


@query("A24_funnel_by_bucket", _FUNNEL.format("CASE WHEN email_id < 30 THEN 'a' WHEN email_id < 70 THEN 'b' ELSE 'c' END AS bucket", ""))
def a24(spark, d):
    bucket = F.when(F.col("email_id") < 30, "a").when(F.col("email_id") < 70, "b").otherwise("c")
    return activities(spark, d).groupBy(bucket.alias("bucket")).agg(*_funnel())


@query("A25_same_entity_control", _FUNNEL.format("hour(created_at) // 6 AS bucket", "WHERE email_id IN (SELECT email_id FROM act GROUP BY 1 ORDER BY count(*) DESC, email_id LIMIT 20)"))
def a25(spark, d):
    a = activities(spark, d)
    top = a.groupBy("email_id").count().orderBy(F.col("count").desc(), F.col("email_id").asc_nulls_last()).limit(20)
    return a.join(top, "email_id", "left_semi").groupBy(F.floor(F.hour("created_at") / 6).alias("bucket")).agg(*_funnel())


@query("A26_clicked_not_actioned", f"""WITH {ACT}, e AS (SELECT email_id, count(*) FILTER (action_type = 'click') AS c, count(*) FILTER (action_type = 'signature') AS s FROM act GROUP BY 1)
    SELECT email_id, greatest(c - s, 0) / greatest(c, 0.001) AS share FROM e""")  # fmt: skip
def a26(spark, d):
    e = activities(spark, d).groupBy("email_id").agg(F.count_if(F.col("action_type") == "click").alias("c"), F.count_if(F.col("action_type") == "signature").alias("s"))
    return e.select("email_id", (F.greatest(F.col("c") - F.col("s"), F.lit(0)) / F.greatest(F.col("c").cast("double"), F.lit(0.001))).alias("share"))


@query("A27_provenance_share", """WITH j AS (SELECT CASE WHEN l.doc_id IS NULL THEN 'imputed' WHEN d.doc_id < 500 THEN 'raw_pre' ELSE 'raw_post' END AS provenance FROM documents d LEFT JOIN labels l USING (doc_id))
    SELECT provenance, count(*) AS n, count(*) / (SELECT count(*) FROM j) AS share FROM j GROUP BY 1""")  # fmt: skip
def a27(spark, d):
    j = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").withColumn("m", F.lit(1)), "doc_id", "left")
    p = F.when(F.col("m").isNull(), "imputed").when(F.col("doc_id") < 500, "raw_pre").otherwise("raw_post")
    by = j.groupBy(p.alias("provenance")).agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))  # three rows


_QL = "year(o_orderdate)::VARCHAR || '-Q' || quarter(o_orderdate)::VARCHAR"


@query("A28_cohort_drift", f"""WITH r AS (SELECT o_orderpriority AS cohort, {_QL} AS q, avg((o_orderstatus = 'F')::INT) AS rate FROM orders GROUP BY ALL)
    SELECT cohort, round(min_by(rate, q), 6) AS first_rate, round(max_by(rate, q), 6) AS last_rate, round(max_by(rate, q) - min_by(rate, q), 6) AS drift FROM r GROUP BY 1""")  # fmt: skip
def a28(spark, d):
    o = _orders(spark, d).select(F.col("o_orderpriority").alias("cohort"), quarter_label(F.col("o_orderdate")).alias("q"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return A.rate_drift(o, "cohort", "q", "y").withColumns({c: F.round(c, 6) for c in ("first_rate", "last_rate", "drift")})


@query("A29_baseline_lift", f"""WITH r AS (SELECT {_QL} AS cohort, count(*) AS n, avg((o_orderstatus = 'F')::INT) AS rate FROM orders GROUP BY 1) SELECT cohort, n, round(rate, 6) AS rate, round(rate - first_value(rate) OVER (ORDER BY cohort), 6) AS lift FROM r""")
def a29(spark, d):
    o = _orders(spark, d).select(quarter_label(F.col("o_orderdate")).alias("cohort"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return A.baseline_lift(o, "cohort", "y").withColumns({"rate": F.round("rate", 6), "lift": F.round("lift", 6)})


@query("A30_degree_stats", """WITH e AS (SELECT DISTINCT l_partkey AS a, 1000000 + l_suppkey AS b FROM lineitem), g AS (SELECT x, count(*) AS degree FROM (SELECT a AS x FROM e UNION ALL SELECT b FROM e) GROUP BY 1)
    SELECT count(*) AS n_nodes, max(degree) AS most, median(degree) AS mid FROM g""")  # fmt: skip
def a30(spark, d):
    e = _lines(spark, d).select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1_000_000).alias("b")).distinct()
    # Nodes are counted by degree first: the median sees each degree once.
    by = A.degrees(e, "a", "b").groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
    return by.agg(F.sum("n").alias("n_nodes"), F.max("degree").alias("most"), F.expr("percentile(degree, 0.5, n)").alias("mid"))


@query("A31_population_summary", f"""WITH {ACT}, e AS (SELECT email_id, count(*) FILTER (action_type = 'sent') AS s, count(*) FILTER (action_type = 'open') AS o, count(*) FILTER (action_type = 'click') AS c FROM act GROUP BY 1)
    SELECT count(*) AS n, count(*) FILTER (o > s) AS opens_gt_sent, count(*) FILTER (c > o) AS clicks_gt_opens, round(avg(CASE WHEN s > 0 THEN o / s END), 6) AS mean_rate FROM e""")  # fmt: skip
def a31(spark, d):
    e = activities(spark, d).groupBy("email_id").agg(*[F.count_if(F.col("action_type") == k).alias(n) for n, k in (("s", "sent"), ("o", "open"), ("c", "click"))])
    return e.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o") > F.col("s")).alias("opens_gt_sent"), F.count_if(F.col("c") > F.col("o")).alias("clicks_gt_opens"), F.round(F.avg(F.try_divide("o", "s")), 6).alias("mean_rate"))


@query("A32_cost_rollup", "SELECT c_mktsegment, c_nationkey, count(*) AS n_calls, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
def a32(spark, d):
    return cost_sums(table(spark, d, "customer"), ["c_mktsegment", "c_nationkey"], "c_acctbal").withColumn("total", F.round("total", 2))


@query("A33_tier_spread", "SELECT o_orderpriority AS tier, min(o_totalprice) AS low, median(o_totalprice) AS mid, max(o_totalprice) AS high FROM orders GROUP BY 1")
def a33(spark, d):
    o = _orders(spark, d).select(F.col("o_orderpriority").alias("tier"), "o_totalprice")
    ends = o.groupBy("tier").agg(F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))
    return ends.join(B.quantile_cuts(o, "o_totalprice", [0.5], ["tier"]), "tier").select("tier", "low", F.col("q0").alias("mid"), "high")


@query("A34_missingness", """WITH j AS (SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)) SELECT 'doc_id' AS "column", count(*) - count(doc_id) AS n_null, (count(*) - count(doc_id)) / count(*) AS share FROM j
    UNION ALL SELECT 'quality', count(*) - count(quality), (count(*) - count(quality)) / count(*) FROM j UNION ALL SELECT 'toxic', count(*) - count(toxic), (count(*) - count(toxic)) / count(*) FROM j""")  # fmt: skip
def a34(spark, d):
    return A.missingness(table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left"))


@query("A35_edge_dedup", "SELECT least(l_partkey, l_suppkey) AS src, greatest(l_partkey, l_suppkey) AS dst, max(l_discount) AS similarity FROM lineitem GROUP BY ALL")
def a35(spark, d):
    return _lines(spark, d).groupBy(F.least("l_partkey", "l_suppkey").alias("src"), F.greatest("l_partkey", "l_suppkey").alias("dst")).agg(F.max("l_discount").alias("similarity"))


# Buckets

_CASE = "CASE WHEN {0} <= 7 THEN '0-7d' WHEN {0} <= 30 THEN '8-30d' WHEN {0} <= 90 THEN '31-90d' WHEN {0} <= 180 THEN '91-180d' WHEN {0} <= 365 THEN '181-365d' WHEN {0} <= 730 THEN '1-2yr' ELSE '2yr+' END"
_TENURE = "WITH t AS (SELECT o_orderkey, date_diff('day', CAST(min(o_orderdate) OVER (PARTITION BY o_custkey) AS DATE), CAST(o_orderdate AS DATE)) AS t FROM orders)"


@query("B01_tenure_cut", f"{_TENURE} SELECT o_orderkey, {_CASE.format('t')} AS tenure_bucket FROM t")
def b01(spark, d):
    from ..functions.times import days_between

    t = days_between(F.min("o_orderdate").over(Window.partitionBy("o_custkey")), F.col("o_orderdate"))
    return _orders(spark, d).select("o_orderkey", B.cut_right(t, B.TENURE_BREAKS, B.TENURE_LABELS).alias("tenure_bucket"))


@query("B02_quantile_cut", """WITH q AS (SELECT quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8]) AS q FROM orders)
    SELECT o_orderkey, (o_totalprice > q[1])::INT + (o_totalprice > q[2])::INT + (o_totalprice > q[3])::INT + (o_totalprice > q[4])::INT AS bucket FROM orders, q""")  # fmt: skip
def b02(spark, d):
    return B.quantile_bucket(_orders(spark, d), "o_totalprice", 5, "bucket").select("o_orderkey", "bucket")


@query("B03_tertiles", """WITH q AS (SELECT quantile_cont(c_acctbal, 0.3333) AS a, quantile_cont(c_acctbal, 0.6667) AS b FROM customer) SELECT c_custkey, CASE WHEN c_acctbal <= a THEN 'low' WHEN c_acctbal <= b THEN 'mid' ELSE 'high' END AS tertile FROM customer, q""")
def b03(spark, d):
    c = table(spark, d, "customer")
    cuts = B.quantile_cuts(c, "c_acctbal", [0.3333, 0.6667])
    label = F.when(F.col("c_acctbal") <= F.col("q0"), "low").when(F.col("c_acctbal") <= F.col("q1"), "mid").otherwise("high")
    return c.crossJoin(F.broadcast(cuts)).select("c_custkey", label.alias("tertile"))  # cuts is one row


@query("B04_count_bins", "SELECT o_custkey, CASE WHEN n < 1 THEN '0' WHEN n < 2 THEN '1' WHEN n < 5 THEN '2-4' WHEN n < 20 THEN '5-19' ELSE '20+' END AS bin FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def b04(spark, d):
    n = _orders(spark, d).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return n.select("o_custkey", B.cut_left(F.col("n"), B.COUNT_BREAKS, B.COUNT_LABELS).alias("bin"))


@query("B05_equal_chunks", """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) SELECT o_orderkey, CAST(least(i // greatest(n // 10, 1), 9) AS INT) AS decile FROM r""")
def b05(spark, d):
    return B.equal_chunks(_orders(spark, d), ["o_totalprice", "o_orderkey"], 10, "decile").select("o_orderkey", "decile")


@query("B06_winsorize", """WITH r AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS i, count(*) OVER () AS n FROM orders), c AS (SELECT v FROM r WHERE i = round_even(0.99::DOUBLE * (n - 1), 0))
    SELECT o_orderkey, least(o_totalprice, v) AS price FROM orders, c""")  # fmt: skip
def b06(spark, d):
    return B.winsorize(_orders(spark, d), "o_totalprice", 0.99, "price").select("o_orderkey", "price")


@query("B07_psi", """WITH b AS (SELECT l_returnflag, greatest(0, least(9, floor(l_discount * 8 / ((1.0::DOUBLE - 0.0::DOUBLE) / 10))::INT)) AS bin, l_linenumber > 3 AS actual FROM lineitem WHERE l_returnflag IN ('A', 'R')),
    c AS (SELECT l_returnflag, k.bin, count(b.bin) FILTER (NOT actual) AS e, count(b.bin) FILTER (actual) AS a FROM (SELECT * FROM (SELECT DISTINCT l_returnflag FROM b), (SELECT range AS bin FROM range(10))) k LEFT JOIN b USING (l_returnflag, bin) GROUP BY ALL),
    s AS (SELECT l_returnflag, (e + 1e-8) / (sum(e) OVER (PARTITION BY l_returnflag) + 1e-7) AS e, (a + 1e-8) / (sum(a) OVER (PARTITION BY l_returnflag) + 1e-7) AS a FROM c) SELECT l_returnflag, round(sum((a - e) * ln(a / e)), 6) AS psi FROM s GROUP BY 1""")  # fmt: skip
def b07(spark, d):
    from ..operators.evaluation import psi

    l = _lines(spark, d).where("l_returnflag in ('A', 'R')")
    return psi(l, F.col("l_discount") * 8, F.col("l_linenumber") > 3, 10, ["l_returnflag"]).withColumn("psi", F.round("psi", 6))


@query("B08_calendar", f"SELECT o_orderkey, year(o_orderdate) AS year, {_QL} AS quarter, strftime(o_orderdate, '%Y-%m') AS month, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month_start FROM orders")
def b08(spark, d):
    at = F.col("o_orderdate")
    return _orders(spark, d).select("o_orderkey", F.year(at).alias("year"), quarter_label(at).alias("quarter"), month_label(at).alias("month"), F.date_format(F.date_trunc("month", at), "yyyy-MM-dd").alias("month_start"))
