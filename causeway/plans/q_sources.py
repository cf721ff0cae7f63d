"""Queries: sinks and sources, each a round trip through the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import catalog as C
from ..sources import ledger as L
from ..sources import remote as R
from ..sources.shared import shared_dir
from ..sources.vector_table import VectorTable
from .registry import query, table


def _root(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("S02_lazy_scan", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0")
def s02(spark, d):
    e = C.Entity(spark, _root(spark, "entity"), "customer", {1: "parquet"})
    e.put(1, table(spark, d, "customer"))
    return e.scan(1, ["c_custkey", "c_acctbal"]).where("c_acctbal > 0")


@query("S03_csv_round_trip", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def s03(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    e = C.Entity(spark, _root(spark, "entity"), "supplier", {1: "csv"}, {1: s.schema})
    e.put(1, s)
    return e.scan(1)


@query("S04_table_sink", "SELECT p_partkey, p_brand FROM part")
def s04(spark, d):
    e = C.Entity(spark, _root(spark, "entity"), "part", {3: "parquet"})
    e.put(3, table(spark, d, "part"))
    return e.get(3, ["p_partkey", "p_brand"])


@query("S05_feature_table", "SELECT o_orderkey, o_totalprice FROM orders")
def s05(spark, d):
    f = C.FeatureTable(spark, _root(spark, "entity"), "orders", {1: "parquet"}, required=("o_orderkey", "o_totalprice"))
    f.put(1, table(spark, d, "orders"))
    return f.get(1, ["o_orderkey", "o_totalprice"])


@query("S06_json_entity", "SELECT r_regionkey, r_name FROM region")
def s06(spark, d):
    r = table(spark, d, "region").select("r_regionkey", "r_name")
    e = C.Entity(spark, _root(spark, "entity"), "region", {1: "json"}, {1: r.schema})
    e.put(1, r)
    return e.get(1)


@query("S07_jsonl_skips_malformed", "SELECT n_nationkey, n_name FROM nation")
def s07(spark, d):
    path = _root(spark, "jsonl")
    n = table(spark, d, "nation").select(F.to_json(F.struct("n_nationkey", "n_name")).alias("value"))
    n.union(spark.createDataFrame([("{broken",), ('{"n_nationkey": "x"}',)], "value string")).write.text(path)
    return L.read_jsonl(spark, path, "n_nationkey int, n_name string")


@query("S08_ledger", "SELECT c_custkey, c_name FROM customer")
def s08(spark, d):
    path, schema = _root(spark, "ledger"), T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType())])
    c = table(spark, d, "customer")
    for part in (0, 1):  # two appends
        L.append_rows(c.where(F.col("c_nationkey") % 2 == part).select("c_custkey", "c_name"), path, "causeway")
    return L.read_ledger(spark, path, schema)


@query("S08_ledgers_together", "SELECT r_name AS name FROM region")
def s08b(spark, d):
    root, r = _root(spark, "ledgers"), table(spark, d, "region")
    L.append_together({"runs": r.select(F.col("r_name").alias("name")), "costs": r.select("r_regionkey")}, root)
    return L.read_together(spark, root, "runs")


@query("S12_rows_to_table", "SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey % 3 = 2 THEN n_name END AS tag, n_regionkey::BIGINT AS region FROM nation")
def s12(spark, d):
    """Documents of which most lack a field."""
    doc = F.struct(F.col("n_nationkey").alias("id"), F.struct(F.col("n_regionkey").alias("region")).alias("in"), F.when(F.col("n_nationkey") % 3 == 2, F.col("n_name")).alias("tag"))
    return R.rows_to_table(table(spark, d, "nation").select(F.to_json(doc).alias("doc")), "doc").select("id", "tag", F.col("in.region").alias("region"))


@query("S13_vector_store_query", """WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], q) / sqrt(list_dot_product(q, q)) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 9) AS s FROM embeddings, q)
    SELECT vec_id, round(s, 5) AS similarity FROM s ORDER BY s DESC, vec_id LIMIT 10""")  # fmt: skip
def s13(spark, d):
    from ..operators.dense import dense_top_k

    e = table(spark, d, "embeddings")
    q = e.where("vec_id = 0").first()["embedding"]  # one vector
    return dense_top_k(e, "embedding", q, 10, -1.0, "vec_id").select("vec_id", F.round("similarity", 5).alias("similarity"))


@query("S13_vector_table", """WITH first AS (SELECT vec_id, embedding[1]::DOUBLE AS x, label FROM embeddings WHERE vec_id % 3 <> 0), again AS (SELECT vec_id, embedding[64]::DOUBLE AS x, -1 AS label FROM embeddings WHERE vec_id % 5 = 0),
    both_ AS (SELECT * FROM again UNION ALL SELECT * FROM first WHERE vec_id NOT IN (SELECT vec_id FROM again))
    SELECT CAST(vec_id AS VARCHAR) AS id, round(x, 6) AS x, label FROM both_ WHERE vec_id % 7 <> 0 AND vec_id % 2 = 0""")  # fmt: skip
def s13b(spark, d):
    """Upserts, upserts over them, deletes, and the even ids fetched."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    t = VectorTable(spark, _root(spark, "vectors"), "label int")
    t.upsert(e.where("id % 3 <> 0"))
    t.upsert(e.where("id % 5 = 0").withColumns({"vector": F.reverse("vector"), "label": F.lit(-1)}))
    t.delete(e.where("id % 7 = 0").select("id"))
    return t.fetch(e.where("id % 2 = 0").select("id")).select("id", F.round(F.element_at("vector", 1), 6).alias("x"), "label")


@query("S14_service_calls", "SELECT item_id, CAST(length(text) AS VARCHAR) AS result FROM benchmark")
def s14(spark, d):
    b = table(spark, d, "benchmark").select("item_id", "text")
    return R.call_service(b, "text", lambda texts: [str(len(t)) for t in texts], "string").select("item_id", "result")


@query("S14_dead_letters", """SELECT item_id, CASE WHEN length(text) % 11 <> 0 THEN CAST(length(text) AS VARCHAR) END AS result, CASE WHEN length(text) % 11 = 0 THEN 'ValueError: refused' END AS error,
    CASE WHEN length(text) % 11 = 0 OR length(text) % 7 = 0 THEN 2 ELSE 1 END AS run FROM benchmark""")  # fmt: skip
def s14b(spark, d):
    """A service that refuses some items at first and some for good: the second run takes up what failed."""
    b, root = table(spark, d, "benchmark").select("item_id", "text"), _root(spark, "calls")

    def service(bad):
        def call(texts):
            if any(len(t) % 11 == 0 or (bad and len(t) % 7 == 0) for t in texts):
                raise ValueError("refused")
            return [str(len(t)) for t in texts]

        return call

    R.resumed_calls(b, "item_id", "text", service(True), "string", root, batch=16, retries=1)
    results, dead = R.resumed_calls(b, "item_id", "text", service(False), "string", root, batch=16, retries=1)
    said = lambda df: df.select("item_id", *[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in ("result", "error")], "run")
    return said(results).unionByName(said(dead))


@query("S19_result_cache", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1")
def s19(spark, d):
    c = table(spark, d, "customer")
    cache = C.ResultCache(spark, _root(spark, "cache"))
    return cache.get_or_make(C.cheap_fingerprint(c, "c_custkey", "c_acctbal"), lambda: c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")))


@query("S20_file_audit", "SELECT 'region.parquet' AS name, true AS ok UNION ALL SELECT 'missing.parquet', false")
def s20(spark, d):
    return C.file_audit(spark, f"{d}/region.parquet", {"region.parquet": (1, 1_000_000), "missing.parquet": (1, 10)}).select("name", "ok")


@query("P12_imputed_flags", """WITH f AS (SELECT user_id, event_id, event_type = 'signup' AS o, event_type = 'click' AS c, event_type = 'purchase' AS a FROM events) SELECT event_id, o OR c OR a AS opened, c OR a AS clicked FROM f""")
def p12(spark, d):
    kind = F.col("event_type")
    o, c, a = (kind == k for k in ("signup", "click", "purchase"))
    return table(spark, d, "events").select("event_id", (o | c | a).alias("opened"), (c | a).alias("clicked"))
