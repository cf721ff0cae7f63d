"""Queries: scalar functions, text, vectors and searches."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions import vectors as V
from ..functions.times import days_between, seconds_between
from ..operators import dense as D
from ..operators import graph as G
from ..operators import sparse as S
from ..operators.communities import community_report
from ..operators.vector_index import VectorIndex
from .content import content_features, source_rollups
from .evaluation_sql import TOKENS, tfidf_sql
from .registry import query, table
from .roles import ACT, SENDS, activities
from .q_windows import user_emails


def _docs(spark, d):
    return table(spark, d, "documents")


@query("X01_strings", """SELECT p_partkey, trim(p_name) AS stripped, p_brand || '|' || p_type AS joined, length(p_name) AS n, substring(p_name, 1, 5) AS head, lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded, split_part(p_type, ' ', 1) AS first FROM part""")
def x01(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", X.strip(F.col("p_name")).alias("stripped"), F.concat_ws("|", "p_brand", "p_type").alias("joined"), F.length("p_name").alias("n"), F.substring("p_name", 1, 5).alias("head"),
        F.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"), F.element_at(F.split("p_type", " "), 1).alias("first"))


@query("X02_regex_counts", r"""SELECT conv_id, turn, len(regexp_extract_all(text, '\S+')) AS words, len(regexp_extract_all(text, '[.!?]+')) AS sentences, len(regexp_extract_all(text, '\?')) AS questions FROM conversations""")
def x02(spark, d):
    t = F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", X.count_matches(t, X.WORDS).alias("words"), X.count_matches(t, X.SENTENCES).alias("sentences"), X.count_matches(t, r"\?").alias("questions"))


@query("X03_ratios", r"""SELECT doc_id, round(length(text) / greatest(len(regexp_extract_all(text, '\S+')), 1), 6) AS mean_word FROM documents""")
def x03(spark, d):
    t = F.col("text")
    return _docs(spark, d).select("doc_id", F.round(F.length(t) / F.greatest(X.count_matches(t, X.WORDS), F.lit(1)), 6).alias("mean_word"))


_HTML = "regexp_replace(html, '<[^>]*>', ' ', 'g')"
for _e, _c in X.ENTITIES.items():
    _HTML = "replace({}, '{}', '{}')".format(_HTML, _e, _c.replace("'", "''"))


@query("X04_html_regex", rf"SELECT page_id, regexp_replace(regexp_replace(regexp_replace({_HTML}, '\s+', ' ', 'g'), '^\s+', ''), '\s+$', '') AS text FROM pages")
def x04(spark, d):
    return table(spark, d, "pages").select("page_id", X.html_to_text(F.col("html")).alias("text"))


_VISIBLE = "string_split_regex(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '<s>', 'g'), '(?is)<style[^>]*>.*?</style>', '<s>', 'g'), '<[^>]*>')"
_PLAIN = "x"
for _e, _c in ({"&copy;": "©", "&middot;": "·"} | X.ENTITIES).items():  # those of the pages
    _PLAIN = "replace({}, '{}', '{}')".format(_PLAIN, _e, (_c if _e != "&nbsp;" else "\xa0").replace("'", "''"))


@query("X05_html_parser", rf"SELECT page_id, array_to_string(list_filter(list_transform({_VISIBLE}, lambda x: regexp_replace(regexp_replace({_PLAIN}, '^[\s\x{{{{A0}}}}]+', ''), '[\s\x{{{{A0}}}}]+$', '')), lambda x: x <> ''), ' ') AS text FROM pages".replace("{{", "{").replace("}}", "}"))
def x05(spark, d):
    return table(spark, d, "pages").select("page_id", X.html_visible_text("html").alias("text"))


@query("X06_dates", """SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS days,
    (epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1995-01-01')) // 1000000 AS seconds FROM orders""")  # fmt: skip
def x06(spark, d):
    start, at = F.lit("1995-01-01").cast("timestamp_ntz"), F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", F.year(at).alias("y"), F.month(at).alias("m"), days_between(start, at).alias("days"), seconds_between(start, at).alias("seconds"))


@query("X07_math", "SELECT event_id, round(ln(1 + value), 6) AS l1, round(log10(value + 1), 6) AS l10, round(1 / (1 + exp(-value / 100)), 6) AS s, greatest(0.0, least(50.0, value)) AS clipped FROM events")
def x07(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", F.round(F.log1p(v), 6).alias("l1"), F.round(F.log10(v + 1), 6).alias("l10"), F.round(1 / (1 + F.exp(-v / 100)), 6).alias("s"), F.greatest(F.lit(0.0), F.least(F.lit(50.0), v)).alias("clipped"))


@query("X08_ratios", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <> 0 THEN l_extendedprice / l_quantity END AS unit_price, CASE WHEN l_discount <> 0 THEN l_tax / l_discount END AS r FROM lineitem")
def x08(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.try_divide("l_extendedprice", "l_quantity").alias("unit_price"), F.try_divide("l_tax", "l_discount").alias("r"))


@query("X09_lists", "SELECT vec_id, len(embedding) AS n, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[64] AS DOUBLE) AS last FROM embeddings")
def x09(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.size(e).alias("n"), F.try_element_at(e, F.lit(1)).cast("double").alias("first"), F.try_element_at(e, F.lit(64)).cast("double").alias("last"))


@query("X10_structs", "SELECT s_suppkey, s_name AS name, s_acctbal AS balance FROM supplier")
def x10(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.struct(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")).alias("s")).select("s_suppkey", "s.*")


@query("X11_explode_labels", "SELECT p_partkey, value FROM (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS value FROM part) WHERE value IS NOT NULL AND value <> ''")
def x11(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.transform(F.split("p_type", " "), lambda x: F.struct(x.alias("name"))).alias("items"))
    return p.select("p_partkey", F.explode("items.name").alias("value")).where("value is not null and value <> ''")


@query("X12_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def x12(spark, d):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("missing", T.StringType())])
    return table(spark, d, "events").select("event_id", F.from_json("props", schema).alias("j")).select("event_id", "j.*")


@query("X13_label_scores", """SELECT p_brand, avg(CASE WHEN p_size < 15 THEN -1.0 WHEN p_size < 35 THEN 0.0 ELSE 1.0 END)::DOUBLE AS score FROM part GROUP BY 1""")
def x13(spark, d):
    side = F.when(F.col("p_size") < 15, "left").when(F.col("p_size") < 35, "center").otherwise("right")
    return table(spark, d, "part").groupBy("p_brand").agg(F.collect_list(side).alias("l")).select("p_brand", X.bias_score(F.col("l")).alias("score"))


@query("X14_content_hash", r"SELECT conv_id, turn, sha256(lower(role) || '|' || trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS h FROM conversations")
def x14(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.content_hash(F.col("role"), F.col("text")).alias("h"))


@query("X15_preflight", """SELECT doc_id, CASE WHEN trim(text) = '' THEN '[empty]' ELSE substring(text, 1, 8192) END AS text, CASE WHEN trim(text) = '' THEN 'blank' WHEN length(text) > 8192 THEN 'long' ELSE 'ok' END AS status FROM documents""")
def x15(spark, d):
    return _docs(spark, d).select("doc_id", X.preflight(F.col("text")).alias("p")).select("doc_id", "p.*")


@query("X16_extract_id", r"SELECT page_id, regexp_extract(url, '/(\d+)', 1) AS number FROM pages")
def x16(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"/(\d+)", 1).alias("number"))


@query("X17_token_estimate", "SELECT doc_id, greatest(1, length(text) // 4) AS n FROM documents")
def x17(spark, d):
    return _docs(spark, d).select("doc_id", X.token_estimate(F.col("text")).alias("n"))


# Vectors

_DIMS = "SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, (SELECT range AS i FROM range(1, 65))"


@query("V01_cosine", "SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 5) AS similarity FROM embeddings a, embeddings b WHERE b.vec_id = a.vec_id + 1")
def v01(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(n, "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("other")), 5).alias("similarity"))


_Q = [1.0] * 32 + [-1.0] * 32


@query("V02_dense_top_k", f"""WITH q AS (SELECT {_Q}::DOUBLE[] AS q), s AS (SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], q) / 8 / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 9) AS s FROM embeddings, q WHERE label BETWEEN 2 AND 7)
    SELECT vec_id, round(s, 6) AS similarity FROM s WHERE s >= 0.05 ORDER BY s DESC, vec_id LIMIT 25""")  # fmt: skip
def v02(spark, d):
    e = table(spark, d, "embeddings").where("label between 2 and 7")
    return D.dense_top_k(e, "embedding", _Q, 25, 0.05, "vec_id").select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("V03_cell_probe")
def v03(spark, d):
    """The 25 best rows of the probed cells for every row whose id is divisible by 20."""
    e = table(spark, d, "embeddings")
    return VectorIndex.build(e, "vec_id", "embedding").search(e.where("vec_id % 20 = 0"), "vec_id", "embedding", 25).select(F.col("query").alias("query_id"), F.col("key").alias("vec_id"), "similarity", "place")


@query("V04_knn_graph", """WITH p AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 9) AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY s DESC, dst) AS n FROM p WHERE s >= 0.3) SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst, round(s, 5) AS similarity FROM r WHERE n <= 100""")  # fmt: skip
def v04(spark, d):
    pairs = D.exact_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", 0.3 - 5e-10, keep=D.best_partners(100)).withColumn("similarity", F.round("similarity", 9)).where("similarity >= 0.3")
    return D.nearest(pairs, 100).withColumn("similarity", F.round("similarity", 5))


@query("V04_knn_graph_cells")
def v04c(spark, d):
    """V04 over the stored index instead of all pairs: a recall of 0.9 or more of its edges."""
    pairs = VectorIndex.build(table(spark, d, "embeddings"), "vec_id", "embedding").near_pairs(0.3, k=100)
    return D.nearest(pairs, 100).withColumn("similarity", F.round("similarity", 5))


@query("V05_tfidf", f"WITH {tfidf_sql('documents', 'doc_id', 'text', 3, 0.5)} SELECT doc_id, term, round(weight, 6) AS weight FROM vec")
def v05(spark, d):
    return S.tfidf(_docs(spark, d), "doc_id", F.col("text"), 3, 0.5).withColumn("weight", F.round("weight", 6))


_BM25 = f"""tok AS (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
    len AS (SELECT doc_id, sum(tf) AS l FROM tf GROUP BY 1), w AS (SELECT doc_id, term, tf / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * l / (SELECT avg(l) FROM len))) AS w FROM tf JOIN len USING (doc_id)),
    bm AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w)"""


@query("V06_bm25", f"WITH {_BM25} SELECT doc_id, term, round(weight, 6) AS weight FROM bm")
def v06(spark, d):
    return S.bm25(_docs(spark, d), "doc_id", F.col("text")).withColumn("weight", F.round("weight", 6))


_BQ = f"""q0 AS (SELECT item_id, unnest(list_distinct({TOKENS.format('text')})) AS term FROM benchmark), df AS (SELECT term, count(DISTINCT doc_id) AS df FROM bm GROUP BY 1),
    i AS (SELECT item_id, term, ln(((SELECT count(DISTINCT doc_id) FROM bm) + 1) / (df + 0.5::DOUBLE)) AS w FROM q0 JOIN df USING (term)), bq AS (SELECT item_id, term, w / sum(w) OVER (PARTITION BY item_id) AS weight FROM i)"""


@query("V07_query_encoders", f"WITH {_BM25}, {_BQ} SELECT item_id, term, round(weight, 6) AS weight FROM bq")
def v07(spark, d):
    q, _ = S.bm25_for(_docs(spark, d), "doc_id", F.col("text"), table(spark, d, "benchmark"), "item_id", F.col("text"))
    return q.withColumn("weight", F.round("weight", 6))


def _search(q, c, k, least):
    return f"""hit AS (SELECT item_id, doc_id, round(sum({q}.weight * {c}.weight), 9) AS s FROM {q} JOIN {c} USING (term) GROUP BY ALL HAVING round(sum({q}.weight * {c}.weight), 9) >= {least}),
    top AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) AS place FROM hit)
    SELECT item_id, doc_id, round(s, 6) AS similarity, place FROM top WHERE place <= {k}"""


@query("V08_sparse_top_k", f"""WITH {_BM25}, {_BQ}, en AS (SELECT bm.* FROM bm JOIN documents USING (doc_id) WHERE lang = 'en'), {_search('bq', 'en', 5, 0.01)}""")
def v08(spark, d):
    q, corpus = S.bm25_for(_docs(spark, d), "doc_id", F.col("text"), table(spark, d, "benchmark"), "item_id", F.col("text"), ["lang"])
    return S.sparse_top_k(q, "item_id", corpus.where("lang = 'en'"), "doc_id", 5, 0.01).withColumn("similarity", F.round("similarity", 6))


_TQ = f"""g0 AS (SELECT item_id, {TOKENS.format('text')} AS t FROM benchmark), g1 AS (SELECT item_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM g0),
    g2 AS (SELECT item_id, term, 1 + ln(count(*)) AS w FROM g1 WHERE term IN (SELECT DISTINCT term FROM vec) GROUP BY ALL), tq AS (SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS weight FROM g2)"""


@query("V09_batch_top_k", f"WITH {tfidf_sql('documents', 'doc_id', 'text', 3, 0.5)}, {_TQ}, {_search('tq', 'vec', 10, 0.05)}")
def v09(spark, d):
    q, vec = S.tfidf_for(_docs(spark, d), "doc_id", F.col("text"), table(spark, d, "benchmark"), "item_id", F.col("text"), 3, 0.5)
    return S.sparse_top_k(q, "item_id", vec, "doc_id", 10, 0.05).withColumn("similarity", F.round("similarity", 6))


@query("V10_all_pairs", f"""WITH {tfidf_sql('documents', 'doc_id', 'text', 2, 0.5)}, m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY v) AS rep FROM (SELECT doc_id, list((term, round(weight, 9)) ORDER BY term) AS v FROM vec GROUP BY doc_id)),
    r AS (SELECT vec.* FROM vec JOIN m USING (doc_id) WHERE doc_id = rep)
    SELECT a.doc_id AS src, b.doc_id AS dst, round(sum(a.weight * b.weight), 6) AS similarity, 'pair' AS kind FROM r a JOIN r b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY ALL HAVING sum(a.weight * b.weight) >= 0.5
    UNION ALL SELECT rep, doc_id, 1.0, 'copy' FROM m WHERE rep <> doc_id""")  # fmt: skip
def v10(spark, d):
    """All pairs over the vocabulary of the other vector queries: pairs of representatives, and each other member of a class with its own."""
    return S.text_pair_report(_docs(spark, d), "doc_id", F.col("text"), 0.5).withColumn("similarity", F.round("similarity", 6))


@query("V11_attribute_edges", """WITH e AS (SELECT DISTINCT p_partkey, 'types' AS attribute_type, unnest(string_split(p_type, ' ')) AS value FROM part UNION SELECT p_partkey, 'names', unnest(string_split(p_name, ' ')) FROM part),
    f AS (SELECT attribute_type, value FROM e WHERE trim(value) <> '' GROUP BY ALL HAVING count(*) BETWEEN 2 AND 5000) SELECT p_partkey, attribute_type, value FROM e JOIN f USING (attribute_type, value)""")  # fmt: skip
def v11(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.split("p_type", " ").alias("types"), F.split("p_name", " ").alias("names"))
    return G.attribute_edges(p, "p_partkey", ["types", "names"], 2, 5000)


def _layer(q, c, name):
    scores = f"SELECT item_id, doc_id, round(sum({q}.weight * {c}.weight), 9) AS s FROM {q} JOIN {c} USING (term) GROUP BY ALL HAVING round(sum({q}.weight * {c}.weight), 9) >= 0"
    return f"""h_{name} AS (SELECT * FROM ({scores}) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) <= 50),
    n_{name} AS (SELECT item_id, doc_id, CASE WHEN max(s) OVER i > min(s) OVER i THEN (s - min(s) OVER i) / (max(s) OVER i - min(s) OVER i) ELSE 1.0 END * 0.4 AS w FROM h_{name} WINDOW i AS (PARTITION BY item_id))"""


@query("V12_hybrid_fusion", f"""WITH {_BM25}, {_BQ}, {tfidf_sql('documents', 'doc_id', 'text', 3, 0.5)}, {_TQ}, {_layer('bq', 'bm', 'b')}, {_layer('tq', 'vec', 't')},
    f AS (SELECT item_id, doc_id, round(sum(w), 9) AS s FROM (SELECT * FROM n_b UNION ALL SELECT * FROM n_t) GROUP BY ALL)
    SELECT item_id, doc_id, round(s, 6) AS similarity FROM f QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) <= 10""")  # fmt: skip
def v12(spark, d):
    docs, items = _docs(spark, d), table(spark, d, "benchmark")
    q, corpus = S.bm25_for(docs, "doc_id", F.col("text"), items, "item_id", F.col("text"))
    tq, vec = S.tfidf_for(docs, "doc_id", F.col("text"), items, "item_id", F.col("text"), 3, 0.5)
    b = S.sparse_top_k(q, "item_id", corpus, "doc_id", 50, 0.0)
    t = S.sparse_top_k(tq, "item_id", vec, "doc_id", 50, 0.0)
    _, _, wt, wb = S.layer_weights(0.4, 0.0, 0.2, 0.2, anchored=False)
    return S.fuse([(b, wb), (t, wt)], "doc_id", 10, ["item_id"]).withColumn("similarity", F.round("similarity", 6))


@query("V13_semantic_dedup", """WITH p AS (SELECT a.vec_id, b.vec_id AS near, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 9) AS s FROM embeddings a JOIN embeddings b ON a.vec_id > b.vec_id)
    SELECT vec_id, near, round(s, 5) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, near) AS n FROM p WHERE s >= 0.3) WHERE n = 1""")  # fmt: skip
def v13(spark, d):
    pairs = D.exact_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", 0.3 - 5e-10, keep=D.best_partners(1, earlier=True)).withColumn("similarity", F.round("similarity", 9)).where("similarity >= 0.3")
    return _nearest_earlier(pairs)


def _nearest_earlier(pairs):
    best = F.min_by(F.struct("src", "similarity"), F.struct((-F.col("similarity")).alias("s"), "src")).alias("best")
    return pairs.groupBy(F.col("dst").alias("vec_id")).agg(best).select("vec_id", F.col("best.src").alias("near"), F.round("best.similarity", 5).alias("similarity"))


@query("V13_semantic_dedup_cells")
def v13c(spark, d):
    """V13 over the stored index: each row with its nearest earlier one among the pairs that the index finds."""
    return _nearest_earlier(VectorIndex.build(table(spark, d, "embeddings"), "vec_id", "embedding").near_pairs(0.3))


def _affinity(shrink):
    mean = f"(coalesce(sum(v.a::INT * v.x) OVER w, 0) + {shrink} * m) / (count(*) FILTER (v.a) OVER w + {shrink})" if shrink else "sum(v.a::INT * v.x) OVER w"
    return f"""WITH {SENDS}, dim AS ({_DIMS}), mean AS (SELECT i, avg(x) AS m FROM dim GROUP BY i), v AS (SELECT activity_id, user_id, date_sent, actioned_24h AS a, i, x FROM ue JOIN dim ON vec_id = email_id),
      c AS (SELECT activity_id, v.i, x, coalesce({mean}, 0) AS c FROM v JOIN mean ON v.i = mean.i WINDOW w AS (PARTITION BY user_id, v.i ORDER BY date_sent, activity_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      s AS (SELECT activity_id, sum(x * c) AS d, sqrt(sum(x * x)) * sqrt(sum(c * c)) AS n FROM c GROUP BY 1),
      p AS (SELECT activity_id, coalesce(sum(actioned_24h::INT) OVER (PARTITION BY user_id ORDER BY date_sent, activity_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n_prior FROM ue)
      SELECT activity_id, CAST(n_prior AS BIGINT) AS n_prior, CASE WHEN n > 1e-12 THEN round(d / n, 5) ELSE 0 END AS affinity FROM s JOIN p USING (activity_id)"""


def _affine(spark, d, shrink):
    vec = table(spark, d, "embeddings").select(F.col("vec_id").alias("email_id"), F.col("embedding").cast("array<double>").alias("vector"))
    out = D.causal_affinity(user_emails(spark, d), vec, "user_id", "email_id", ["date_sent", "activity_id"], "actioned_24h", "activity_id", shrink)
    return out.withColumn("affinity", F.round("affinity", 5))


@query("V14_causal_affinity", _affinity(0))
def v14(spark, d):
    return _affine(spark, d, 0.0)


@query("V15_shrunk_affinity", _affinity("5.0::DOUBLE"))
def v15(spark, d):
    return _affine(spark, d, 5.0)


@query("V16_cluster_pairs")
def v16(spark, d):
    """The 3 nearest rows of each row within its own of ten clusters."""
    return VectorIndex.build(table(spark, d, "embeddings"), "vec_id", "embedding", n_cells=10).near_pairs(0.3, k=3, n_probe=1, refine_with=0)


@query("V17_communities")
def v17c(spark, d):
    """Communities of the graph of near rows that the stored index finds, weighted by similarity."""
    pairs = VectorIndex.build(table(spark, d, "embeddings"), "vec_id", "embedding").near_pairs(0.4)
    return community_report(pairs, "src", "dst", "similarity").withColumn("modularity", F.round("modularity", 6))


@query("V17_components", """WITH RECURSIVE e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
      WHERE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) >= 0.45),
    r AS (SELECT a AS n, a AS c FROM e UNION SELECT b, a FROM e UNION SELECT e.b, r.c FROM r JOIN e ON r.n = e.a), l AS (SELECT n, min(c) AS c FROM r GROUP BY n), s AS (SELECT c, count(*) AS n FROM l GROUP BY c)
    SELECT CAST(sum(n) AS BIGINT) AS n_nodes, count(*) AS n_components, max(n) / sum(n) AS share FROM s""")
def v17(spark, d):
    edges = D.exact_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", 0.45, keep=D.tree_of_hits)
    return G.largest_component_share(edges, "src", "dst")


@query("V17_modularity", """WITH p AS (SELECT a.vec_id AS src, b.vec_id AS dst, a.label AS la, b.label AS lb FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
      WHERE round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 9) >= 0.4),
    e AS (SELECT la AS l, lb AS o FROM p UNION ALL SELECT lb, la FROM p), s AS (SELECT l, count(*) AS d, count(*) FILTER (l = o) / 2 AS i FROM e GROUP BY 1)
    SELECT round(sum(i) / (sum(d) / 2) - sum(d::DOUBLE * d) / (sum(d) * sum(d))::DOUBLE, 6) AS modularity FROM s""")  # fmt: skip
def v17b(spark, d):
    e = table(spark, d, "embeddings")
    pairs = D.exact_pairs(e, "vec_id", "embedding", 0.4 - 5e-10).withColumn("similarity", F.round("similarity", 9)).where("similarity >= 0.4")
    return G.modularity(pairs, "src", "dst", e, "vec_id", "label").withColumn("modularity", F.round("modularity", 6))


@query("V18_embedding_report", """WITH n AS (SELECT embedding, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l FROM embeddings)
    SELECT count(*) AS n, avg((embedding IS NOT NULL)::INT) AS covered, avg((abs(l - 1) <= 1e-4)::INT) AS unit FROM n""")  # fmt: skip
def v18(spark, d):
    return D.embedding_report(table(spark, d, "embeddings"), "embedding")


# Content pipelines


@query("D06_source_rollups", """WITH st AS (SELECT conv_id, list(DISTINCT 'src' || CAST((turn * 3 + conv_id) % 26 AS VARCHAR)) AS l FROM conversations GROUP BY 1),
    so AS (SELECT source AS name, sum(n_chars)::BIGINT AS reach, min(doc_id) AS rank, min(lang) AS country, count(*) > 49 AS paywall, max(lang) AS bias FROM documents GROUP BY 1),
    m AS (SELECT conv_id, u.name, so.name IS NOT NULL AS hit, reach, rank, country, paywall, bias FROM (SELECT conv_id, unnest(l) AS name FROM st) u LEFT JOIN so USING (name))
    SELECT conv_id, coalesce(sum(reach), 0)::BIGINT AS source_reach_total, avg(rank) AS source_rank_mean, min(rank) AS source_rank_min, count(DISTINCT name) FILTER (hit) AS source_diversity_n,
      count(DISTINCT country) FILTER (hit) + max((hit AND country IS NULL)::INT) AS source_diversity_country_n, avg(paywall::INT) AS source_paywall_frac, list_sort(list(DISTINCT bias) FILTER (bias IS NOT NULL)) AS source_bias_set,
      count(*) FILTER (hit) AS source_matched_count, count(*) - count(*) FILTER (hit) AS source_unmatched_count FROM m GROUP BY conv_id""")  # fmt: skip
def d06(spark, d):
    c = table(spark, d, "conversations")
    stories = c.groupBy("conv_id").agg(F.collect_set(F.concat(F.lit("src"), ((F.col("turn") * 3 + F.col("conv_id")) % 26).cast("string"))).alias("l"))
    sources = _docs(spark, d).groupBy(F.col("source").alias("name")).agg(F.sum("n_chars").alias("reach"), F.min("doc_id").alias("rank"), F.min("lang").alias("country"), (F.count(F.lit(1)) > 49).alias("paywall"), F.max("lang").alias("bias"))
    out = source_rollups(stories, sources, "conv_id", "l")
    return out.withColumn("source_bias_set", F.when(F.size("source_bias_set") > 0, F.col("source_bias_set")))


def _n(p, flags=""):
    return f"len(regexp_extract_all(text, '{p}'{flags}))"


@query("D08_content_features", rf"""SELECT doc_id, length(text) AS body_char_len, {_n(r'[^ \t\n\f\r\x0B]+')} AS body_word_count, {_n('[.!?]+')} AS body_sentence_count, length(text) / greatest({_n(r'[^ \t\n\f\r\x0B]+')}, 1) AS body_avg_word_len_chars,
    {_n('!')} AS body_exclamation_count, {_n(r'\?')} AS body_question_count, len(list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[A-Z]{{3,}}'))) / greatest({_n(r'[^ \t\n\f\r\x0B]+')}, 1) AS body_uppercase_word_ratio,
    {_n(X.URGENCY.replace("'", "''"))} AS body_urgency_keyword_count, {_n(X.CALLS)} AS body_cta_keyword_count, length(split_part(text, chr(10), 1)) AS first_line_char_len,
    len(regexp_extract_all(split_part(text, chr(10), 1), '[^ \t\n\f\r\x0B]+')) AS first_line_word_count FROM documents""")  # fmt: skip
def d08(spark, d):
    return content_features(_docs(spark, d), "doc_id", "text")


@query("D14_related_by_attribute", """WITH e AS (SELECT DISTINCT p_partkey, 'types' AS t, unnest(string_split(p_type, ' ')) AS v FROM part UNION SELECT p_partkey, 'names', unnest(string_split(p_name, ' ')) FROM part), a AS (SELECT t, v FROM e WHERE p_partkey = 1)
    SELECT p_partkey, count(*) AS shared FROM e JOIN a USING (t, v) WHERE p_partkey <> 1 GROUP BY 1 HAVING count(*) >= 2""")  # fmt: skip
def d14(spark, d):
    from ..operators.joins import co_occurrence

    p = table(spark, d, "part").select("p_partkey", F.split("p_type", " ").alias("types"), F.split("p_name", " ").alias("names"))
    return co_occurrence(G.attribute_edges(p, "p_partkey", ["types", "names"], 1, None), "p_partkey", ["attribute_type", "value"], 1, 2)
