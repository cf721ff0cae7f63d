"""The queries of the corpus operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .ball_kmeans import cluster_report
from .common import documents, labels
from .exact_dedup import exact_groups
from .filter_audit import audit_filters
from .jaccard_join import jaccard_classes
from .mixing import mix
from .norm_buckets import top_products
from .oracles import AUDIT_SQL, QUALITY_SQL, TOP_PRODUCTS_SQL, cluster_sql, secret_sql
from .packing import pack
from .pii import scan_pii
from .quality_model import classify_quality
from .quality_rules import quality_filter
from .secrets import scan_secrets, secret_digest
from .toxicity import classify_toxicity
from .url_filter import filter_urls


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(scan_secrets(documents(spark, sf_dir)))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_filter(documents(spark, sf_dir))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_pii(documents(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(documents(spark, sf_dir), labels(spark, sf_dir))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def op11_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "id % 50 = 0", k=5)


def op12_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(documents(spark, sf_dir), labels(spark, sf_dir))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_quality_rules": op2_quality_rules,
    "op3_pii": op3_pii,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_url_filter": op6_url_filter,
    "op7_toxicity": op7_toxicity,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_mixing": op9_mixing,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_norm_buckets": op11_norm_buckets,
    "op12_ball_kmeans": op12_ball_kmeans,
    "op13_filter_audit": op13_filter_audit,
}

ORACLES = {
    "op1_secret_scan": secret_sql(),
    "op2_quality_rules": QUALITY_SQL,
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_norm_buckets": TOP_PRODUCTS_SQL,
    "op12_ball_kmeans": cluster_sql(),
    "op13_filter_audit": AUDIT_SQL,
}
