"""Content pipelines: email text features, source rollups of stories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def content_features(df: DataFrame, key: str, body: str) -> DataFrame:
    """key and eleven counts and ratios of the text and of its first line; null counts as empty."""
    b = F.coalesce(F.col(body), F.lit(""))
    first = F.element_at(F.split(b, "\n"), 1)
    n_words = X.count_matches(b, X.WORDS)
    floor = F.greatest(n_words, F.lit(1))
    return df.select(
        key, F.length(b).cast("long").alias("body_char_len"), n_words.alias("body_word_count"), X.count_matches(b, X.SENTENCES).alias("body_sentence_count"),
        (F.length(b) / floor).alias("body_avg_word_len_chars"), X.count_char(b, "!").alias("body_exclamation_count"), X.count_char(b, "?").alias("body_question_count"),
        (X.count_matches(b, X.SHOUTED) / floor).alias("body_uppercase_word_ratio"), X.count_matches(b, X.URGENCY).alias("body_urgency_keyword_count"), X.count_matches(b, X.CALLS).alias("body_cta_keyword_count"),
        F.length(first).cast("long").alias("first_line_char_len"), X.count_matches(first, X.WORDS).alias("first_line_word_count"),
    )


def source_rollups(stories: DataFrame, sources: DataFrame, key: str, listed: str) -> DataFrame:
    """One row per story: reach, rank, diversity and match counts of its listed sources.

    ``sources`` has name, reach, rank, country, paywall, bias. A story without listed sources has null rollups; the
    reach of unmatched sources is 0. Null countries count as one value.
    """
    pairs = stories.select(key, F.explode(listed).alias("name"))
    met = pairs.join(sources.withColumn("_matched", F.lit(True)), "name", "left").withColumn("_matched", F.coalesce("_matched", F.lit(False)))
    country = F.count_distinct(F.when(F.col("_matched"), F.col("country"))) + F.max((F.col("_matched") & F.col("country").isNull()).cast("int"))
    rolled = met.groupBy(key).agg(
        F.coalesce(F.sum("reach"), F.lit(0)).alias("source_reach_total"), F.avg("rank").alias("source_rank_mean"), F.min("rank").alias("source_rank_min"),
        F.count_distinct(F.when(F.col("_matched"), F.col("name"))).alias("source_diversity_n"), country.alias("source_diversity_country_n"), F.avg(F.col("paywall").cast("double")).alias("source_paywall_frac"),
        F.array_sort(F.collect_set("bias")).alias("source_bias_set"), F.count_if("_matched").alias("source_matched_count"),
    )
    out = stories.select(key, F.size(listed).alias("_n")).join(rolled, key, "left")
    return out.withColumn("source_unmatched_count", F.col("_n").cast("long") - F.coalesce("source_matched_count", F.lit(0))).drop("_n")
