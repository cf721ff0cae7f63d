"""Queries over run ledgers: leaderboard, champion, cost sums, plateaus, curriculum tiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.topk import ranked


def leaderboard(runs: DataFrame, run: str, metric: str, k: int) -> DataFrame:
    """run, metric, place and lift against the champion, of the k best runs."""
    top = ranked(runs.where(F.col(metric).isNotNull()), [F.col(metric).desc(), run], k, "place")
    return top.withColumn("lift", F.col(metric) - F.max(metric).over(Window.partitionBy(F.lit(0))))


def champions(runs: DataFrame, group: str, run: str, metric: str, order: str) -> DataFrame:
    """Each run with the best metric so far in its group, and whether it set it."""
    w = Window.partitionBy(group).orderBy(order, run)
    best = F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, 0))
    before = F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return runs.withColumn("best_so_far", best).withColumn("is_champion", F.coalesce(F.col(metric) > before, F.lit(True)))


def cost_sums(costs: DataFrame, keys: Sequence[str], cost: str) -> DataFrame:
    """keys, n_calls, total: every grouping of the keys in one pass; null keys mean all."""
    return costs.rollup(*keys).agg(F.count(F.lit(1)).alias("n_calls"), F.sum(cost).alias("total"))


def idea_tier(score: Column) -> Column:
    """The thresholds of the tiers."""
    return F.when(score >= 0.80, "A").when(score >= 0.60, "B").when(score >= 0.40, "C").otherwise("D")


def idea_score(parts: dict[str, float]) -> Column:
    """Weighted sum of columns clamped to [0, 1]."""
    total = sum((w * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c))) for c, w in parts.items()), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))
