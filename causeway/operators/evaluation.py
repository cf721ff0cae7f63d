"""Exact, tie-aware model evaluation as aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.times import quarter_label
from .buckets import fixed_bins, quantile_cuts
from .ranking import with_keyed_prefix_sums, with_prefix_sums


def _by_score(df: DataFrame, score: str, label: str, weight: Column | None, keys: Sequence[str]) -> DataFrame:
    w = F.lit(1).cast("long") if weight is None else weight
    there = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(label).isNotNull())
    return there.groupBy(*keys, score).agg(F.sum(F.when(F.col(label) == 1, w).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) == 1, 0).otherwise(w)).alias("neg"))


def auc(df: DataFrame, score: str, label: str, weight: Column | None = None) -> DataFrame:
    """One row: auc, n_pos, n_neg; auc is null unless both classes are there.

    Rows meet by score first, so ties cost nothing; prefix sums over the distinct scores are taken in parallel.
    """
    summed, totals = with_prefix_sums(_by_score(df, score, label, weight, ()), [score], {"_neg": F.col("neg")})
    return summed.agg(
        F.sum(F.col("pos") * (F.col("_neg") - F.col("neg") / 2)).alias("area"), F.coalesce(F.sum("pos"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum("neg"), F.lit(0)).alias("n_neg")
    ).select(F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("area") / F.col("n_pos") / F.col("n_neg")).alias("auc"), "n_pos", "n_neg")


def auc_by(df: DataFrame, score: str, label: str, keys: Sequence[str], weight: Column | None = None, least_rows: int = 0) -> DataFrame:
    """keys, auc, n_pos, n_neg for each group with both classes and at least ``least_rows`` rows."""
    summed = with_keyed_prefix_sums(_by_score(df, score, label, weight, keys), keys, [score], {"_neg": F.col("neg")})
    out = summed.groupBy(*keys).agg(F.sum(F.col("pos") * (F.col("_neg") - F.col("neg") / 2)).alias("area"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    out = out.where((F.col("n_pos") > 0) & (F.col("n_neg") > 0) & (F.col("n_pos") + F.col("n_neg") >= least_rows))
    return out.select(*keys, (F.col("area") / F.col("n_pos") / F.col("n_neg")).alias("auc"), "n_pos", "n_neg")


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: average_precision, precision at each distinct score weighted by its gain of recall."""
    summed, totals = with_prefix_sums(_by_score(df, score, label, None, ()), [F.col(score).desc()], {"_tp": F.col("pos"), "_all": F.col("pos") + F.col("neg")})
    return summed.agg((F.sum(F.col("pos") * F.col("_tp") / F.col("_all")) / F.sum("pos")).alias("average_precision"))


def log_loss(label: Column, score: Column) -> Column:
    p = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), score))
    return -(label * F.ln(p) + (1 - label) * F.ln(1 - p))


def psi(df: DataFrame, value: Column, is_actual: Column, n_bins: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """Population stability index (of each group) of actual against expected rows, over fixed bins of [0, 1]."""
    counts = df.select(*keys, fixed_bins(value, F.lit(0.0), F.lit(1.0), n_bins).alias("bin"), is_actual.alias("actual")).where("bin is not null")
    wide = counts.groupBy(*keys).agg(*[F.count_if((F.col("bin") == b) & (F.col("actual") == a)).alias(f"c{int(a)}_{b}") for a in (False, True) for b in range(n_bins)])

    def share(a: int, b: int) -> Column:
        total = sum((F.col(f"c{a}_{k}") for k in range(n_bins)), F.lit(0))
        return (F.col(f"c{a}_{b}") + 1e-8) / (total + 1e-8 * n_bins)

    return wide.select(*keys, sum(((share(1, b) - share(0, b)) * F.ln(share(1, b) / share(0, b)) for b in range(n_bins)), F.lit(0.0)).alias("psi"))


def walk_forward_folds(df: DataFrame, at: str) -> DataFrame:
    """fold, k, n_train, n_test: each quarter after the first is tested on, all earlier ones are trained on.

    Rows are counted once by quarter; only the few quarters meet in a window.
    """
    quarters = df.groupBy(quarter_label(F.col(at)).alias("fold")).agg(F.count(F.lit(1)).alias("n_test"))
    w = Window.partitionBy(F.lit(0)).orderBy("fold")
    out = quarters.select("fold", F.row_number().over(w).alias("k"), F.sum("n_test").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("n_train"), "n_test")
    return out.where("k > 1").select("fold", (F.col("k") - 1).alias("k"), "n_train", "n_test")


def kaplan_meier(df: DataFrame, time: str, event: str) -> DataFrame:
    """time, at_risk, events, survival after each time with an event, from rows (time, event 0/1)."""
    steps = df.where(F.col(time).isNotNull()).groupBy(F.col(time).alias("time")).agg(F.sum(F.col(event)).alias("events"), F.count(F.lit(1)).alias("n"))
    summed, totals = with_prefix_sums(steps, ["time"], {"_gone": F.col("n")})
    risk = summed.withColumn("at_risk", F.lit(int(totals["_gone"])) - F.col("_gone") + F.col("n")).where("events > 0")
    # survival is a product: a running sum of logarithms; where all at risk have the event it is 0 from there on.
    logs = F.when(F.col("events") < F.col("at_risk"), F.ln(1 - F.col("events") / F.col("at_risk"))).otherwise(F.lit(-1e9))
    out, _ = with_prefix_sums(risk, ["time"], {"_log": logs})
    return out.select("time", "at_risk", "events", F.exp("_log").alias("survival"))


def median_survival(curve: DataFrame) -> DataFrame:
    """One row: median, the first time at which half or fewer survive; null if more than half outlast the last event.

    ``curve`` is that of ``kaplan_meier``; a survival within 1e-12 of one half counts as one half.
    """
    return curve.agg(F.min(F.when(F.col("survival") <= 0.5 + 1e-12, F.col("time"))).alias("median"))


def label_noise(df: DataFrame, score: str, label: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Rows whose label fights their score: 0 above the upper, 1 below the lower score quantile; with gap."""
    cuts = quantile_cuts(df, score, [low, high]).select(F.col("q0").alias("_low"), F.col("q1").alias("_high"))
    rows = df.crossJoin(F.broadcast(cuts))  # one row of two numbers
    noisy = ((F.col(label) == 0) & (F.col(score) > F.col("_high"))) | ((F.col(label) == 1) & (F.col(score) < F.col("_low")))
    return rows.where(noisy).withColumn("gap", F.abs(F.col(score) - F.col(label))).drop("_low", "_high")
