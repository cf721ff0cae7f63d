"""Aggregations beyond the built-ins: concentration, variance components, histograms, drift, profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .buckets import quantiles_of
from .ranking import with_average_rank, with_prefix_sums, with_row_number


def value_counts(df: DataFrame, col: str, k: int) -> DataFrame:
    """value, n, share of the k most frequent values, and the column's cardinality; ties by value."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_all"), F.count(F.lit(1)).alias("cardinality"))
    top = counts.orderBy(F.col("n").desc(), "value").limit(k)
    return top.crossJoin(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("_all")).alias("share"), "cardinality")  # total is one row


def moment_skew(df: DataFrame, col: str, epsilon: float = 1e-9) -> DataFrame:
    """mean(((x - mean) / (std + epsilon)) ** 3) with the population deviation, from power sums of centred values."""
    center = df.agg(F.avg(col).alias("_m"), F.stddev_pop(col).alias("_s"))
    x = (F.col(col) - F.col("_m")) / (F.col("_s") + epsilon)
    return df.crossJoin(F.broadcast(center)).agg(F.avg(x * x * x).alias("skew"))  # center is one row


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """a, b, r of every pair of columns, all in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    wide = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def spearman(df: DataFrame, a: str, b: str, key: str, ties: str = "ordinal") -> DataFrame:
    """One row: rho. Ordinal ranks break ties by the key, average ranks keep them."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    if ties == "average":
        out = with_average_rank(with_average_rank(rows, a, "_ra"), b, "_rb")
    else:
        out, _ = with_row_number(rows, [a, key], "_ra")
        out, _ = with_row_number(out, [b, key], "_rb")
    return out.agg(F.corr(F.col("_ra").cast("double"), F.col("_rb").cast("double")).alias("rho"))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: mi of two discrete columns, in nats, from their joint counts."""
    joint = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    n_a, n_b = (F.sum("n").over(Window.partitionBy(c)) for c in (a, b))
    parts = joint.select("n", n_a.alias("n_a"), n_b.alias("n_b"))
    total = parts.agg(F.sum("n").alias("t"))
    return parts.crossJoin(F.broadcast(total)).agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("n_a") * F.col("n_b")))).alias("mi"))


def variance_components(df: DataFrame, y: str, key_sets: Sequence[Sequence[str]]) -> DataFrame:
    """keys, r2 = max(0, 1 - SSE / SST) of group means, for all key sets by one pass of grouping sets."""
    cols = sorted({c for s in key_sets for c in s})
    # SSE of a group is sum(y^2) - sum(y)^2 / n; values are centred by the overall mean first, for precision.
    mean = df.agg(F.avg(y).alias("_mean"))
    c = F.col(y) - F.col("_mean")
    sums = [F.count(y).alias("n"), F.sum(c).alias("s"), F.sum(c * c).alias("ss")]
    base = df.crossJoin(F.broadcast(mean))  # one row
    sets = [[F.col(c) for c in s] for s in key_sets]
    grouped = base.groupingSets(sets, *cols).agg(F.grouping_id().alias("_set"), *sums)
    width = len(cols)
    names = {sum(1 << (width - 1 - cols.index(c)) for c in cols if c not in s): ",".join(s) for s in key_sets}
    label = F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, v)])
    per = grouped.groupBy(F.element_at(label, F.col("_set").cast("int")).alias("keys")).agg(F.sum(F.col("ss") - F.col("s") * F.col("s") / F.col("n")).alias("sse"), F.sum("ss").alias("sst"))
    return per.select("keys", F.greatest(F.lit(0.0), 1 - F.try_divide("sse", "sst")).alias("r2"))


def lorenz(df: DataFrame, value: str, key: str) -> tuple[DataFrame, int, float]:
    """The rows in ascending order with place and cum (running sum), their number and total."""
    numbered, n = with_row_number(df.where(F.col(value).isNotNull()), [value, key], "place")
    summed, totals = with_prefix_sums(numbered, ["place"], {"cum": F.col(value)})
    return summed, n, totals["cum"]


def concentration(df: DataFrame, value: str, key: str, shares: Sequence[float] = (0.01, 0.05, 0.1, 0.2)) -> DataFrame:
    """measure, value: the share of the top p of the rows (those behind place ceil((1-p) n)), and the Gini index."""
    rows, n, total = lorenz(df, value, key)
    v = F.col(value)
    top = [(f"top_{p * 100:g}pct", F.sum(F.when(F.col("place") > F.ceil((1 - p) * F.lit(float(n))), v).otherwise(0)) / F.lit(float(total))) for p in shares]
    gini = ("gini", 2 * F.sum(F.col("place") * v) / (F.lit(float(n)) * F.lit(float(total))) - F.lit((n + 1) / n))
    wide = rows.agg(*[e.alias(k) for k, e in (*top, gini)])
    return wide.unpivot([], [k for k, _ in (*top, gini)], "measure", "value")


def count_of_counts(df: DataFrame, key: str) -> DataFrame:
    """times, n_keys: how many keys occur so often."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("times")).groupBy("times").agg(F.count(F.lit(1)).alias("n_keys"))


def crosstab(df: DataFrame, row: str, col: str, rows: Sequence[str], cols: Sequence[str], **metrics: Column) -> DataFrame:
    """row, col, n, share and metrics of every cell of the domain, empty cells kept."""
    seen = df.groupBy(row, col).agg(F.count(F.lit(1)).alias("n"), *[m.alias(k) for k, m in metrics.items()])
    domain = df.sparkSession.createDataFrame([(r, c) for r in rows for c in cols], f"{row} string, {col} string")
    out = domain.join(seen, [row, col], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # over the cells, a handful
    return out.withColumn("share", F.try_divide(F.col("n"), total))


def group_residual_variance(df: DataFrame, y: str, key: str, bucket: str) -> DataFrame:
    """bucket, n, resid_var: variance of y less its group's mean; null keys are one group.

    Means are aggregated and joined back, so rows of a large group needn't meet in one task.
    """
    keyed = df.select(F.struct(F.col(key).alias("k")).alias("_k"), F.col(bucket), F.col(y).alias("_y"))  # structs are equal where their nulls are
    means = keyed.groupBy("_k").agg(F.avg("_y").alias("_m"))
    resid = keyed.join(means, "_k").withColumn("_r", F.col("_y") - F.col("_m"))
    return resid.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"), F.var_pop("_r").alias("resid_var"))


def rate_drift(df: DataFrame, cohort: str, period: str, y: str) -> DataFrame:
    """cohort, first_rate, last_rate, drift: the rate in a cohort's first and last period."""
    by = df.groupBy(cohort, period).agg(F.avg(y).alias("rate"))
    return by.groupBy(cohort).agg(F.min_by("rate", period).alias("first_rate"), F.max_by("rate", period).alias("last_rate")).withColumn("drift", F.col("last_rate") - F.col("first_rate"))


def baseline_lift(df: DataFrame, cohort: str, y: str) -> DataFrame:
    """cohort, n, rate, lift against the first cohort; the window holds one row for each cohort."""
    by = df.groupBy(cohort).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("rate"))
    return by.withColumn("lift", F.col("rate") - F.first("rate").over(Window.partitionBy(F.lit(0)).orderBy(cohort)))


def degrees(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """node, degree."""
    return edges.select(F.explode(F.array(src, dst)).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def missingness(df: DataFrame) -> DataFrame:
    """column, n_null, share of every column, in one aggregation."""
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return wide.unpivot(["_n"], list(df.columns), "column", "n_null").select("column", "n_null", F.try_divide("n_null", "_n").alias("share"))


def profile(df: DataFrame, cols: Sequence[str], outcome: str) -> DataFrame:
    """column, n, n_null, mean, std, min, p50, max and correlation with the outcome: one aggregation, and one sort for all medians."""
    names = {"n": F.count, "n_null": lambda c: F.count_if(F.col(c).isNull()), "mean": F.avg, "std": F.stddev_pop, "low": F.min, "high": F.max,
             "corr": lambda c: F.corr(F.col(c).cast("double"), F.col(outcome).cast("double"))}
    wide = df.agg(*[f(c).cast("double").alias(f"{c}::{k}") for c in cols for k, f in names.items()])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}::{k}`").alias(k) for k in names]) for c in cols])
    medians = quantiles_of(df, cols, 0.5).select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("p50")) for c in cols])).alias("x")).select("x.*")
    return wide.select(F.explode(rows).alias("x")).select("x.*").join(medians, "column")
