"""Bucketing: right-closed cuts, left-closed bins, quantile cuts, equal-count chunks, histograms."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import with_prefix_sums, with_row_number

#: Tenure bounds in days (right-closed) and their labels, count bounds (left-closed) and labels.
TENURE_BREAKS = (7, 30, 90, 180, 365, 730)
TENURE_LABELS = ("0-7d", "8-30d", "31-90d", "91-180d", "181-365d", "1-2yr", "2yr+")
COUNT_BREAKS = (1, 2, 5, 20)
COUNT_LABELS = ("0", "1", "2-4", "5-19", "20+")


def cut_right(value: Column, breaks: Sequence[float], labels: Sequence[str]) -> Column:
    """(a, b] intervals; null stays null."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for b, label in zip(breaks, labels):
        out = out.when(value <= b, label)
    return out.otherwise(labels[-1])


def cut_left(value: Column, breaks: Sequence[float], labels: Sequence[str]) -> Column:
    """[a, b) intervals; null stays null."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for b, label in zip(breaks, labels):
        out = out.when(value < b, label)
    return out.otherwise(labels[-1])


def _at_places(df: DataFrame, col: str, keys: Sequence[str], wanted: Callable[[Column], list[tuple[Column, Column]]]) -> DataFrame:
    """keys, i, weight, value: the elements at places (from 0) of each key's sorted non-null values.

    ``wanted`` gives (place, weight) pairs from the number of values. The table is sorted by range once and numbered, so
    a key's values may lie in many partitions and no task holds them all; only the wanted rows are joined. Without keys
    values are counted first and only distinct ones are sorted, so one that repeats is no large range of its own.
    """
    each = lambda n: F.explode(F.array(*[F.struct(F.lit(i).alias("i"), place.cast("long").alias("at"), weight.cast("double").alias("weight")) for i, (place, weight) in enumerate(wanted(n))]))
    if not keys:
        tied = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("_c"))
        upto, n = with_prefix_sums(tied, ["value"], {"_upto": F.col("_c")})
        points = F.broadcast(df.sparkSession.range(1).select(each(F.lit(n["_upto"])).alias("p")).select("p.*"))  # two rows for each quantile
        return upto.join(points, (F.col("at") >= F.col("_upto") - F.col("_c")) & (F.col("at") < F.col("_upto"))).select("i", "weight", "value")
    placed, _ = with_row_number(df.where(F.col(col).isNotNull()).select(*keys, F.col(col).alias("value")), [*keys, "value"], "_n")
    bounds = placed.groupBy(*keys).agg(F.min("_n").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    points = bounds.select(*[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)], "_first", each(F.col("_rows")).alias("p"))
    points = points.select(*[c for c in points.columns if c.startswith("_k")], (F.col("_first") + F.col("p.at")).alias("_n"), "p.i", "p.weight")
    return placed.select("_n", "value").join(points, "_n").select(*[F.col(f"_k{j}").alias(k) for j, k in enumerate(keys)], "i", "weight", "value")


def quantile_cuts(df: DataFrame, col: str, shares: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """One row (for each key) with linear quantiles q0, q1, ...; keys without a value have none."""

    def wanted(n: Column) -> list[tuple[Column, Column]]:
        out = []
        for s in shares:
            at = F.lit(float(s)) * (n - 1)
            out += [(F.floor(at), F.ceil(at) - at), (F.ceil(at), at - F.floor(at))]
        return out

    found = _at_places(df, col, keys, wanted)
    low, high = ({i: F.max(F.when(F.col("i") == 2 * i + side, F.col("value"))) for i in range(len(shares))} for side in (0, 1))
    weight = {i: F.max(F.when(F.col("i") == 2 * i, F.col("weight"))) for i in range(len(shares))}
    # Where both elements are equal, or the place is one, nothing is interpolated.
    cut = lambda i: F.when((low[i] == high[i]), low[i].cast("double")).otherwise(weight[i] * low[i] + (1 - weight[i]) * high[i])
    return found.groupBy(*keys).agg(*[cut(i).alias(f"q{i}") for i in range(len(shares))])


def quantiles_of(df: DataFrame, cols: Sequence[str], share: float, keys: Sequence[str] = ()) -> DataFrame:
    """One row (for each key) with the linear quantile of each column under its name, null without a value.

    The columns are stacked as (name, value), so one sort and one written table serve all of them.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("_name"), F.col(c).cast("double").alias("_value")) for c in cols])).alias("_x")
    found = quantile_cuts(df.select(*keys, each).select(*keys, "_x.*"), "_value", [share], ["_name", *keys])
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == c, F.col("q0"))).alias(c) for c in cols])


def quantile_bucket(df: DataFrame, col: str, n: int, name: str) -> DataFrame:
    """Right-closed buckets 0..n-1 between the linear quantiles; repeated cut points leave buckets empty."""
    cuts = quantile_cuts(df, col, [i / n for i in range(1, n)])
    index = sum((F.col(col) > F.col(f"q{i}")).cast("int") for i in range(n - 1))
    return df.crossJoin(F.broadcast(cuts)).withColumn(name, index).drop(*cuts.columns)


def nearest_quantile(df: DataFrame, col: str, shares: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """The element at place ``round(q * (n - 1))`` (half to even) of the sorted non-null values: keys, share, value."""
    found = _at_places(df, col, keys, lambda n: [(F.bround(F.lit(float(s)) * (n - 1)), F.lit(1.0)) for s in shares])
    return found.select(*keys, F.element_at(F.array(*[F.lit(float(s)) for s in shares]), F.col("i") + 1).alias("share"), "value")


def equal_chunks(df: DataFrame, order: Sequence[str], n: int, name: str) -> DataFrame:
    """Chunks of floor(rows / n) rows in the order; the last chunk takes the remainder."""
    numbered, total = with_row_number(df, order, "_nth")
    size = max(total // n, 1)
    return numbered.withColumn(name, F.least(F.floor((F.col("_nth") - 1) / size), F.lit(n - 1)).cast("int")).drop("_nth")


def winsorize(df: DataFrame, col: str, share: float, name: str) -> DataFrame:
    """The column with its upper tail cut at the nearest-rank quantile."""
    cap = nearest_quantile(df, col, [share]).select(F.col("value").alias("_cap"))
    return df.crossJoin(F.broadcast(cap)).withColumn(name, F.least(F.col(col), F.col("_cap"))).drop("_cap")


def fixed_bins(value: Column, low: Column, high: Column, n: int) -> Column:
    """0..n-1 of equal width between the bounds; values beyond them fall in the end bins, the top bound in the last."""
    index = F.floor((value - low) / ((high - low) / n)).cast("int")
    return F.when(value.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(n - 1), F.coalesce(index, F.lit(0)))))
