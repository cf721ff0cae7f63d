"""Window operators, all by key and in time order, with explicit tie-breaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

BEFORE = (Window.unboundedPreceding, -1)


def ordered(keys: Sequence[str], *order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def next_value(col: str, keys: Sequence[str], order: Sequence[str], last: Column | None = None) -> Column:
    """The value of the next row; the last row has ``last`` (or null)."""
    lead = F.lead(col).over(ordered(keys, *order))
    return lead if last is None else F.coalesce(lead, last)


def is_first(keys: Sequence[str], order: Sequence[str]) -> Column:
    return F.row_number().over(ordered(keys, *order)) == 1


def exclusive_sum(col: str, keys: Sequence[str], order: Sequence[str]) -> Column:
    """Running sum of the rows before this one, 0 for the first."""
    return F.coalesce(F.sum(col).over(ordered(keys, *order).rowsBetween(*BEFORE)), F.lit(0))


def strict_prior(agg: Column, keys: Sequence[str], instant: str, least: int = 1) -> Column:
    """An aggregate over all rows at an earlier instant (an integer column): peers never see each other."""
    return agg.over(Window.partitionBy(*keys).orderBy(instant).rangeBetween(Window.unboundedPreceding, -least))


def rolling_prior_sum(col: str, n: int, keys: Sequence[str], order: Sequence[str], partial: bool = False) -> Column:
    """Sum of the last ``n`` rows before this one; 0 until there are ``n``, unless ``partial``."""
    frame = ordered(keys, *order).rowsBetween(-n, -1)
    total = F.coalesce(F.sum(col).over(frame), F.lit(0))
    return total if partial else F.when(F.count(col).over(frame) == n, total).otherwise(F.lit(0))


def trailing_days(agg: Column, keys: Sequence[str], day: str, days: int) -> Column:
    """An aggregate over the ``days`` days that end yesterday; ``day`` is an integer day number."""
    return agg.over(Window.partitionBy(*keys).orderBy(day).rangeBetween(-days, -1))


def rows_since(df: DataFrame, flag: str, keys: Sequence[str], order: Sequence[str], name: str, never: int | None = 999) -> DataFrame:
    """Rows since the last earlier row with the flag: 0 right after it, ``never`` before the first (None: counted on)."""
    w = ordered(keys, *order)
    epoch = F.coalesce(F.sum(F.col(flag).cast("int")).over(w.rowsBetween(*BEFORE)), F.lit(0))
    out = df.withColumn("_epoch", epoch)
    nth = F.row_number().over(ordered([*keys, "_epoch"], *order)) - 1
    return out.withColumn(name, nth if never is None else F.when(F.col("_epoch") == 0, F.lit(never)).otherwise(nth)).drop("_epoch")


def runs(df: DataFrame, flag: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Maximal runs of flagged rows: keys, first, length; ``first`` is the first order column at the start."""
    w = ordered(keys, *order)
    island = F.row_number().over(w) - F.sum(F.col(flag).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_island", island).where(F.col(flag)).groupBy(*keys, "_island").agg(F.min(order[0]).alias("first"), F.count(F.lit(1)).alias("length")).drop("_island")


def consecutive_prior(df: DataFrame, flag: str, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Length of the unbroken run of unflagged rows right before this one: the rows since the last flag."""
    return rows_since(df, flag, keys, order, name, None)


def last_before(col: Column, keys: Sequence[str], order: Sequence[str]) -> Column:
    """The greatest value of the rows before; for a value that grows with the order this is a forward fill."""
    return F.max(col).over(ordered(keys, *order).rowsBetween(*BEFORE))


def average_rank(order: Column, keys: Sequence[str] = ()) -> Column:
    """Rank with ties at their mean."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(order)) + (F.count(F.lit(1)).over(w.partitionBy(*keys, order)) - 1) / 2


def last_row_wins(df: DataFrame, keys: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """The latest row of each key."""
    latest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in seq])
    return df.withColumn("_nth", F.row_number().over(latest)).where("_nth = 1").drop("_nth")


def trailing_streak(df: DataFrame, flag: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """keys, streak: how many of the last rows are flagged without a break; one aggregation after one sort."""
    back = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    broken = F.sum((~F.col(flag)).cast("int")).over(back.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_broken", broken).groupBy(*keys).agg(F.count_if(F.col("_broken") == 0).alias("streak"))
