"""As-of joins as one shuffle, one sort and one window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.times import micros


def asof_backward(
    left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str, take: Sequence[str], tie_break: str | None = None, tolerance: int | None = None, strict: bool = False
) -> DataFrame:
    """Each row of ``left`` with the columns ``take`` of the latest row of ``right`` of the same key, not later than it.

    ``by`` and ``right_on`` name the columns of both sides, the times must have one type. Of rows at the same time
    the one with the largest ``tie_break`` is taken. ``strict`` demands an earlier row. A match that is further back
    than ``tolerance`` (microseconds for timestamps, else in the column's unit) counts as none: any other would be
    further. Null keys match nothing. Both sides are unioned and sorted once for each key, so no pair of rows is made.
    """
    payload = F.struct(F.col(right_on).alias("_at"), *[F.col(c) for c in take])
    tie = F.col(tie_break) if tie_break else F.lit(0)
    there = F.col(right_on).isNotNull()
    for k in by:
        there &= F.col(k).isNotNull()
    r = right.where(there).select(*by, F.col(right_on).alias("_time"), F.lit(1 if strict else 0).alias("_side"), tie.alias("_tie"), payload.alias("_right"))
    l = left.select(*by, F.col(left_on).alias("_time"), F.lit(0 if strict else 1).alias("_side"), F.struct(*left.columns).alias("_left"))
    both = r.unionByName(l, allowMissingColumns=True)
    upto = Window.partitionBy(*by).orderBy(F.col("_time").asc_nulls_first(), "_side", F.col("_tie").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    hit = both.withColumn("_hit", F.last("_right", ignorenulls=True).over(upto)).where("_left is not null")
    if tolerance is not None:
        timed = dict(left.dtypes)[left_on].startswith(("timestamp", "date"))
        gap = micros(F.col("_time")) - micros(F.col("_hit._at")) if timed else F.col("_time") - F.col("_hit._at")
        hit = hit.withColumn("_hit", F.when(gap <= tolerance, F.col("_hit")))
    # The keys come from the window's own partitioning columns, so that later windows by key need no new shuffle.
    kept = [F.col(c) if c in by else F.col(f"_left.{c}").alias(c) for c in left.columns]
    return hit.select(*kept, *[F.col(f"_hit.{c}").alias(c) for c in take])
