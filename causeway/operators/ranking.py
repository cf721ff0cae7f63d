"""Row numbers, prefix sums and ranks over a whole table without a single-task window.

The table is sorted by range and written to the shared folder, each sorted partition is summed, and the few partition
totals (one row for each partition) become offsets. What is placed once isn't sorted again, whatever is lost meanwhile.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import persist_shared


def _placed(df: DataFrame, order: Sequence) -> DataFrame:
    # monotonically_increasing_id: the partition above bit 33, the row within it below.
    return persist_shared(df.sort(*order).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "placed")


def _offset(totals: dict[int, float], part: Column, kind: str) -> Column:
    pairs = [F.lit(x) for p, t in totals.items() for x in (p, t)]
    return F.element_at(F.create_map(*pairs), part).cast(kind) if pairs else F.lit(0).cast(kind)


def _before(parts: list[tuple[int, float]]) -> dict[int, float]:
    out, total = {}, 0
    for p, n in sorted(parts):
        out[p] = total
        total += n or 0
    return out


def with_row_number(df: DataFrame, order: Sequence, name: str) -> tuple[DataFrame, int]:
    """The table with its rows numbered from 1 in the order, and their number."""
    placed = _placed(df, order)
    parts = [(r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()]
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.withColumn(name, _offset(_before(parts), F.col("_part"), "long") + within).drop("_at", "_part"), sum(n for _, n in parts)


def with_prefix_sums(df: DataFrame, order: Sequence, sums: dict[str, Column]) -> tuple[DataFrame, dict[str, float]]:
    """The table with the running sum (this row included) of each expression, and the totals."""
    placed = _placed(df.withColumns({f"_v_{k}": v for k, v in sums.items()}), order)
    parts = placed.groupBy("_part").agg(*[F.sum(f"_v_{k}").alias(k) for k in sums]).collect()
    w = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    kinds = dict(placed.dtypes)
    out = placed.withColumns(
        {k: F.sum(f"_v_{k}").over(w) + _offset(_before([(r["_part"], r[k]) for r in parts]), F.col("_part"), "double" if kinds[f"_v_{k}"] == "double" else "long") for k in sums}
    )
    return out.drop("_at", "_part", *[f"_v_{k}" for k in sums]), {k: sum(r[k] or 0 for r in parts) for k in sums}


def with_keyed_prefix_sums(df: DataFrame, keys: Sequence[str], order: Sequence, sums: dict[str, Column]) -> DataFrame:
    """The table with the running sum (this row included) of each expression within its key; null keys are one key.

    A key's rows may lie in many sorted partitions: each is summed on its own and starts from the totals of the key's
    earlier ones, one row for each key and partition. So no task holds all rows of a key.
    """
    placed = _placed(df.withColumns({f"_v_{k}": v for k, v in sums.items()}), [*keys, *order])
    parts = placed.groupBy(*keys, "_part").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), *[F.sum(f"_t_{k}").over(earlier).alias(f"_s_{k}") for k in sums])
    within = Window.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumns({f"_w_{k}": F.sum(f"_v_{k}").over(within) for k in sums})
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same &= summed[k].eqNullSafe(starts[f"_k{i}"])
    out = summed.join(starts, same).withColumns({k: F.col(f"_w_{k}") + F.coalesce(F.col(f"_s_{k}"), F.lit(0)) for k in sums})
    return out.select(*df.columns, *sums)


def with_average_rank(df: DataFrame, col: str, name: str) -> DataFrame:
    """Rank of each row by ``col``, ties at their mean: ranks of distinct values joined back."""
    ties = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    upto, _ = with_prefix_sums(ties, [col], {"_upto": F.col("_n")})
    ranks = upto.select(F.col(col).alias("_value"), (F.col("_upto") - (F.col("_n") - 1) / 2).alias(name))
    return df.join(ranks, df[col] == ranks["_value"], "left").drop("_value")
