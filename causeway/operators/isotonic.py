"""Increasing curves fitted by pooling adjacent violators, over points of any number.

Points are sorted by range and each partition pools its own; pools of neighbouring partitions then merge, pair by pair up
a tree. Pools of a side increase, so a merge only looks outward from the border: it takes in pools of both sides until the
next ones fit, and what it needs is a window of pools at the border, widened where it doesn't suffice. No task holds a curve.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import persist_shared
from .ranking import with_row_number

#: Pools on each side of a border that a merge looks at first.
WINDOW = 1024


def _pooled(first: list, last: list, total: list, weight: list) -> tuple[list, list, list, list]:
    """Pools of a sequence, as a stack."""
    a, b, s, w = [], [], [], []
    for x, y, t, v in zip(first, last, total, weight):
        a.append(x)
        b.append(y)
        s.append(t)
        w.append(v)
        while len(s) > 1 and s[-2] * w[-1] >= s[-1] * w[-2]:
            t, v, y = s.pop(), w.pop(), b.pop()
            a.pop()
            s[-1] += t
            w[-1] += v
            b[-1] = y
    return a, b, s, w


def _pool_partitions(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pools of the points of each key in a partition; holds the pools of one key."""
    held = None

    def answer() -> pd.DataFrame:
        return pd.DataFrame({"key": held[0], "node": held[1], "first": held[2][0], "last": held[2][1], "total": held[2][2], "weight": held[2][3]})

    for f in frames:
        for (key, node), g in f.groupby(["key", "node"], sort=False):
            if held is not None and held[:2] != (key, node):
                yield answer()
                held = None
            before = held[2] if held else ([], [], [], [])
            held = (key, node, _pooled(*(old + g[c].tolist() for old, c in zip(before, ("x", "x", "total", "weight")))))
    if held is not None:
        yield answer()


def _merge(width: int):
    """The pool across a border, from the last pools of side 0 and the first of side 1; short if the window is used up."""

    def work(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("first", kind="stable")
        left, right = g[g["side"] == 0], g[g["side"] == 1]
        out = {"key": [g["key"].iloc[0]], "pair": [g["pair"].iloc[0]], "first": [0.0], "last": [0.0], "total": [0.0], "weight": [0.0], "short": [False]}
        if len(left) and len(right):
            l, r = (x[["first", "last", "total", "weight"]].to_numpy() for x in (left, right))
            i, j, s, w = len(l), 0, 0.0, 0.0  # pools l[i:] and r[:j] are taken in
            if l[-1, 2] * r[0, 3] >= r[0, 2] * l[-1, 3]:
                i, j, s, w = i - 1, 1, l[-1, 2] + r[0, 2], l[-1, 3] + r[0, 3]
                while True:
                    if i and l[i - 1, 2] * w >= s * l[i - 1, 3]:
                        i -= 1
                        s, w = s + l[i, 2], w + l[i, 3]
                    elif j < len(r) and s * r[j, 3] >= r[j, 2] * w:
                        s, w = s + r[j, 2], w + r[j, 3]
                        j += 1
                    else:
                        break
                out |= {"first": [l[i, 0]], "last": [r[j - 1, 1]], "total": [s], "weight": [w], "short": [(i == 0 and len(l) == width) or (j == len(r) and len(r) == width)]}
        return pd.DataFrame(out)

    return work


def isotonic_pools(points: DataFrame, window: int = WINDOW) -> DataFrame:
    """key, first, last, value: pools of points (key int, x, total, weight) with distinct x, by key; value rises with x."""
    placed = persist_shared(points.sort("key", "x").withColumn("node", F.spark_partition_id()), "isotonic-points")
    # Rows of a sorted partition may come back in several files: they are put together again.
    again = placed.repartition("node").sortWithinPartitions("node", "key", "x")
    kind = "key int, node int, first double, last double, total double, weight double"
    pools = persist_shared(again.mapInPandas(_pool_partitions, kind), "isotonic-pools")
    nodes, span = (pools.agg(F.max("node")).first()[0] or 0) + 1, 1
    while span < nodes:
        pair, side = F.floor(F.col("node") / (2 * span)).cast("int"), F.floor(F.col("node") / span) % 2
        sided = pools.withColumns({"pair": pair, "side": side.cast("int")})
        near = F.row_number().over(Window.partitionBy("key", "pair", "side").orderBy(F.when(F.col("side") == 0, -F.col("first")).otherwise(F.col("first"))))
        width = window
        while True:
            some = sided.withColumn("_n", near).where(F.col("_n") <= width).drop("_n")
            merged = persist_shared(some.groupBy("key", "pair").applyInPandas(_merge(width), "key int, pair int, first double, last double, total double, weight double, short boolean"), "isotonic-merged")
            if merged.where("short").isEmpty():
                break
            width *= 8
        merged = merged.where("weight > 0").drop("short")
        gone = merged.select("key", "pair", F.col("first").alias("_from"), F.col("last").alias("_to"))
        kept = sided.join(gone, ["key", "pair"], "left").where("_from is null or first < _from or first > _to").select(*pools.columns)
        made = merged.select("key", (F.col("pair") * 2 * span).alias("node"), "first", "last", "total", "weight")
        pools, span = persist_shared(kept.unionByName(made), "isotonic-pools"), span * 2
    return pools.select("key", "first", "last", (F.col("total") / F.col("weight")).alias("value"))


def with_curve(rows: DataFrame, key, x: str, pools: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``name``: the value of the key's curve at ``x`` of 0 to 1, linear between pools, flat beyond its ends.

    Rows meet pools in as many cells of the range as there are pools; a pool lies in all cells up to the next one. Rows of a key
    without a curve are left out.
    """
    numbered, n = with_row_number(pools, ["key", "first"], "_i")
    after = numbered.select(F.col("key").alias("_k"), (F.col("_i") - 1).alias("_j"), F.col("first").alias("_next"), F.col("value").alias("_next_value"))
    joined = persist_shared(numbered.join(after, (F.col("key") == F.col("_k")) & (F.col("_i") == F.col("_j")), "left").drop("_k", "_j"), "curve-pools")
    least = joined.groupBy("key").agg(F.min("first").alias("_least"))  # one for each key
    cells = max(n, 1)
    cell = lambda v: F.least(F.floor(v * cells), F.lit(cells)).cast("long")
    begins = F.when(F.col("first") == F.col("_least"), F.lit(0.0)).otherwise(F.col("first"))
    spread = joined.join(F.broadcast(least), "key").select(
        F.col("key").alias("_key"), begins.alias("_from"), "last", "value", "_next", "_next_value",
        F.explode(F.sequence(cell(begins), cell(F.coalesce("_next", F.lit(1.0))))).alias("_cell"),
    )
    keyed = rows.withColumns({"_key": key, "_cell": cell(F.col(x))})
    met = keyed.join(spread, ["_key", "_cell"]).where((F.col(x) >= F.col("_from")) & (F.col("_next").isNull() | (F.col(x) < F.col("_next"))))
    slope = (F.col("_next_value") - F.col("value")) / (F.col("_next") - F.col("last"))
    value = F.when(F.col("_next").isNull() | (F.col(x) <= F.col("last")), F.col("value")).otherwise(F.col("value") + (F.col(x) - F.col("last")) * slope)
    return met.select(*[c for c in rows.columns], value.alias(name))
