"""Data-quality gates: each reads the table in one aggregation and answers rows that say what holds."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class GateError(ValueError):
    """A gate that must hold does not."""


def null_key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n_rows, null_cells (a row counts once for each null key), null_rows."""
    cells = sum((F.count_if(F.col(k).isNull()) for k in keys[1:]), F.count_if(F.col(keys[0]).isNull()))
    some = F.col(keys[0]).isNull()
    for k in keys[1:]:
        some |= F.col(k).isNull()
    return df.agg(F.count(F.lit(1)).alias("n_rows"), cells.alias("null_cells"), F.count_if(some).alias("null_rows"))


def drop_null_keys(df: DataFrame, keys: Sequence[str], most: float = 0.01) -> DataFrame:
    """The rows without a null key; GateError if null cells exceed the share of rows."""
    seen = null_key_counts(df, keys).first()
    if seen["n_rows"] and seen["null_cells"] / seen["n_rows"] > most:
        raise GateError(f"{seen['null_cells']} null keys in {seen['n_rows']} rows")
    return df.dropna(subset=list(keys))


def band(value: Column, hard: tuple[float, float], soft: tuple[float, float]) -> Column:
    """ABORT outside the hard band, WARN outside the soft one, else OK."""
    return F.when(~value.between(*hard), "ABORT").when(~value.between(*soft), "WARN").otherwise("OK")


def row_count_gate(df: DataFrame, hard: tuple[int, int], soft: tuple[int, int]) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("verdict", band(F.col("n_rows"), hard, soft))


def one_to_one_gate(before: DataFrame, after: DataFrame, required: Sequence[str], when: str, conditional: Sequence[str]) -> DataFrame:
    """n_before, n_after, required_nulls, conditional_nulls (of rows where ``when`` is not null), holds."""
    nulls = lambda cols: sum((F.coalesce(F.sum(F.col(c).isNull().cast("long")), F.lit(0)) for c in cols), F.lit(0))
    seen = after.agg(F.count(F.lit(1)).alias("n_after"), nulls(required).alias("required_nulls"), sum((F.count_if(F.col(when).isNotNull() & F.col(c).isNull()) for c in conditional), F.lit(0)).alias("conditional_nulls"))
    out = before.agg(F.count(F.lit(1)).alias("n_before")).crossJoin(seen)  # one row each
    return out.withColumn("holds", (F.col("n_before") == F.col("n_after")) & (F.col("required_nulls") == 0) & (F.col("conditional_nulls") == 0))


def coverage_gate(df: DataFrame, scope: Column, found: Column, warn: float, abort: float) -> DataFrame:
    """n_scope, n_found, share, verdict; an empty scope is skipped."""
    out = df.agg(F.count_if(scope).alias("n_scope"), F.count_if(scope & found).alias("n_found")).withColumn("share", F.try_divide("n_found", "n_scope"))
    return out.withColumn("verdict", F.when(F.col("n_scope") == 0, "SKIP").when(F.col("share") < abort, "ABORT").when(F.col("share") < warn, "WARN").otherwise("OK"))


def missing_categories(df: DataFrame, col: str, expected: Sequence[str]) -> DataFrame:
    """The expected values that do not occur."""
    wanted = df.sparkSession.createDataFrame([(x,) for x in expected], f"{col} string")
    return wanted.join(df.select(col).distinct(), col, "left_anti")


def key_audit(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n_rows, n_keys, n_null_keys, n_duplicates."""
    whole = F.col(keys[0]).isNotNull()
    for k in keys[1:]:
        whole &= F.col(k).isNotNull()
    out = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.when(whole, F.struct(*keys))).alias("n_keys"), F.count_if(~whole).alias("n_null_keys"))
    return out.withColumn("n_duplicates", F.col("n_rows") - F.col("n_null_keys") - F.col("n_keys"))


def forbid_columns(df: DataFrame, forbidden: Sequence[str]) -> DataFrame:
    """The table, or GateError if it has a column that gives the outcome away."""
    found = sorted(set(df.columns) & set(forbidden))
    if found:
        raise GateError(f"forbidden columns: {found}")
    return df


def metric_bands(df: DataFrame, metric: str, value: str, bands: Mapping[str, tuple[float, float]]) -> DataFrame:
    """metric, value, verdict: BELOW, OK or ABOVE the metric's band, null without a band."""
    low = F.create_map(*[F.lit(x) for k, (a, _) in bands.items() for x in (k, float(a))])
    high = F.create_map(*[F.lit(x) for k, (_, b) in bands.items() for x in (k, float(b))])
    a, b = F.try_element_at(low, F.col(metric)), F.try_element_at(high, F.col(metric))
    return df.select(metric, value, F.when(F.col(value) < a, "BELOW").when(F.col(value) > b, "ABOVE").when(a.isNotNull(), "OK").alias("verdict"))


def throughput_plan(df: DataFrame, rows: str, seconds: str, total_rows: int, expected_rate: float) -> DataFrame:
    """rate, projected_minutes, deviation of each probe from the expected rate."""
    rate = F.try_divide(F.col(rows), F.col(seconds))
    return df.withColumn("rate", rate).withColumn("projected_minutes", F.try_divide(F.lit(float(total_rows)), F.col("rate")) / 60).withColumn("deviation", F.col("rate") / expected_rate)


def require(df: DataFrame, column: str, good: Sequence[Any]) -> DataFrame:
    """The gate's rows, or GateError if one of them is not good."""
    bad = df.where(~F.col(column).isin(list(good))).limit(5).collect()
    if bad:
        raise GateError(f"gate failed: {[r.asDict() for r in bad]}")
    return df


@dataclass
class RowCount:
    """n_rows within the hard band or the write is refused, outside the soft one a warning."""

    hard: tuple[int, int]
    soft: tuple[int, int]

    def metrics(self) -> dict[str, Column]:
        return {"n_rows": F.count(F.lit(1))}

    def verdict(self, seen: Mapping[str, int]) -> str:
        n = seen["n_rows"]
        return "ABORT" if not self.hard[0] <= n <= self.hard[1] else "OK" if self.soft[0] <= n <= self.soft[1] else "WARN"


@dataclass
class Nulls:
    """No nulls in the required columns, nor in the conditional ones where ``when`` is not null."""

    required: Sequence[str]
    when: str | None = None
    conditional: Sequence[str] = ()

    def metrics(self) -> dict[str, Column]:
        count = lambda found: F.coalesce(F.sum(sum((f.cast("long") for f in found), F.lit(0).cast("long"))), F.lit(0).cast("long"))
        out = {"required_nulls": count([F.col(c).isNull() for c in self.required])}
        return out | ({"conditional_nulls": count([F.col(self.when).isNotNull() & F.col(c).isNull() for c in self.conditional])} if self.when else {})

    def verdict(self, seen: Mapping[str, int]) -> str:
        return "ABORT" if seen["required_nulls"] or seen.get("conditional_nulls", 0) else "OK"


@dataclass
class Coverage:
    """Share of the rows in scope that are found; an empty scope holds."""

    scope: Column
    found: Column
    warn: float
    abort: float

    def metrics(self) -> dict[str, Column]:
        return {"n_scope": F.count_if(self.scope), "n_found": F.count_if(self.scope & self.found)}

    def verdict(self, seen: Mapping[str, int]) -> str:
        share = seen["n_found"] / seen["n_scope"] if seen["n_scope"] else 1.0
        return "ABORT" if share < self.abort else "WARN" if share < self.warn else "OK"


def gated_write(df: DataFrame, path: str, checks: Sequence[RowCount | Nulls | Coverage]) -> dict[str, Any]:
    """Write the table to ``path`` if the checks allow it; their metrics, and ``verdict``, OK or WARN. Else GateError.

    Metrics are observed while the rows are written, so nothing is read twice. Rows go to a fresh folder beside the path,
    which becomes the path by a rename, or is taken away: readers see the whole table or none. A path that exists is refused.
    """
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(at):
        raise FileExistsError(path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}-{uuid.uuid4().hex}.tmp")
    watch = Observation()
    metrics = {k: v for c in checks for k, v in c.metrics().items()}
    df.observe(watch, *[v.alias(k) for k, v in metrics.items()]).write.parquet(aside.toString())
    seen = watch.get
    verdicts = [c.verdict(seen) for c in checks]
    if "ABORT" in verdicts:
        fs.delete(aside, True)
        raise GateError(f"{path} refused: {seen}")
    if not fs.rename(aside, at):
        raise FileExistsError(path)
    return seen | {"verdict": "WARN" if "WARN" in verdicts else "OK"}
