"""Dense vectors as array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, without leaving the JVM."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; a zero vector has norm 1, and so cosine 0."""
    length = lambda v: F.when(norm(v) == 0, F.lit(1.0)).otherwise(norm(v))
    return dot(a, b) / (length(a) * length(b))


def unit(a: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    return F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: F.when(n == 0, x.cast("double")).otherwise(x / n))).getItem(0)


def min_max(df: DataFrame, col: str, name: str) -> DataFrame:
    """The column scaled to [0, 1] over the table; 1 if it is constant."""
    ends = df.agg(F.min(col).alias("_low"), F.max(col).alias("_high"))
    scaled = F.when(F.col("_high") > F.col("_low"), (F.col(col) - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(F.lit(1.0))
    return df.crossJoin(F.broadcast(ends)).withColumn(name, scaled).drop("_low", "_high")  # one row
