"""Append-only ledgers of JSON lines: rows, replay, and several ledgers appended together."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.windows import last_row_wins

MANAGER = "_managed_by"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines; malformed rows are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_ledger(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of a ledger without its header; a ledger without a header is refused."""
    wide = T.StructType([*schema.fields, T.StructField(MANAGER, T.StringType())])
    rows = read_jsonl(spark, path, wide)
    if rows.where(F.col(MANAGER).isNotNull()).isEmpty():
        raise ValueError(f"{path} has no header line: it isn't a managed ledger")
    return rows.where(F.col(MANAGER).isNull()).drop(MANAGER)


def append_rows(df: DataFrame, path: str, manager: str) -> None:
    """Append rows; each append is one committed write that brings its own header line, so writers that start a ledger
    together need no turn: readers leave all headers out."""
    header = df.sparkSession.createDataFrame([(manager, "1")], f"{MANAGER} string, schema_version string")
    df.unionByName(header, allowMissingColumns=True).write.mode("append").json(path)


def append_together(frames: Mapping[str, DataFrame], root: str) -> str:
    """Append to several ledgers under one commit id; readers use ``read_together``, which sees all of it or none."""
    commit = uuid.uuid4().hex
    for name, df in frames.items():
        df.withColumn("_commit", F.lit(commit)).write.mode("append").parquet(f"{root}/{name}")
    spark = next(iter(frames.values())).sparkSession
    spark.createDataFrame([(commit,)], "_commit string").coalesce(1).write.mode("append").parquet(f"{root}/_commits")
    return commit


def read_together(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The rows of all finished commits."""
    done = spark.read.parquet(f"{root}/_commits")
    return spark.read.parquet(f"{root}/{name}").join(done, "_commit", "left_semi").drop("_commit")


def replay(df: DataFrame, keys: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """The state of an event-sourced table: the last row of each key."""
    return last_row_wins(df, keys, seq)


def missing_pairs(runs: DataFrame, others: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """keys and missing_<name> for each run that some other ledger lacks."""
    out = runs.select(*keys).distinct()
    for name, df in others.items():
        out = out.join(df.select(*keys).distinct().withColumn(f"_{name}", F.lit(True)), list(keys), "left")
    out = out.select(*keys, *[F.col(f"_{n}").isNull().alias(f"missing_{n}") for n in others])
    return out.where(" or ".join(f"missing_{n}" for n in others))
