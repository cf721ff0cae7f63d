"""User functions over groups and partitions, a registry of methods, and resumable chunk jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult
from pyspark.sql.window import Window

from .ranking import with_row_number


def group_apply(df: DataFrame, keys: Sequence[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """The function over each group; a group must fit in a task's memory."""
    return df.groupBy(*keys).applyInPandas(fn, schema)


#: Rows of one task's group where a long history is cut into blocks.
BLOCK_ROWS = 2048


def block_apply(df: DataFrame, keys: Sequence[str], order: Sequence[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The function over blocks of at most ``block_rows`` rows of a group, as they lie in the order, which must be total.

    The frame has ``_before``, the number of the group's rows in earlier blocks; so no group need fit in memory.
    """
    placed, _ = with_row_number(df, [*keys, *order], "_n")
    placed = placed.withColumn("_block", F.floor((F.col("_n") - 1) / block_rows)).drop("_n")
    sizes = placed.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_size"))
    earlier = F.sum("_size").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_block").alias("_b"), F.coalesce(earlier, F.lit(0)).alias("_before"))
    same = F.col("_block") == F.col("_b")
    for i, k in enumerate(keys):
        same &= placed[k].eqNullSafe(starts[f"_k{i}"])
    return placed.join(starts, same).select(*placed.columns, "_before").groupBy(*keys, "_block").applyInPandas(fn, schema)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """The rows of each group from batches that are sorted by whole-number keys; holds one group at a time."""
    held: list[pa.Table] = []
    for b in batches:
        t = pa.Table.from_batches([b])
        if not t.num_rows:
            continue
        key = np.stack([t.column(c).to_numpy() for c in keys])
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        if held and any(held[-1].column(c)[-1].as_py() != t.column(c)[0].as_py() for c in keys):
            yield pa.concat_tables(held)
            held = []
        edges = [0, *cuts.tolist(), t.num_rows]
        for at, end in zip(edges[:-1], edges[1:]):
            held.append(t.slice(at, end - at))
            if end < t.num_rows:
                yield pa.concat_tables(held)
                held = []
    if held:
        yield pa.concat_tables(held)


def partition_map(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """The function over each Arrow batch of each partition."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield fn(f)

    return df.mapInPandas(work, schema)


class Methods:
    """Named DataFrame methods, run one after another; a failing one doesn't stop the rest."""

    def __init__(self) -> None:
        self._methods: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def register(self, name: str) -> Callable:
        if name in self._methods:
            raise ValueError(f"method {name} is registered already")

        def add(fn: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
            self._methods[name] = fn
            return fn

        return add

    def run(self, df: DataFrame, names: Sequence[str] | None = None) -> dict[str, DataFrame | Exception]:
        out: dict[str, DataFrame | Exception] = {}
        for name in names or self._methods:
            try:
                out[name] = self._methods[name](df)
            except Exception as e:
                out[name] = e
        return out


def register_table_function(spark: SparkSession, name: str, schema: str, start: Callable[[], tuple], step: Callable[[tuple, Row], tuple]) -> None:
    """A fold over the rows of each partition as a SQL function: ``SELECT * FROM name(TABLE(...) PARTITION BY key)``.

    The first column of the table is the key, and the function answers it with the columns of ``schema``, the state after
    the partition's last row. The schema of the answer follows from that of the table when the query is analysed. Only a state
    is held, so a partition may have any number of rows.
    """
    told = T._parse_datatype_string(schema).fields

    class Fold:
        def __init__(self) -> None:
            self.key, self.state = None, None

        @staticmethod
        def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable:
                raise ValueError(f"{name} takes a TABLE argument")
            return AnalyzeResult(schema=T.StructType([rows.dataType.fields[0], *told]))

        def eval(self, row: Row) -> None:
            if self.state is None:
                self.key, self.state = row[0], start()
            self.state = step(self.state, row)

        def terminate(self) -> Iterator[tuple]:
            if self.state is not None:
                yield (self.key, *self.state)

    spark.udtf.register(name, udtf(Fold))


def chunked_job(df: DataFrame, key: str, n_chunks: int, process: Callable[[DataFrame], DataFrame], root: str) -> DataFrame:
    """``process`` over hash chunks of the key, each committed on its own; chunks that are done are not done again.

    A finished write leaves a _SUCCESS marker, which is the chunk's completion mark.
    """
    spark = df.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    for i in range(n_chunks):
        path = f"{root.rstrip('/')}/chunk={i}"
        marker = fs_path(f"{path}/_SUCCESS")
        if not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
            process(df.where(F.pmod(F.xxhash64(key), F.lit(n_chunks)) == i)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(*[f"{root.rstrip('/')}/chunk={i}" for i in range(n_chunks)])
