"""Extracts from remote systems: JDBC in monthly windows, document queries, service calls by partition."""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Callable, Iterator
from datetime import date

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_dir


def month_windows(end: date, months: int) -> list[tuple[date, date]]:
    """Half-open months [end-(i+1), end-i), the latest first; days are clipped to the month's length."""

    def back(n: int) -> date:
        at = end.year * 12 + end.month - 1 - n
        year, month = divmod(at, 12)
        last = (date(year + (month == 11), (month + 1) % 12 + 1, 1) - date(year, month + 1, 1)).days
        return date(year, month + 1, min(end.day, last))

    return [(back(i + 1), back(i)) for i in range(months)]


def read_jdbc_months(spark: SparkSession, url: str, query: str, at: str, end: date, months: int, properties: dict[str, str]) -> DataFrame:
    """A remote query as one partition for each month; Spark runs and retries the parts in parallel."""
    parts = [f"{at} >= '{a}' AND {at} < '{b}'" for a, b in month_windows(end, months)]
    return spark.read.jdbc(url, f"({query}) extract", predicates=parts, properties=properties)


def union_windows(df: DataFrame, at: str, windows: list[tuple[date, date]]) -> DataFrame:
    """The rows inside any of the half-open windows, with the window's number as ``chunk``."""
    chunk = F.lit(None).cast("int")
    for i, (a, b) in enumerate(windows):
        chunk = F.when((F.col(at) >= F.lit(a)) & (F.col(at) < F.lit(b)), F.lit(i)).otherwise(chunk)
    return df.withColumn("chunk", chunk).where("chunk is not null")


class Documents:
    """A document collection with the three reads of a document store."""

    def __init__(self, df: DataFrame):
        self.df = df

    def find(self, where: str | None = None, columns: list[str] | None = None, sort: list | None = None, limit: int | None = None) -> DataFrame:
        out = self.df.where(where) if where else self.df
        out = out.orderBy(*sort) if sort else out
        out = out.limit(limit) if limit is not None else out
        return out.select(*columns) if columns else out

    def aggregate(self, keys: list[str], **metrics) -> DataFrame:
        return self.df.groupBy(*keys).agg(*[m.alias(k) for k, m in metrics.items()])

    def count(self, where: str | None = None) -> int:
        return self.find(where).count()


def rows_to_table(rows: DataFrame, column: str) -> DataFrame:
    """A table of the nested rows in a column of JSON text; every row takes part in finding the schema.

    The rows are written to the shared folder once, and Spark finds the schema from all of them and parses them in its
    tasks. Null and malformed rows are left out; no rows make a table without columns.
    """
    path = f"{shared_dir(rows.sparkSession)}/rows-{uuid.uuid4().hex}"
    rows.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value")).write.text(path)
    return rows.sparkSession.read.option("samplingRatio", 1.0).option("mode", "DROPMALFORMED").json(path)


class TokenBucket:
    """So many calls a second, at most ``burst`` at once; ``take`` waits for its turn."""

    def __init__(self, per_second: float, burst: float = 1.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.rate, self.burst, self.clock, self.sleep = per_second, burst, clock, sleep
        self.tokens, self.at = burst, clock()

    def take(self) -> None:
        now = self.clock()
        self.tokens, self.at = min(self.burst, self.tokens + (now - self.at) * self.rate), now
        self.tokens -= 1
        if self.tokens < 0:  # in debt: until it is paid nobody else of this task calls
            self.sleep(-self.tokens / self.rate)


class ServiceCalls:
    """Calls of one task: batches in turn with the bucket, retries after growing waits with jitter, and what still fails
    cut in halves until the items that fail stand alone."""

    def __init__(self, call: Callable[[list], list], retries: int = 3, bucket: TokenBucket | None = None, wait: float = 0.5, most_wait: float = 30.0, sleep: Callable[[float], None] = time.sleep, seed: int = 0) -> None:
        self.call, self.retries, self.bucket, self.wait, self.most_wait, self.sleep = call, retries, bucket, wait, most_wait, sleep
        self.random = random.Random(seed)

    def _tried(self, values: list) -> tuple[list | None, str | None]:
        error = None
        for attempt in range(self.retries):
            if attempt:
                self.sleep(min(self.wait * 2 ** (attempt - 1), self.most_wait) * self.random.uniform(0.5, 1.5))
            if self.bucket:
                self.bucket.take()
            try:
                out = self.call(values)
                if len(out) != len(values):
                    raise ValueError(f"{len(out)} results for {len(values)} items")
                return list(out), None
            except Exception as e:
                error = f"{type(e).__name__}: {e}"
        return None, error

    def run(self, values: list) -> tuple[list, list]:
        """Result and error of each item."""
        out, error = self._tried(values)
        if out is not None:
            return out, [None] * len(values)
        if len(values) == 1:
            return [None], [error]
        half = len(values) // 2
        (a, ea), (b, eb) = self.run(values[:half]), self.run(values[half:])
        return a + b, ea + eb


def call_service(
    df: DataFrame, column: str, call: Callable[[list], list], schema: str, batch: int = 500, retries: int = 3, strict: bool = False,
    per_second: float | None = None, tasks: int | None = None, wait: float = 0.5,
) -> DataFrame:
    """``result`` and ``error`` of a service for each row, batched within partitions.

    A failing batch is tried again after a wait; what fails to the last is halved, so only the items that fail by
    themselves have a null result and the error that was met, or with ``strict`` the task fails. With ``per_second`` the
    service sees no more calls than that: at most ``tasks`` tasks (the session's cores) call, each by its share of the limit.
    """
    share = None
    if per_second is not None:
        tasks = tasks or df.sparkSession.sparkContext.defaultParallelism
        df, share = df.coalesce(tasks), per_second / tasks

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        calls = ServiceCalls(call, retries, TokenBucket(share) if share else None, wait, seed=context.partitionId() if context else 0)
        for f in frames:
            out, errors = [], []
            for at in range(0, len(f), batch):
                found, failed = calls.run(f[column].iloc[at : at + batch].tolist())
                if strict and any(failed):
                    raise RuntimeError(next(x for x in failed if x))
                out += found
                errors += failed
            yield f.assign(result=out, error=errors)

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(work, f"{names}, result {schema}, error string")


def resumed_calls(df: DataFrame, key: str, column: str, call: Callable[[list], list], schema: str, root: str, **options) -> tuple[DataFrame, DataFrame]:
    """(results: key, result, run; dead letters: key, error, run) of a service over the rows, in runs under ``root``.

    A run calls the service for the rows that no earlier finished run has a result of, dead letters among them, and
    keeps what it got and what failed. Rows without a result stay dead letters, with their latest error, until a later run
    gets them. A run that was cut off left no _SUCCESS mark and doesn't count.
    """
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    runs = sorted(int(n.removeprefix("run=")) for n in names if n.startswith("run="))
    done = [n for n in runs if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/run={n}/_SUCCESS"))]

    def kept(numbers: list[int]) -> DataFrame:
        return spark.read.option("basePath", root).parquet(*[f"{root}/run={n}" for n in numbers])

    todo = df.select(key, column)
    if done:
        todo = todo.join(kept(done).where("error is null").select(key).distinct(), key, "left_anti")
    this = max(runs, default=0) + 1
    call_service(todo, column, call, schema, **options).drop(column).write.parquet(f"{root}/run={this}")
    told = kept([*done, this])
    results = told.where("error is null").groupBy(key).agg(F.min_by("result", "run").alias("result"), F.min("run").alias("run"))
    dead = told.where("error is not null").join(results.select(key), key, "left_anti").groupBy(key).agg(F.max_by("error", "run").alias("error"), F.max("run").alias("run"))
    return results, dead
