"""Versioned tables, feature tables with a column contract, accessors, fingerprints and result caches."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Entity:
    """A named table with immutable, numbered versions, each Parquet, CSV or JSON under ``root/name/v=N``."""

    spark: SparkSession
    root: str
    name: str
    versions: dict[int, str] = field(default_factory=dict)  # version -> format
    schemas: dict[int, T.StructType] = field(default_factory=dict)

    def path(self, version: int) -> str:
        if version not in self.versions:
            raise ValueError(f"{self.name} has no version {version}; registered: {sorted(self.versions)}")
        return f"{self.root.rstrip('/')}/{self.name}/v={version}"

    def exists(self, version: int) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(version))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def scan(self, version: int, columns: Sequence[str] | None = None) -> DataFrame:
        """The lazy table; only the columns asked for are read."""
        kind, path = self.versions.get(version), self.path(version)
        if not self.exists(version):
            raise FileNotFoundError(path)
        reader = self.spark.read
        if version in self.schemas:
            reader = reader.schema(self.schemas[version])
        if kind == "csv":
            df = read_csv(self.spark, path, self.schemas.get(version))
        elif kind == "json":
            df = reader.json(path)
        else:
            df = reader.parquet(path)
        return df.select(*columns) if columns else df

    get = scan

    def put(self, version: int, df: DataFrame) -> None:
        """Versions never change: a second write fails."""
        writer = df.write.mode("errorifexists")
        if self.versions.get(version) == "csv":
            writer = writer.option("header", "true")
        getattr(writer, self.versions.get(version) or "parquet")(self.path(version))


@dataclass
class FeatureTable(Entity):
    """An entity whose versions must hold the required columns, on reading and on writing."""

    required: tuple[str, ...] = ()

    def _checked(self, df: DataFrame) -> DataFrame:
        missing = [c for c in self.required if c not in df.columns]
        if missing:
            raise ValueError(f"{self.name} lacks columns {missing}")
        return df

    def scan(self, version: int, columns: Sequence[str] | None = None) -> DataFrame:
        df = self._checked(super().scan(version))
        return df.select(*columns) if columns else df

    get = scan

    def put(self, version: int, df: DataFrame) -> None:
        super().put(version, self._checked(df))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header; dates are inferred unless a schema says otherwise."""
    reader = spark.read.option("header", "true").option("timestampFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]")
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", "true").csv(path)


def read_json_dict(spark: SparkSession, path: str) -> DataFrame:
    """One row: a JSON document over many lines, its keys as columns."""
    return spark.read.option("multiLine", "true").json(path)


@dataclass
class Accessor:
    """Ways to take a part of a table that has a key and a date."""

    df: DataFrame
    key: str
    date: str

    def full(self) -> DataFrame:
        return self.df

    def smoke_test(self, n: int = 100) -> DataFrame:
        """The first rows by key: the same ones every time."""
        return self.df.orderBy(self.key).limit(n)

    head = smoke_test

    def sample_rows(self, n: int, seed: int = 42) -> DataFrame:
        """Exactly n rows (or all): those whose keys hash lowest."""
        return self.df.orderBy(F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col(self.key).cast("string")).cast("binary")), self.key).limit(n)

    def sample_keys(self, key: str, percent: int) -> DataFrame:
        """All rows of the keys with ``key mod 100`` below the percentage: no key is torn apart."""
        return self.df.where(F.pmod(F.col(key), F.lit(100)) < percent)

    def by_date_range(self, start: datetime | str, end: datetime | str) -> DataFrame:
        """Both ends included; pushed down to the scan."""
        return self.df.where(F.col(self.date).between(F.lit(start).cast(self.df.schema[self.date].dataType), F.lit(end).cast(self.df.schema[self.date].dataType)))

    def date_range(self) -> DataFrame:
        return self.df.agg(F.min(self.date).alias("first"), F.max(self.date).alias("last"))

    def n_rows(self) -> int:
        return self.df.count()


def table_stats(df: DataFrame, date: str, outcome: str) -> DataFrame:
    """n_rows, first, last, outcome_sum: one aggregation that tells versions of a table apart cheaply."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.min(date).alias("first"), F.max(date).alias("last"), F.sum(F.col(outcome).cast("double")).alias("outcome_sum"))


def cheap_fingerprint(df: DataFrame, date: str, outcome: str) -> str:
    """A hash of the statistics and the sorted schema."""
    said = json.dumps([sorted(df.dtypes), [str(x) for x in table_stats(df, date, outcome).first()]])
    return hashlib.blake2b(said.encode(), digest_size=16).hexdigest()


def row_fingerprint(df: DataFrame) -> DataFrame:
    """One row: n_rows, fingerprint; equal for equal rows in any order."""
    total = F.sum(F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(38,0)"))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sha2(F.coalesce(total, F.lit(0)).cast("string"), 256).alias("fingerprint"))


@dataclass
class ResultCache:
    """Results kept as Parquet under the fingerprint of what they were made from."""

    spark: SparkSession
    root: str

    def get_or_make(self, fingerprint: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The kept result, or a new one. Only a finished write, marked by _SUCCESS, counts as kept; a result that can't
        be read is an error, not a reason to overwrite it."""
        path = f"{self.root.rstrip('/')}/{fingerprint}"
        marker = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not marker.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(marker):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)


def file_audit(spark: SparkSession, path: str, bands: dict[str, tuple[int, int]]) -> DataFrame:
    """name, bytes, ok for each expected file: there, and of a size within its band. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"))
    wanted = spark.createDataFrame([(n, a, b) for n, (a, b) in bands.items()], "name string, least bigint, most bigint")
    return wanted.join(files, "name", "left").select("name", "bytes", F.coalesce(F.col("bytes").between(F.col("least"), F.col("most")), F.lit(False)).alias("ok"))
