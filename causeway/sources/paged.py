"""A document store as pages of JSON lines, read by a data source that takes filters.

A store is a folder with ``pages`` (JSON lines, one file for each page) and ``index`` (for each page its rows and the least and
largest value of some fields). The source is planned from the index: one partition for each page that a filter's range
doesn't rule out. Within a page a task tests the filters on the decoded documents, batch by batch, so Spark gets rows that
match; what a filter can't say here (expressions) Spark tests itself. Pages are opened by URI through pyarrow's file
systems in the tasks, as any client of such a store would; the index is an ordinary Parquet table.
"""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringContains, StringStartsWith
from pyspark.sql.pandas.types import to_arrow_schema

BATCH_ROWS = 1000


def write_pages(df: DataFrame, path: str, order: Sequence[str], ranged: Sequence[str], page_rows: int = 10_000) -> None:
    """Write documents in pages of at most about ``page_rows``, sorted by ``order``, with the ranges of ``ranged``."""
    spark = df.sparkSession
    pages = max(1, -(-df.count() // page_rows))
    df.repartitionByRange(pages, *order).sortWithinPartitions(*order).write.option("ignoreNullFields", "false").json(f"{path}/pages")
    rows = spark.read.schema(df.schema).json(f"{path}/pages").withColumn("page", F.input_file_name())
    ends = [f(c).alias(f"{name}_{c}") for c in ranged for name, f in (("least", F.min), ("most", F.max))]
    rows.groupBy("page").agg(F.count(F.lit(1)).alias("n"), *ends).coalesce(1).write.parquet(f"{path}/index")


@dataclass
class Page(InputPartition):
    uri: str
    n: int


def _field(f: Filter) -> str | None:
    return f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None


#: What a filter asks of a value that isn't null, and of the range (least, most) of a page's values.
TESTS: dict[type, tuple[Callable[[Any, Any], bool], Callable[[Any, Any, Any], bool]]] = {
    EqualTo: (lambda v, x: v == x, lambda a, b, x: a <= x <= b),
    GreaterThan: (lambda v, x: v > x, lambda a, b, x: b > x),
    GreaterThanOrEqual: (lambda v, x: v >= x, lambda a, b, x: b >= x),
    LessThan: (lambda v, x: v < x, lambda a, b, x: a < x),
    LessThanOrEqual: (lambda v, x: v <= x, lambda a, b, x: a <= x),
    In: (lambda v, x: v in x, lambda a, b, x: any(a <= y <= b for y in x)),
    StringStartsWith: (lambda v, x: v.startswith(x), lambda a, b, x: a <= x + "\U0010ffff" and b >= x),
    StringContains: (lambda v, x: x in v, lambda a, b, x: True),
}
#: Types whose decoded JSON values compare as Spark's do.
PLAIN = (T.StringType, T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DoubleType, T.BooleanType)


class PageReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType) -> None:
        self.path, self.schema = path, schema
        self.kinds = {f.name: f.dataType for f in schema.fields}
        self.filters: list[tuple[type, str, Any]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take the filters that can be tested on plain fields; the others go back to Spark."""
        for f in filters:
            field = _field(f)
            if field in self.kinds and isinstance(self.kinds[field], PLAIN) and type(f) in (*TESTS, IsNull, IsNotNull):
                self.filters.append((type(f), field, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        fs, root = pafs.FileSystem.from_uri(f"{self.path.rstrip('/')}/index")
        files = [x.path for x in fs.get_file_info(pafs.FileSelector(root)) if x.path.endswith(".parquet")]
        out = []
        for name in files:  # a row for each page
            for page in pq.read_table(name, filesystem=fs).to_pylist():
                if all(self._may_hold(page, *f) for f in self.filters):
                    out.append(Page(page["page"], page["n"]))
        return out

    @staticmethod
    def _may_hold(page: dict, kind: type, field: str, value: Any) -> bool:
        if kind is IsNull or f"least_{field}" not in page:
            return True
        least, most = page[f"least_{field}"], page[f"most_{field}"]
        if least is None:  # nulls only
            return False
        return kind is IsNotNull or TESTS[kind][1](least, most, value)

    def _matches(self, doc: dict) -> bool:
        for kind, field, value in self.filters:
            v = doc.get(field)
            if kind is IsNull:
                if v is not None:
                    return False
            elif v is None or (kind is not IsNotNull and not TESTS[kind][0](v, value)):
                return False
        return True

    def read(self, partition: Page | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no page is left to read
            return
        schema = to_arrow_schema(self.schema)
        fs, path = pafs.FileSystem.from_uri(partition.uri)
        held: list[dict] = []
        with fs.open_input_stream(path) as stream, io.TextIOWrapper(stream, encoding="utf-8") as lines:
            for line in lines:
                doc = json.loads(line)
                if self._matches(doc):
                    held.append(doc)
                if len(held) == BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)


class PagedDocuments(DataSource):
    """``spark.read.format("paged_documents").schema(...).load(path)``; fields of types beyond PLAIN should be nested JSON."""

    @classmethod
    def name(cls) -> str:
        return "paged_documents"

    def reader(self, schema: T.StructType) -> PageReader:
        return PageReader(self.options["path"], schema)


def register_paged_documents(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedDocuments)
