"""A table of vectors that changes: upserts, deletes and fetches by id, in snapshots.

Every change writes its rows as Parquet under a fresh name and then commits the next manifest, a small JSON file that lists
the parts of the snapshot. A manifest is written aside and renamed into its number, which only one writer can do; another one
that read the same snapshot is refused. Readers see whole snapshots only: rows without a manifest, or a manifest that
was not renamed, are nobody's. Reading merges the parts: of each (namespace, id) the row of the latest change counts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = ("namespace", "id")


class ConcurrentChange(RuntimeError):
    """Another writer committed first; read the new snapshot and try again."""


@dataclass
class VectorTable:
    """Rows (namespace, id, vector, and metadata columns of ``metadata``) under a folder."""

    spark: SparkSession
    root: str
    metadata: str = ""

    @property
    def schema(self) -> T.StructType:
        more = T._parse_datatype_string(self.metadata).fields if self.metadata else []
        return T.StructType([T.StructField("namespace", T.StringType()), T.StructField("id", T.StringType()), T.StructField("vector", T.ArrayType(T.DoubleType())), *more])

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root.rstrip('/')}/{name}")

    def _files(self):
        path = self._path("manifests")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The number of the latest snapshot; 0 for a table that nobody wrote to."""
        fs, path = self._files(), self._path("manifests")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return max((int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit()), default=0)

    def parts(self, version: int) -> list[dict]:
        """The parts of a snapshot, oldest first: path, kind (upsert or delete) and the snapshot that brought it."""
        if not version:
            return []
        stream = self._files().open(self._path(f"manifests/{version}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, version: int, parts: list[dict]) -> int:
        """Manifest ``version``, or ConcurrentChange if there is one."""
        fs, aside = self._files(), self._path(f"manifests/{uuid.uuid4().hex}.tmp")
        out = fs.create(aside, False)
        out.write(json.dumps(parts).encode())
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(aside, self._path(f"manifests/{version}.json"), options)
        except Exception as e:
            fs.delete(aside, False)
            if "FileAlreadyExists" in str(e):
                raise ConcurrentChange(f"snapshot {version} of {self.root} is there already") from e
            raise
        return version

    def _change(self, kind: str, rows: DataFrame, based_on: int | None) -> int:
        base = self.version() if based_on is None else based_on
        path = f"{self.root.rstrip('/')}/data/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self._commit(base + 1, [*self.parts(base), {"path": path, "kind": kind, "at": base + 1}])

    def _rows(self, df: DataFrame, namespace: str) -> DataFrame:
        have = set(df.columns)
        fields = [F.lit(namespace).alias("namespace"), df["id"].cast("string").alias("id"), *[(df[f.name] if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema.fields[2:]]]
        rows = df.select(*fields)
        # One change has one row for an id: of several the one that hashes lowest.
        one = F.min_by(F.struct(*[c for c in rows.columns if c not in KEY]), F.xxhash64(*[F.to_json(F.struct(*rows.columns))])).alias("r")
        return rows.where("id is not null").groupBy(*KEY).agg(one).select(*KEY, "r.*")

    def upsert(self, df: DataFrame, namespace: str = "", based_on: int | None = None) -> int:
        """Put the rows (id, vector, metadata) in, over those of equal id; the number of the new snapshot.

        Rows of a null id are left out, missing metadata columns are null, others are ignored. With ``based_on`` the
        change is refused unless that snapshot is still the latest.
        """
        return self._change("upsert", self._rows(df, namespace), based_on)

    def delete(self, ids: DataFrame, namespace: str = "", based_on: int | None = None) -> int:
        """Take out the rows of the ids (column id); unknown ones do nothing."""
        gone = ids.where("id is not null").select(F.lit(namespace).alias("namespace"), F.col("id").cast("string").alias("id")).distinct()
        return self._change("delete", gone, based_on)

    def read(self, version: int | None = None, ids: DataFrame | None = None) -> DataFrame:
        """A snapshot (the latest), or of it the rows of the ids: changes of one id meet by one shuffle, the latest counts."""
        merged = None
        for p in self.parts(self.version() if version is None else version):
            rows = self.spark.read.schema(self.schema).parquet(p["path"]).withColumns({"_at": F.lit(p["at"]), "_gone": F.lit(p["kind"] == "delete")})
            merged = rows if merged is None else merged.unionByName(rows)
        if merged is None:
            return self.spark.createDataFrame([], self.schema)
        if ids is not None:
            merged = merged.join(ids.select(F.col("id").cast("string").alias("id")).distinct(), "id", "left_semi")
        rest = [c for c in merged.columns if c not in (*KEY, "_at", "_gone")]
        last = F.max_by(F.struct("_gone", *rest), "_at").alias("r")
        return merged.groupBy(*KEY).agg(last).where("not r._gone").select(*KEY, *[f"r.{c}" for c in rest])

    def fetch(self, ids: DataFrame, namespace: str = "", version: int | None = None) -> DataFrame:
        """The rows of the ids (column id) that are there; only their changes are merged."""
        return self.read(version, ids).where(F.col("namespace") == namespace)

    def query(self, vector: Sequence[float], k: int, namespace: str = "", where: str | None = None, least: float = -1.0) -> DataFrame:
        """The k most similar rows of a namespace and filter, with ``similarity``."""
        from ..operators.dense import dense_top_k

        rows = self.read().where((F.col("namespace") == namespace) & F.col("vector").isNotNull())
        return dense_top_k(rows.where(where) if where else rows, "vector", vector, k, least, "id")

    def compact(self) -> int:
        """A snapshot of one part that reads as the latest one does."""
        base = self.version()
        path = f"{self.root.rstrip('/')}/data/{uuid.uuid4().hex}"
        self.read(base).write.parquet(path)
        return self._commit(base + 1, [{"path": path, "kind": "upsert", "at": base + 1}])

    def retry(self, change: Callable[[int], int], times: int = 5) -> int:
        """``change(snapshot)`` based on the latest snapshot, again while another writer comes first."""
        for _ in range(times):
            try:
                return change(self.version())
            except ConcurrentChange:
                continue
        raise ConcurrentChange(f"{self.root}: another writer came first {times} times")
