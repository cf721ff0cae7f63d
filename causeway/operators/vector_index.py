"""A stored inverted-file index of vectors: rows by cell, centres as a table.

Centres come from k-means on a bounded sample; their number follows the square root of the rows. Every row is in the
index, in the cell of its nearest centre, and rows can be appended. A search probes a number of cells that doesn't grow with
them, so a query compares about probes * sqrt(rows) rows, and a graph of all rows grows with the power 1.5. What a graph
misses by probing few cells it wins back from neighbours: two rows that share a near neighbour are compared as well.

Centres travel as one broadcast matrix, bounded by MOST_CELLS, never as literals in a plan. Rows of a cell are dealt into
blocks, so a cell of any size is compared by matrices of bounded size. A task answers for each asking row its best hits in a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import persist_shared, shared_dir
from .apply import sorted_groups

MOST_CELLS, SAMPLE_ROWS, BLOCK_ROWS, PROBES = 16_384, 500_000, 1024, 16
#: Rows for each centre that k-means is fitted on: with cells by the square root of the rows, training grows no faster than the table.
CELL_SAMPLE = 256
#: Best neighbours whose neighbours a row meets when a graph is refined.
REFINE_WITH = 8


def units(lists: pa.Array, rows: int) -> np.ndarray:
    """Vectors of length 1; a zero vector stays."""
    v = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)
    size = np.linalg.norm(v, axis=1)
    return v / np.where(size == 0, 1.0, size)[:, None]


def cell_count(n: int) -> int:
    return int(min(max(8, n**0.5), MOST_CELLS))


def training_sample(rows: DataFrame, n: int, n_cells: int, sample_rows: int) -> DataFrame:
    """Of n rows (k, v) about CELL_SAMPLE for each cell, ``sample_rows`` at most, by their keys."""
    most = min(sample_rows, CELL_SAMPLE * n_cells)
    return rows if n <= most else rows.where(F.pmod(F.xxhash64("k"), F.lit(n)) < most)


def train_centers(rows: DataFrame, n: int, n_cells: int, seed: int, sample_rows: int) -> list[tuple[int, list[float]]]:
    """Centres of k-means over unit vectors of a bounded sample of rows (k, v)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector

    sample = training_sample(rows, n, n_cells, sample_rows)
    points = Normalizer(inputCol="_v", outputCol="_f").transform(sample.select(array_to_vector("v").alias("_v")))
    return [(i, c.tolist()) for i, c in enumerate(KMeans(k=n_cells, seed=seed, featuresCol="_f").fit(points).clusterCenters())]


def _assigner(centers, n_probe: int):
    """Rows (k, v) with ``cells``, the nearest first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centers.value
        half = (c**2).sum(axis=1) / 2
        for b in batches:
            if b.num_rows:
                order = np.argsort(half[None, :] - units(b.column("v"), b.num_rows) @ c.T, axis=1, kind="stable")[:, :n_probe].astype(np.int64)
                cells = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * order.shape[1], pa.int32()), pa.array(order.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("k"), b.column("v"), cells], ["k", "v", "cells"])

    return work


def _best(least: float, k: int):
    """Of block pairs (g, x, y): for each asking row (side 1) its k best members (side 0), ties with the last included."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, ["g", "x", "y"]):
            key, side = t.column("k").combine_chunks(), t.column("side").to_numpy()
            v = units(t.column("v").combine_chunks(), t.num_rows)
            asks, rows = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
            if len(asks) and len(rows):
                cos = v[asks] @ v[rows].T
                good = cos >= least
                if k + 1 < len(rows):  # one more, for the asking row itself
                    good &= cos >= np.partition(cos, -(k + 1), axis=1)[:, -(k + 1)][:, None]
                i, j = np.nonzero(good)
                yield pa.RecordBatch.from_arrays([key.take(pa.array(asks[i])), key.take(pa.array(rows[j])), pa.array(cos[i, j])], ["a", "b", "similarity"])

    return work


def _meet(least: float):
    """Of groups g of near rows all pairs of at least ``least``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, ["g"]):
            v = units(t.column("v").combine_chunks(), t.num_rows)
            i, j = np.nonzero(np.triu(v @ v.T >= least, 1))
            if len(i):
                key = t.column("k").combine_chunks()
                yield pa.RecordBatch.from_arrays([key.take(pa.array(i)), key.take(pa.array(j)), pa.array((v[i] * v[j]).sum(axis=1))], ["a", "b", "similarity"])

    return work


def _blocked(df: DataFrame, block_rows: int) -> DataFrame:
    """Rows (g, k, v) with their block b, and n_b, the blocks of their cell."""
    sizes = df.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("n_b"))
    return df.join(sizes, "g").withColumn("b", F.pmod(F.xxhash64("k"), F.col("n_b")).cast("int"))


@dataclass
class VectorIndex:
    """The index at a path: ``centers`` (cell, center) and ``rows`` (k, v, cell)."""

    spark: SparkSession
    path: str
    block_rows: int = BLOCK_ROWS

    @classmethod
    def build(cls, df: DataFrame, key: str, vector: str, path: str | None = None, n_cells: int | None = None, seed: int = 42, sample_rows: int = SAMPLE_ROWS, block_rows: int = BLOCK_ROWS) -> VectorIndex:
        """Train centres and write all rows with a vector; without a path under a fresh name in the shared folder.

        Rows whose vector is null are left out; all others must have one width. An empty table gives an empty index.
        """
        import uuid

        spark = df.sparkSession
        out = cls(spark, (path or f"{shared_dir(spark)}/vector-index-{uuid.uuid4().hex}").rstrip("/"), block_rows)
        rows = out._rows_of(df, key, vector)
        n = rows.count()
        centers = train_centers(rows, n, min(n_cells or cell_count(n), n), seed, sample_rows) if n else []
        spark.createDataFrame(centers, "cell long, center array<double>").coalesce(1).write.parquet(f"{out.path}/centers")
        out._add(rows)
        return out

    def append(self, df: DataFrame, key: str, vector: str) -> None:
        """Rows into the cells that there are; the keys must be new."""
        self._add(self._rows_of(df, key, vector))

    @staticmethod
    def _rows_of(df: DataFrame, key: str, vector: str) -> DataFrame:
        return df.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))

    def centers(self) -> np.ndarray:
        return np.array([r["center"] for r in self.spark.read.parquet(f"{self.path}/centers").orderBy("cell").collect()])  # MOST_CELLS at most

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def _nearest_cells(self, rows: DataFrame, n_probe: int) -> DataFrame:
        kind = f"k {dict(rows.dtypes)['k']}, v array<double>, cells array<long>"
        centers = self.centers()
        if not len(centers):
            return rows.where("false").withColumn("cells", F.array(F.lit(0).cast("long")))
        return rows.mapInArrow(_assigner(self.spark.sparkContext.broadcast(centers), n_probe), kind)

    def _add(self, rows: DataFrame) -> None:
        # Rows of a cell lie together, so a scan for some cells skips most row groups.
        celled = self._nearest_cells(rows, 1).select("k", "v", F.element_at("cells", 1).alias("cell"))
        celled.repartitionByRange("cell", "k").sortWithinPartitions("cell", "k").write.mode("append").parquet(f"{self.path}/rows")

    def _asked(self, queries: DataFrame, n_probe: int) -> tuple[DataFrame, DataFrame]:
        """Members and asking rows of each cell that is asked, in blocks."""
        asks = persist_shared(self._nearest_cells(queries, n_probe).select("k", "v", F.explode("cells").alias("g")), "index-asks")
        return _blocked(self.rows().select(F.col("cell").alias("g"), "k", "v"), self.block_rows), _blocked(asks, self.block_rows)

    def _found(self, members: DataFrame, asks: DataFrame, least: float, k: int) -> DataFrame:
        met = members.select("g", "n_b").distinct().join(asks.select("g", F.col("n_b").alias("m_b")).distinct(), "g")
        others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        rows = members.drop("n_b").join(met.select("g", "m_b"), "g").select("g", F.col("b").alias("x"), others("m_b").alias("y"), F.lit(0).alias("side"), "k", "v")
        asking = asks.drop("n_b").join(met.select("g", "n_b"), "g").select("g", others("n_b").alias("x"), F.col("b").alias("y"), F.lit(1).alias("side"), "k", "v")
        kind = dict(members.dtypes)["k"]
        dealt = rows.union(asking).repartition("g", "x", "y").sortWithinPartitions("g", "x", "y")
        return dealt.mapInArrow(_best(least, k), f"a {kind}, b {kind}, similarity double")

    def search(self, queries: DataFrame, key: str, vector: str, k: int, n_probe: int = PROBES, least: float = -1.0) -> DataFrame:
        """query, key, similarity, place: the k best rows of the probed cells for each query, equal ones by key.

        Keys of queries and rows are of one type; a row isn't its own query's hit if the keys agree.
        """
        asks = self._rows_of(queries, key, vector)
        found = self._found(*self._asked(asks, n_probe), least - 1e-9, k).where("a <> b").withColumn("similarity", F.round("similarity", 9)).where(F.col("similarity") >= least)
        place = F.row_number().over(Window.partitionBy("a").orderBy(F.col("similarity").desc(), "b"))
        return found.withColumn("place", place).where(F.col("place") <= k).select(F.col("a").alias("query"), F.col("b").alias("key"), "similarity", "place")

    def _classes(self) -> tuple[DataFrame, DataFrame]:
        """One row (k, v) of each group of equal vectors, its smallest key, and (k, first) of all the others."""
        firsts = persist_shared(self.rows().groupBy("v").agg(F.min("k").alias("k"), F.count(F.lit(1)).alias("n")), "index-classes")
        again = firsts.where("n > 1")
        others = self.rows().select("k", F.xxhash64("v").alias("h"), "v").join(again.select(F.xxhash64("v").alias("h"), F.col("v").alias("_v"), F.col("k").alias("first")), "h").where("v = _v and k <> first").select("k", "first")
        return firsts.select("k", "v"), others

    def near_pairs(self, least: float, k: int = 100, n_probe: int = PROBES, refine_with: int = REFINE_WITH) -> DataFrame:
        """src < dst, similarity of near pairs: of each row its k best in the probed cells, of ``least`` or more, and pairs
        that share one of their ``refine_with`` best neighbours.

        Equal vectors take part once, by their smallest key; the others have one pair, of similarity 1, with it (unless
        their vector is zero): whatever is near to one of them is near to all.
        """
        classes, others = self._classes()
        found = persist_shared(self._pairs(self._found(*self._among(classes, n_probe), least - 1e-9, k)), "index-pairs")
        if refine_with:
            both = found.union(found.select("dst", "src", "similarity"))
            place = F.row_number().over(Window.partitionBy("src").orderBy(F.col("similarity").desc(), "dst"))
            near = both.withColumn("place", place).where(F.col("place") <= refine_with).select(F.col("src").alias("hub"), F.col("dst").alias("k"))
            names = near.select("hub").distinct().withColumn("g", F.monotonically_increasing_id())
            groups = near.join(persist_shared(names, "index-hubs"), "hub").join(classes, "k").select("g", "k", "v")
            kind = dict(classes.dtypes)["k"]
            met = groups.repartition("g").sortWithinPartitions("g").mapInArrow(_meet(least - 1e-9), f"a {kind}, b {kind}, similarity double")
            found = found.union(self._pairs(met))
        copies = others.join(classes.where(F.exists("v", lambda x: x != 0)).select(F.col("k").alias("first")), "first", "left_semi")
        copies = copies.select(F.least("k", "first").alias("src"), F.greatest("k", "first").alias("dst"), F.lit(1.0).alias("similarity")).where(F.lit(least <= 1.0))
        return found.groupBy("src", "dst").agg(F.max("similarity").alias("similarity")).where(F.col("similarity") >= least).union(copies)

    def _among(self, classes: DataFrame, n_probe: int) -> tuple[DataFrame, DataFrame]:
        asks = persist_shared(self._nearest_cells(classes, n_probe), "index-asks")
        members = asks.select(F.element_at("cells", 1).alias("g"), "k", "v")
        return _blocked(members, self.block_rows), _blocked(asks.select(F.explode("cells").alias("g"), "k", "v"), self.block_rows)

    @staticmethod
    def _pairs(found: DataFrame) -> DataFrame:
        return found.where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), F.round("similarity", 9).alias("similarity"))

    def compared(self, n_probe: int = PROBES, refine_with: int = REFINE_WITH) -> int:
        """Pairs that ``near_pairs`` compares at most: rows of a cell times those that ask it, and the pairs of each row's neighbours."""
        classes, _ = self._classes()
        members, asks = self._among(classes, n_probe)
        n = members.groupBy("g").agg(F.count(F.lit(1)).alias("n")).join(asks.groupBy("g").agg(F.count(F.lit(1)).alias("m")), "g")
        probed = n.agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
        return int(probed + classes.count() * refine_with * (refine_with - 1) // 2)
