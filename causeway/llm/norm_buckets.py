"""Exact inner-product search by norm buckets.

Vectors are sorted by length and cut into shards of bounded size and, within a shard, into buckets of similar length. A
query that knows a lower bound of its k-th best product needs of a bucket only vectors whose cosine reaches
bound / (query's length * bucket's longest): its local threshold. A bucket whose threshold is above 1 is skipped. Else the
query takes the cheaper of two ways: by length, the bucket's longest vectors up to bound / query's length, as one
product of matrices; or by coordinate, the vectors whose component on the query's largest axes lies where a cosine of
the threshold allows, found by bisection. Either way products are verified exactly, in whole numbers.

Bounds start from a few of the longest vectors, so a query isn't even sent to shards that are too short for it. A shard
lies in one task; queries stream past it in Arrow batches. Every (query, shard) answers k rows at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import persist_shared
from .int_vectors import matrix, whole_vectors

BUCKET_ROWS = 2048
#: Queries whose products with a bucket are held at a time.
CHUNK_ROWS = 512
#: Numbers of a shard's vectors: 64 MB as single floats.
SHARD_NUMBERS = 1 << 24
#: The longest vectors that give queries their first bounds. Any rows would do: bounds only save work.
SEED_ROWS = 1024
#: From this local threshold on coordinates are tried; on so many axes; taken if they leave this share of the bucket.
TRY_COORDINATES, AXES, COORDINATE_SHARE = 0.5, 3, 0.125

NONE = np.iinfo(np.int64).min


def _kind(longest: float) -> type:
    """The number type in which products up to ``longest`` are exact: no partial sum is larger than that."""
    return np.float32 if longest < 2**24 else np.float64 if longest < 2**53 else np.int64


def _best(row: np.ndarray, score: np.ndarray, null: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row: larger scores, then smaller ids, null ids last."""
    order = np.lexsort((ident, null, -score, row))
    starts = np.flatnonzero(np.r_[True, row[order][1:] != row[order][:-1]])
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[place < k]


class Bucket:
    """Vectors of similar length, longest first."""

    def __init__(self, ident: np.ndarray, null: np.ndarray, v: np.ndarray, norm2: np.ndarray) -> None:
        self.ident, self.null, self.v = ident, null, v
        self.length = np.sqrt(norm2.astype(np.float64))
        self.rank = np.empty(len(ident), dtype=np.int64)  # of ids, as ties are decided
        self.rank[np.lexsort((ident, null))] = np.arange(len(ident))
        self.as_kind: dict[type, np.ndarray] = {}
        self.axes: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def typed(self, kind: type) -> np.ndarray:
        if kind not in self.as_kind:
            self.as_kind[kind] = self.v.astype(kind)
        return self.as_kind[kind]

    def axis(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """Places by the angle to an axis, and the sorted angles. A zero vector lies at a right angle to all."""
        if f not in self.axes:
            cos = np.divide(self.v[:, f], self.length, out=np.zeros(len(self.v)), where=self.length > 0)
            angle = np.arccos(np.clip(cos, -1, 1))
            order = np.argsort(angle, kind="stable")
            self.axes[f] = order, angle[order]
        return self.axes[f]

    def by_coordinate(self, q: np.ndarray, cosine: float) -> np.ndarray | None:
        """Places that can have the cosine with ``q``, if its largest axes leave few: a vector within an angle of the
        query is, on each axis, within that angle of the query's own."""
        unit, room = q / np.linalg.norm(q), np.arccos(min(cosine, 1.0)) + 1e-6
        left = None
        for f in np.argsort(-np.abs(unit), kind="stable")[:AXES].tolist():
            order, angles = self.axis(f)
            mine = np.arccos(np.clip(unit[f], -1, 1))
            found = order[np.searchsorted(angles, mine - room, "left") : np.searchsorted(angles, mine + room, "right")]
            left = found if left is None else np.intersect1d(left, found, assume_unique=True)
        return left if left is not None and len(left) <= COORDINATE_SHARE * len(self.v) else None


class Shard:
    """Vectors of one width that a task holds, in buckets."""

    def __init__(self, ident: np.ndarray, null: np.ndarray, v: np.ndarray, norm2: np.ndarray, bucket_rows: int = BUCKET_ROWS) -> None:
        order = np.argsort(-norm2, kind="stable")
        cuts = [order[i : i + bucket_rows] for i in range(0, len(order), bucket_rows)]
        self.buckets = [Bucket(ident[c], null[c], v[c], norm2[c]) for c in cuts]
        #: (query, bucket) pairs by the way they went, and products computed.
        self.went = {"skipped": 0, "length": 0, "coordinate": 0, "products": 0}

    def search(self, qid: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Query's place, id, whether it is null, and score of each query's k best rows of at least its bound."""
        n = len(q)
        length = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
        bound = np.where(bound == NONE, -np.inf, bound.astype(np.float64))
        top = tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, bool, np.int64))
        for b in self.buckets:
            reach = length * b.length[0]
            asks = np.flatnonzero(reach * (1 + 1e-9) >= bound)
            self.went["skipped"] += n - len(asks)
            if not len(asks):
                continue
            local = np.divide(bound[asks], reach[asks], out=np.full(len(asks), -1.0), where=reach[asks] > 0) * (1 - 1e-9)
            hits = [top]
            by_length = np.ones(len(asks), dtype=bool)
            for i in np.flatnonzero(local >= TRY_COORDINATES).tolist():
                a = int(asks[i])
                left = b.by_coordinate(q[a].astype(np.float64), local[i])
                if left is not None:
                    by_length[i] = False
                    score = b.v[left].astype(np.int64) @ q[a].astype(np.int64)
                    good = left[(score >= bound[a]) & ((b.ident[left] != qid[a]) | b.null[left])]
                    hits.append((np.full(len(good), a), b.ident[good], b.null[good], b.v[good].astype(np.int64) @ q[a].astype(np.int64)))
                    self.went["products"] += len(left)
            self.went["coordinate"] += int((~by_length).sum())
            self.went["length"] += int(by_length.sum())
            if by_length.any():
                hits.append(self._by_length(b, asks[by_length], qid, q, length, bound, k))
            row, ident, null, score = (np.concatenate(x) for x in zip(*hits))
            best = _best(row, score, null, ident, k)
            top = row[best], ident[best], null[best], score[best]
            full = np.flatnonzero(np.bincount(top[0], minlength=n) == k)
            if len(full):
                last = np.searchsorted(top[0], full, "right") - 1
                bound[full] = np.maximum(bound[full], top[3][last])
        return top

    def _by_length(self, b: Bucket, asks: np.ndarray, qid: np.ndarray, q: np.ndarray, length: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        need = np.divide(bound[asks], length[asks], out=np.full(len(asks), -np.inf), where=length[asks] > 0) * np.where(bound[asks] > 0, 1 - 1e-9, 1)
        upto = int(np.searchsorted(-b.length, -need.min(), "right"))
        kind = _kind(float(length[asks].max() * b.length[0]) * (1 + 1e-9))
        score = q[asks].astype(kind) @ b.typed(kind)[:upto].T
        self.went["products"] += score.size
        good = (score >= bound[asks][:, None]) & ((b.ident[None, :upto] != qid[asks][:, None]) | b.null[None, :upto])
        i, j = np.nonzero(good)
        many = np.flatnonzero(np.bincount(i, minlength=len(asks)) > k)
        if len(many) and len(b.v) * float(length[asks].max() * b.length[0] + 1) < 2**53:
            # Of many hits the k best by score and id, as one number.
            key = np.where(good[many], score[many].astype(np.float64) * len(b.v) - b.rank[:upto], -np.inf)
            kept = np.argpartition(-key, k - 1, axis=1)[:, :k]
            few = ~np.isin(i, many)
            i, j = np.r_[i[few], np.repeat(many, k)], np.r_[j[few], kept.ravel()]
        return asks[i], b.ident[j], b.null[j], score[i, j].astype(np.int64)


def _by_width(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Width, places and vectors of the rows of each width."""
    widths = b.column("width").to_numpy()
    for w in np.unique(widths).tolist():
        at = np.flatnonzero(widths == w)
        yield w, at, matrix(b.column("v").take(pa.array(at)), len(at)) if w else np.zeros((len(at), 0), dtype=np.int64)


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    null = column.is_null().to_numpy(zero_copy_only=False)
    return column.fill_null(0).to_numpy(zero_copy_only=False), null


def _searcher(k: int, bucket_rows: int):
    """Rows sorted by shard, vectors (q is null) before queries, to (q, query_id, vec_id, score)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, shards = None, {}, {}
        for b in batches:
            cuts = np.flatnonzero(np.diff(b.column("shard").to_numpy(), prepend=np.nan, append=np.nan)) if b.num_rows else []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                part = b.slice(lo, hi - lo)
                if part.column("shard")[0].as_py() != at:
                    at, held, shards = part.column("shard")[0].as_py(), {}, {}
                asks = part.column("q").is_valid().to_numpy(zero_copy_only=False)
                rows, queries = part.filter(pa.array(~asks)), part.filter(pa.array(asks))
                for w, at_rows, v in _by_width(rows):
                    ident, null = _ids(rows.column("id").take(pa.array(at_rows)))
                    held.setdefault(w, []).append((ident, null, v.astype(np.int32), rows.column("norm2").to_numpy()[at_rows]))
                for w, at_rows, v in _by_width(queries):
                    if w in held:
                        shards[w] = Shard(*(np.concatenate(x) for x in zip(*held.pop(w))), bucket_rows)
                    for i in range(0, len(at_rows) if w in shards else 0, CHUNK_ROWS):
                        some = queries.take(pa.array(at_rows[i : i + CHUNK_ROWS]))
                        bound = some.column("bound").fill_null(NONE).to_numpy(zero_copy_only=False)
                        row, ident, null, score = shards[w].search(some.column("id").to_numpy(), v[i : i + CHUNK_ROWS], bound, k)
                        yield pa.RecordBatch.from_arrays([some.column("q").take(pa.array(row)), some.column("id").take(pa.array(row)), pa.array(ident, mask=null), pa.array(score)], ["q", "query_id", "vec_id", "score"])

    return work


def _bounded(seeds: dict[int, tuple], k: int):
    """Queries with the k-th best product among the seeds: no more than the k-th best of all."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = {w: Shard(*s) for w, s in seeds.items()}
        for b in batches:
            bound, told = np.zeros(b.num_rows, dtype=np.int64), np.zeros(b.num_rows, dtype=bool)
            for w, at, v in _by_width(b):
                for i in range(0, len(at) if w in shards else 0, CHUNK_ROWS):
                    some = at[i : i + CHUNK_ROWS]
                    row, _, _, score = shards[w].search(b.column("id").to_numpy()[some], v[i : i + CHUNK_ROWS], np.full(len(some), NONE), k)
                    full = np.flatnonzero(np.bincount(row, minlength=len(some)) == k)
                    bound[some[full]], told[some[full]] = score[np.searchsorted(row, full, "right") - 1] if len(full) else 0, True
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bound, mask=~told)], [*b.schema.names, "bound"])

    return work


def norm_index(vectors: DataFrame, n_shards: int) -> DataFrame:
    """shard, width, norm2, id, v: rows of (id, v) by width and length, in shards of about equal size, written."""
    norm2 = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x.cast("long"))
    # Rows of equal length, equal rows among them, are told apart by their place in the input.
    rows = vectors.select("id", "v", F.size("v").alias("width"), norm2.alias("norm2"), F.monotonically_increasing_id().alias("_at"))
    order = [F.col("width").desc(), F.col("norm2").desc()]
    ranged = rows.repartitionByRange(n_shards, *order, "_at").withColumn("shard", F.spark_partition_id())
    return persist_shared(ranged.sortWithinPartitions(*order).select("shard", "width", "norm2", "id", "v"), "norm-index")


def shards_for(df: DataFrame, n: int, width: int) -> int:
    """As many as hold the vectors within SHARD_NUMBERS each, and no fewer than there are cores while buckets last."""
    return max(-(-n * max(width, 1) // SHARD_NUMBERS), min(df.sparkSession.sparkContext.defaultParallelism, -(-n // BUCKET_ROWS)), 1)


def top_products(df: DataFrame, asks: Column | str, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product with each row of which ``asks`` (of ``id``) holds.

    Components count as floor(scale * x). Rows whose vector is null or holds null or non-finite components take no part.
    Only vectors of equal width have a product; empty ones have 0. A query's own rows are those of its id. Ties go to the
    smaller id, a null id comes last and never asks. Rows that repeat are candidates of their own, but one query if id and
    vector agree; an id with several vectors asks with each. An empty table gives no rows. Of the table only the two
    columns are read.
    """
    asks = F.expr(asks) if isinstance(asks, str) else asks
    vectors = whole_vectors(df, id_col, vector_col, scale).withColumn("id", F.col("id").cast("long"))
    n, width = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    n_shards = shards_for(df, n, width)
    index = norm_index(vectors, n_shards)
    seeds = {}
    for r in index.where("shard = 0").limit(SEED_ROWS).collect():
        seeds.setdefault(r["width"], []).append((r["id"] or 0, r["id"] is None, r["v"], r["norm2"]))
    seeds = {w: tuple(np.array(x, dtype=t).reshape(len(x), *([w] if i == 2 else [])) for i, (x, t) in enumerate(zip(zip(*rows), (np.int64, bool, np.int32, np.int64)))) for w, rows in seeds.items()}

    queries = index.where(F.col("id").isNotNull() & asks).select("id", "v", "width", "norm2").distinct().withColumn("q", F.monotonically_increasing_id())
    bounded = persist_shared(queries.mapInArrow(_bounded(seeds, k), "id long, v array<int>, width int, norm2 long, q long, bound long"), "norm-queries")

    # A query goes to the shards that hold long enough vectors of its width.
    shards = index.groupBy("shard", "width").agg(F.max("norm2").alias("top")).agg(F.collect_list(F.struct("shard", "width", "top")).alias("shards"))  # a few numbers for each shard
    far = lambda s: F.sqrt(F.col("norm2").cast("double")) * F.sqrt(s["top"].cast("double")) * (1 + 1e-9)
    meets = F.filter("shards", lambda s: (s["width"] == F.col("width")) & (F.col("bound").isNull() | (far(s) >= F.col("bound"))))
    sent = bounded.crossJoin(F.broadcast(shards)).select(F.explode(F.transform(meets, lambda s: s["shard"])).alias("shard"), "q", "id", "v", "width", "norm2", "bound")
    rows = index.select("shard", F.lit(None).cast("long").alias("q"), "id", "v", "width", "norm2", F.lit(None).cast("long").alias("bound"))
    dealt = rows.unionByName(sent).repartition(n_shards, "shard").sortWithinPartitions("shard", F.col("q").asc_nulls_first())
    found = dealt.mapInArrow(_searcher(k, bucket_rows), "q long, query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last()))
    return found.withColumn("rank", place.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
