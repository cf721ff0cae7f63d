"""Clustered bootstrap as weights: a replicate is a number of draws for each cluster, rows are never copied.

Each replicate draws as many clusters as there are, with replacement, exactly: the clusters are numbered, and a tree over
ranges of numbers splits the draws of a range between its halves by a binomial draw, seeded by the range. So any task can
find the draws of its clusters from the root down, alike in every run, and no task holds a list of all of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import persist_shared
from .ranking import with_row_number

#: Clusters of a leaf of the tree, whose draws are one multinomial draw.
LEAF = 1024


class DrawTree:
    """Draws (clusters, replicates) of any clusters of 0 .. n - 1; each replicate's draws sum to n."""

    def __init__(self, n: int, replicates: int, seed: int) -> None:
        self.n, self.replicates, self.seed, self.leaves = n, replicates, seed, -(-n // LEAF)
        self.held: dict[tuple[int, int], np.ndarray] = {}

    def _random(self, at: int, end: int) -> np.random.Generator:
        return np.random.Generator(np.random.Philox(key=[self.seed & (2**64 - 1), (at << 32) | end]))

    def _width(self, at: int, end: int) -> int:
        return min(end * LEAF, self.n) - at * LEAF

    def _range(self, leaf: int) -> np.ndarray:
        """Draws of a leaf: down the halves of ranges that hold it."""
        at, end, draws = 0, self.leaves, np.full(self.replicates, self.n)
        while end - at > 1:
            mid = (at + end) // 2
            if (at, mid) not in self.held:
                if len(self.held) > 4096:
                    self.held.clear()
                self.held[at, mid] = self._random(at, end).binomial(draws, self._width(at, mid) / self._width(at, end))
            left = self.held[at, mid]
            draws, at, end = (left, at, mid) if leaf < mid else (draws - left, mid, end)
        return draws

    def leaf(self, leaf: int) -> np.ndarray:
        """Draws (clusters of the leaf, replicates)."""
        width = self._width(leaf, leaf + 1)
        return self._random(leaf, leaf).multinomial(self._range(leaf), np.full(width, 1.0 / width)).T

    def draws(self, clusters: np.ndarray) -> np.ndarray:
        out = np.zeros((len(clusters), self.replicates), dtype=np.int64)
        for leaf in np.unique(clusters // LEAF).tolist():
            here = clusters // LEAF == leaf
            out[here] = self.leaf(leaf)[clusters[here] - leaf * LEAF]
        return out


def cluster_draws(df: DataFrame, cluster: str, replicates: int, seed: int) -> DataFrame:
    """_c (the cluster, in a struct, for null is one as well), index, draws: a byte for each replicate."""
    numbered, n = with_row_number(df.select(F.struct(F.col(cluster).alias("c")).alias("_c")).distinct().withColumn("_h", F.xxhash64("_c")), ["_h", "_c"], "index")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = DrawTree(n, replicates, seed)
        for b in batches:
            if b.num_rows:
                drawn = tree.draws(b.column("index").to_numpy() - 1)
                if drawn.max() > 255:
                    raise OverflowError("a cluster was drawn more than 255 times")  # less likely than 1 in 10**500
                yield pa.RecordBatch.from_arrays([b.column("_c"), b.column("index"), pa.array([x.tobytes() for x in drawn.astype(np.uint8)], pa.binary())], ["_c", "index", "draws"])

    kind = next(f.dataType.simpleString() for f in numbered.schema.fields if f.name == "_c")
    return persist_shared(numbered.select("_c", "index").mapInArrow(work, f"_c {kind}, index long, draws binary"), "bootstrap-draws")


def _areas(rows: DataFrame, replicates: int) -> DataFrame:
    """group, replicate, area, pos, neg with area the sum over positive rows of the negative weight below their score,
    that of their own score by half, of all replicates at once.

    One sort serves all replicates and both ways of ties; a row is never multiplied. Sorted partitions are read twice:
    for their totals, of which each group's earlier ones are the start of its rows in a later partition, and for the
    areas. Positives stand first among equal scores; half of a score's positives times its negatives are added when
    the score is over. The first and last score of a partition can go on in another one: their sums meet on the driver.
    """
    placed = persist_shared(rows.sort("group", "score", F.col("label").desc(), "index").withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "bootstrap-rows")

    def read(starts: dict[tuple[int, int], np.ndarray]):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, score, edge = None, None, True
            sums, ties = np.zeros((3, replicates)), np.zeros((2, replicates))

            def row(kind: str, key, s: float | None, x: np.ndarray) -> pa.RecordBatch:
                x = np.vstack([np.zeros((3 - len(x), replicates)), x])
                arrays = [pa.array([kind]), pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), pa.array([s], pa.float64()), *[pa.array([y.tolist()], pa.list_(pa.float64())) for y in x]]
                return pa.RecordBatch.from_arrays(arrays, ["kind", "part", "group", "score", "area", "pos", "neg"])

            for b in batches:
                part, group, value, label, n = (b.column(c).to_numpy(zero_copy_only=False) for c in ("_part", "group", "score", "label", "n"))
                drawn = np.frombuffer(b"".join(b.column("draws").to_pylist()), dtype=np.uint8).reshape(-1, replicates)
                new_key = np.r_[True, (group[1:] != group[:-1]) | (part[1:] != part[:-1])] if len(group) else np.zeros(0, bool)
                cuts = np.flatnonzero(new_key | np.r_[True, value[1:] != value[:-1]]) if len(group) else []
                for at, end in zip(cuts, [*cuts[1:], len(group)]):
                    key = (int(part[at]), int(group[at]))
                    if key != now:
                        if now is not None:
                            yield row("score", now, score, ties)
                            yield row("sums", now, None, sums)
                        now, score, edge = key, value[at], True
                        sums, ties = np.zeros((3, replicates)), np.zeros((2, replicates))
                    elif value[at] != score:
                        if edge:
                            yield row("score", now, score, ties)
                        else:
                            sums[0] += ties[0] * ties[1] / 2
                        score, edge, ties = value[at], False, np.zeros((2, replicates))
                    w = drawn[at:end] * n[at:end, None].astype(np.float64)
                    good = label[at:end] == 1
                    pos, neg = w[good].sum(axis=0), w[~good].sum(axis=0)
                    # Of one score the positives come first, here and in earlier pieces of it.
                    sums[0] += pos * (sums[2] - ties[1] + starts.get(key, 0.0))
                    sums[1] += pos
                    sums[2] += neg
                    ties += np.stack([pos, neg])
            if now is not None:
                yield row("score", now, score, ties)
                yield row("sums", now, None, sums)

        # Rows of a sorted partition may come back in several files: they are put together again.
        again = placed.repartition("_part").sortWithinPartitions("_at")
        return again.mapInArrow(work, "kind string, part int, group long, score double, area array<double>, pos array<double>, neg array<double>")

    starts: dict[tuple[int, int], np.ndarray] = {}
    running: dict[int, np.ndarray] = {}
    open_ties: dict[tuple[int, float], np.ndarray] = {}
    for r in sorted(read({}).drop("area").collect(), key=lambda r: (r["group"], r["part"])):  # three rows for each partition and group
        pos, neg = np.array(r["pos"]), np.array(r["neg"])
        if r["kind"] == "sums":
            starts[r["part"], r["group"]] = running.get(r["group"], np.zeros(replicates))
            running[r["group"]] = starts[r["part"], r["group"]] + neg
        else:
            k = (r["group"], r["score"])
            held = open_ties.setdefault(k, np.zeros((3, replicates)))
            # A score that goes on in another partition: its negatives before this one don't count as lower.
            held[2] += pos * held[1]
            held[0] += pos
            held[1] += neg
    more: dict[int, np.ndarray] = {}
    for (group, _), (pos, neg, early) in open_ties.items():
        more[group] = more.get(group, 0.0) + pos * neg / 2 - early
    each = read(starts).where("kind = 'sums'").select("group", F.posexplode(F.arrays_zip("area", "pos", "neg")).alias("replicate", "x"))
    summed = each.groupBy("group", "replicate").agg(*[F.sum(f"x.{c}").alias(c) for c in ("area", "pos", "neg")])
    extra = rows.sparkSession.createDataFrame([(g, i, float(v)) for g, x in more.items() for i, v in enumerate(x)], "group long, replicate int, more double")
    return summed.join(extra, ["group", "replicate"]).withColumn("area", F.col("area") + F.col("more")).drop("more")


def bootstrap_auc(df: DataFrame, score: str, label: str, cluster: str, replicates: int = 100, seed: int = 42, keys: Sequence[str] = ()) -> DataFrame:
    """replicate, keys, auc of each replicate that has both classes.

    Clusters are drawn from all rows with a score and a label, whatever their keys; null is one of them. Rows are summed
    by (cluster, score, label) first. Ties count half. Groups by ``keys`` should be few (folds, strata): their totals
    meet on the driver.
    """
    there = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    # One draw of the clusters serves all keys, so the sums are written once.
    small = persist_shared(there.groupBy(*keys, F.struct(F.col(cluster).alias("c")).alias("_c"), F.col(score).cast("double").alias("score"), F.col(label).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n")), "bootstrap-sums")
    named = persist_shared(small.select(*keys).distinct().withColumn("group", F.monotonically_increasing_id()), "bootstrap-groups") if keys else None
    drawn = small.join(cluster_draws(small.select("_c.c"), "c", replicates, seed), "_c")
    if named is not None:
        other = named.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "group")
        same = F.lit(True)
        for i, k in enumerate(keys):
            same &= drawn[k].eqNullSafe(other[f"_k{i}"])
        drawn = drawn.join(other, same)
    else:
        drawn = drawn.withColumn("group", F.lit(0).cast("long"))
    both = _areas(drawn.select("group", "score", "label", "index", "n", "draws"), replicates).where("pos > 0 and neg > 0")
    out = both.select("group", "replicate", (F.col("area") / F.col("pos") / F.col("neg")).alias("auc"))
    return (out.join(named, "group") if named is not None else out).select("replicate", *keys, "auc")


def interval(values: DataFrame, col: str, keys: Sequence[str] = (), level: float = 0.95) -> DataFrame:
    """keys, low, high: the middle ``level`` of the values (one for each replicate), nulls and NaN left out."""
    tail = (1 - level) / 2
    good = values.where(F.col(col).isNotNull() & ~F.isnan(col))
    return good.groupBy(*keys).agg(F.percentile(col, F.lit(tail)).alias("low"), F.percentile(col, F.lit(1 - tail)).alias("high"))


def pooled_bootstrap(df: DataFrame, score: str, label: str, cluster: str, fold: str, replicates: int = 100, seed: int = 42) -> DataFrame:
    """One row: low, high of the mean over folds; a fold without both classes is skipped, 0.5 where all are."""
    each = bootstrap_auc(df, score, label, cluster, replicates, seed, [fold]).groupBy("replicate").agg(F.avg("auc").alias("auc"))
    every = df.sparkSession.range(replicates).select(F.col("id").cast("int").alias("replicate")).join(each, "replicate", "left")
    return interval(every.withColumn("auc", F.coalesce("auc", F.lit(0.5))), "auc")


def permute_within(df: DataFrame, col: str, bucket: Sequence[str], key: str, name: str, seed: int = 42) -> DataFrame:
    """The column shuffled among the rows of each bucket: a true permutation, by hash order against key order.

    Both orders put buckets first, so a bucket's rows have the same numbers in both; no window holds a bucket.
    """
    left, _ = with_row_number(df, [*bucket, key], "_i")
    right, _ = with_row_number(df.select(*bucket, key, F.col(col).alias(name)), [*bucket, F.xxhash64(F.lit(seed), key), key], "_i")
    return left.join(right.select("_i", name), "_i").drop("_i")
