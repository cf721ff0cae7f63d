"""Dense vector search and causal centroids."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import cosine, norm
from ..sources.shared import persist_shared
from .apply import BLOCK_ROWS, sorted_groups
from .ranking import with_row_number

#: Rows of one block of an all-pairs comparison, as long as there are at most MOST_BLOCKS; beyond that blocks grow, up to MOST_ROWS.
PAIR_ROWS, MOST_BLOCKS, MOST_ROWS = 1024, 32, 65_536
#: Two blocks are compared in tiles of so many rows of either; so many hits of them are held before they are thinned.
TILE, HELD_HITS = (512, 8192), 4_000_000


def dense_top_k(df: DataFrame, vector: str, query: Sequence[float], k: int, least: float, key: str) -> DataFrame:
    """The k rows most similar to one query vector, of at least ``least``: one scan, k rows kept by each task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return df.withColumn("similarity", F.round(cosine(F.col(vector), q), 9)).where(F.col("similarity") >= least).orderBy(F.col("similarity").desc(), key).limit(k)


#: Which hits of two blocks to answer: (ids, i, j, similarity) to their places.
Keep = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def best_partners(k: int, earlier: bool = False) -> Keep:
    """Each row's k best partners, ties by id, to nine decimals; with ``earlier`` only partners of smaller id."""

    def first(whose: np.ndarray, partner: np.ndarray, s: np.ndarray) -> np.ndarray:
        order = np.lexsort((partner, -s, whose))
        new = np.append(True, whose[order][1:] != whose[order][:-1])
        start = np.flatnonzero(new)
        return order[np.arange(len(order)) - start[np.cumsum(new) - 1] < k]

    def keep(ids: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: np.ndarray) -> np.ndarray:
        s = np.round(similarity, 9)
        a, b = ids[i], ids[j]
        if earlier:
            return first(np.maximum(a, b), np.minimum(a, b), s)
        return np.union1d(first(a, b, s), first(b, a, s))

    return keep


def tree_of_hits(ids: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: np.ndarray) -> np.ndarray:
    """Hits that connect what all of them connect, fewer than there are rows."""
    root = np.arange(len(ids))
    taken = []
    while (open_ := np.flatnonzero(root[i] != root[j])).size:
        # Each tree takes the first of its edges that lead to a smaller one, so no ring can close.
        high, at = np.unique(np.maximum(root[i[open_]], root[j[open_]]), return_index=True)
        at = open_[at]
        taken.append(at)
        root[high] = np.minimum(root[i[at]], root[j[at]])
        while (root != root[root]).any():
            root = root[root]
    return np.concatenate(taken) if taken else np.zeros(0, np.int64)


def _hits(least: float, keep: Keep | None):
    """Pairs of a block pair (g, x, y) with a cosine of at least ``least``: side 0 against side 1, side 2 among itself.

    Without ``keep`` all hits are answered, tile by tile; else those that it keeps of what is held and of each tile's.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, ["g", "x", "y"]):
            lists = t.column("v").combine_chunks()
            v = lists.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1).astype(float)
            size = np.linalg.norm(v, axis=1)
            v = v / np.where(size == 0, 1.0, size)[:, None]
            k, side = t.column("k").combine_chunks(), t.column("side").to_numpy()
            ids = k.to_numpy(zero_copy_only=False) if keep else None
            answer = lambda i, j, s: pa.RecordBatch.from_arrays([k.take(pa.array(i)), k.take(pa.array(j)), pa.array(s)], ["a", "b", "similarity"])
            held, n_held = [], 0

            def thin() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
                i, j, s = (np.concatenate(x) for x in zip(*held))
                at = keep(ids, i, j, s)
                return [(i[at], j[at], s[at])]

            for a, b in ((np.flatnonzero(side == 0), np.flatnonzero(side == 1)), (np.flatnonzero(side == 2),) * 2):
                for at in range(0, len(a), TILE[0]):
                    for to in range(at // TILE[1] * TILE[1] if a is b else 0, len(b), TILE[1]):
                        cos = v[a[at : at + TILE[0]]] @ v[b[to : to + TILE[1]]].T
                        near = cos >= least
                        if a is b:
                            near = np.triu(near, at - to + 1)
                        i, j = np.nonzero(near)
                        if not len(i):
                            continue
                        i, j, s = a[at + i], b[to + j], cos[i, j]
                        if keep is None:
                            yield answer(i, j, s)
                            continue
                        other = ids[i] != ids[j]
                        held.append((i[other], j[other], s[other]))
                        n_held += len(i)
                        if n_held > HELD_HITS:
                            held = thin()
                            n_held = len(held[0][0])
                            if n_held > HELD_HITS // 2:  # as many as that stand: they are answered, and what follows is thinned alone
                                yield answer(*held[0])
                                held, n_held = [], 0
            if held:
                yield answer(*thin()[0])

    return work


def _near(dealt: DataFrame, key: str, least: float, keep: Keep | None = None) -> DataFrame:
    """src < dst, similarity of the hits of all block pairs of rows g, x, y, side, k, v."""
    kind = dict(dealt.dtypes)["k"]
    met = dealt.repartition("g", "x", "y").sortWithinPartitions("g", "x", "y").mapInArrow(_hits(least, keep), f"a {kind}, b {kind}, similarity double")
    return met.where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "similarity")


def _placed(df: DataFrame, key: str, vector: str, group: Column, block_rows: int) -> DataFrame:
    """g, k, v, b (the row's block in its group) and n_b, the blocks of the group: as many as its rows ask for, MOST_BLOCKS until those are full."""
    kind = F.col(vector) if dict(df.dtypes)[vector] in ("array<float>", "array<double>") else F.col(vector).cast("array<double>")
    rows = df.where(F.col(vector).isNotNull()).select(group.cast("long").alias("g"), F.col(key).alias("k"), kind.alias("v"))
    blocks = lambda rows: F.ceil(F.count(F.lit(1)) / rows)
    sizes = rows.groupBy("g").agg(F.greatest(F.least(blocks(block_rows), F.lit(MOST_BLOCKS)), blocks(MOST_ROWS)).cast("int").alias("n_b"))
    return rows.join(sizes, "g").withColumn("b", F.pmod(F.xxhash64("k"), F.col("n_b")).cast("int"))


def exact_pairs(df: DataFrame, key: str, vector: str, least: float, group: Column | None = None, block_rows: int = PAIR_ROWS, keep: Keep | None = None) -> DataFrame:
    """src < dst, similarity of all pairs (of a group) with a cosine of at least ``least``.

    Rows are dealt into blocks of about ``block_rows``, larger ones beyond MOST_BLOCKS, so what is shuffled grows with the rows
    until blocks hold MOST_ROWS; two blocks meet as matrices in a task, tile by tile, which answers hits only, with ``keep``
    those of each two blocks that it keeps. All pairs are compared: the work grows with the square of the rows. See ``vector_index``.
    """
    placed = _placed(df, key, vector, F.lit(0) if group is None else group, block_rows)
    dealt = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n_b") - 1))).withColumns({"x": F.least("b", "o"), "y": F.greatest("b", "o")})
    side = F.when(F.col("x") == F.col("y"), 2).when(F.col("b") == F.col("x"), 0).otherwise(1)
    return _near(dealt.select("g", "x", "y", side.alias("side"), "k", "v"), key, least, keep)


def nearest(pairs: DataFrame, k: int) -> DataFrame:
    """The k best partners of each node of an undirected pair list, as canonical edges: src < dst, similarity."""
    both = pairs.select("src", "dst", "similarity").union(pairs.select("dst", "src", "similarity"))
    place = F.row_number().over(Window.partitionBy("src").orderBy(F.col("similarity").desc(), "dst"))
    kept = both.withColumn("place", place).where(F.col("place") <= k)
    return kept.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("similarity").alias("similarity"))


#: Bytes of the items' vectors that are shipped to every task; larger tables of items are joined.
SHIPPED_BYTES = 64 << 20


def causal_affinity(
    rows: DataFrame, vectors: DataFrame, user: str, item: str, order: Sequence[str], acted: str, key: str, shrink: float = 0.0, block_rows: int = BLOCK_ROWS, shipped_bytes: int = SHIPPED_BYTES
) -> DataFrame:
    """key, n_prior, affinity: cosine of a row's vector with the sum of its user's earlier acted-on vectors.

    With ``shrink`` the centroid is pulled toward the mean vector of all items: (sum + shrink * mean) / (n + shrink).
    0 without earlier actions (unless shrunk) or without a vector. ``vectors`` has one row for each item. Rows in the
    order of users and time are cut into blocks, each a group in numpy; a history that goes on from earlier blocks starts
    from the running sum of their totals. Rows are sorted and written with their item's id, not its vector: vectors come
    to the blocks as one shipped matrix where they fit ``shipped_bytes``, else by a join on the way.
    """
    vec = vectors.where(F.col(item).isNotNull() & F.col("vector").isNotNull()).select(F.col(item).alias("_item"), F.col("vector").cast("array<double>").alias("vector"))
    mean = np.zeros(0)
    if shrink:
        rows_mean = vec.select(F.posexplode("vector").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).orderBy("i").collect()  # one number for each dimension
        mean = np.array([r["m"] for r in rows_mean])
    n_items, width = vec.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    shipped = None
    if n_items * width * 8 <= shipped_bytes:
        held = vec.orderBy("_item").collect()  # within shipped_bytes
        shipped = rows.sparkSession.sparkContext.broadcast((pd.Index([r["_item"] for r in held]), np.array([r["vector"] for r in held], dtype=float).reshape(len(held), width)))

    thin = rows.select(key, user, F.col(item).alias("_item"), *[c for c in order if c not in (key, user)], F.coalesce(F.col(acted), F.lit(False)).alias("_acted"))
    numbered, _ = with_row_number(thin, [user, *[c for c in order if c != user], *([] if key in order else [key])], "_n")
    name = F.coalesce(F.concat(F.lit("u"), F.col(user).cast("string")), F.lit(""))
    blocks = numbered.select(key, name.alias("_user"), F.floor((F.col("_n") - 1) / block_rows).alias("_block"), "_n", F.col("_acted").cast("long").alias("_acted"), "_item", F.lit(None).cast("array<double>").alias("_state"))
    if shipped is None:
        blocks = blocks.join(vec, "_item", "left")

    def arrays(g: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, list[int]]:
        """The block in order, its vectors (zeros where there is none), how many actions a row counts for, and where its users' rows begin and end."""
        g = g.sort_values("_n", kind="stable")
        v, has = np.zeros((len(g), width)), np.zeros(len(g), bool)
        if shipped is None:
            has = g["vector"].notna().to_numpy()
            if has.any():
                v[has] = np.concatenate(g["vector"][has].tolist()).reshape(-1, width)
        elif len(shipped.value[0]):
            index, matrix = shipped.value
            some = g["_item"].notna().to_numpy()
            at = np.full(len(g), -1)
            at[some] = index.get_indexer(g["_item"][some].astype(index.dtype))
            has = at >= 0
            v[has] = matrix[at[has]]
        start = g["_n"].to_numpy() == 0
        if start.any():
            v[start] = np.stack(g["_state"][start].tolist())
        users = g["_user"].to_numpy()
        return g, v, np.where(start | has, g["_acted"].to_numpy(), 0), [0, *(np.flatnonzero(users[1:] != users[:-1]) + 1).tolist(), len(g)]

    def tail(g: pd.DataFrame) -> pd.DataFrame:
        g, v, count, cuts = arrays(g)
        n = count[cuts[-2] :]
        return pd.DataFrame({"_user": [g["_user"].iloc[-1]], "_block": [g["_block"].iloc[0]], "_count": [n.sum()], "vector": [v[cuts[-2] :][n > 0].sum(axis=0)]})

    # Only a block's last user can go on in the next one.
    tails = persist_shared(blocks.groupBy("_block").applyInPandas(tail, "_user string, _block long, _count long, vector array<double>"), "affinity-tails")
    upto = Window.partitionBy("_user", "i").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    sums = tails.select("_user", "_block", "_count", F.posexplode("vector").alias("i", "x")).select("_user", "_block", "i", F.sum("x").over(upto).alias("x"), F.sum("_count").over(upto).alias("n"))
    states = sums.groupBy("_user", "_block").agg(F.max("n").alias("_count"), F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    kinds = dict(blocks.dtypes)
    begun = states.select(F.lit(0).cast(kinds[key]).alias(key), "_user", (F.col("_block") + 1).alias("_block"), F.lit(0).cast("long").alias("_n"), F.col("_count").alias("_acted"), F.lit(None).cast(kinds["_item"]).alias("_item"), F.col("v.x").alias("_state"))

    def work(g: pd.DataFrame) -> pd.DataFrame:
        g, v, count, cuts = arrays(g)
        start = g["_n"].to_numpy() == 0
        w = np.where(start, 1.0, count)[:, None] * v
        total, n = np.empty_like(v), np.empty(len(g), dtype=np.int64)
        for a, b in zip(cuts, cuts[1:]):
            total[a:b] = np.cumsum(w[a:b], axis=0) - w[a:b]
            n[a:b] = np.cumsum(count[a:b]) - count[a:b]
        center = (total + shrink * mean) / (n + shrink)[:, None] if shrink else total
        size = np.linalg.norm(center, axis=1) * np.linalg.norm(v, axis=1)
        cos = np.divide((center * v).sum(axis=1), size, out=np.zeros(len(g)), where=size > 1e-12)
        if not shrink:
            cos[n == 0] = 0.0
        return pd.DataFrame({key: g[key], "n_prior": n, "affinity": cos})[~start]

    return blocks.unionByName(begun, allowMissingColumns=True).groupBy("_block").applyInPandas(work, f"{key} {kinds[key]}, n_prior long, affinity double")


def embedding_report(df: DataFrame, vector: str, tolerance: float = 1e-4) -> DataFrame:
    """One row: n, covered (share with a vector), unit (share of those whose length is 1 within the tolerance)."""
    there = F.col(vector).isNotNull()
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(there.cast("double")).alias("covered"), F.avg(F.when(there, (F.abs(norm(F.col(vector)) - 1) <= tolerance).cast("double"))).alias("unit"))
