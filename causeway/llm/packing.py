"""Conflict-constrained best-fit packing of documents into sequences of fixed capacity.

Documents are dealt by hash into shards of bounded size, and each shard is packed on its own, largest piece first.
Bins are kept in the order of their residual capacity and carry bitmaps of the sources and duplicate clusters they
hold; a piece goes to the tightest bin that fits and has neither its source nor its cluster, found by searching
the successors of its size. A document longer than the capacity is cut into full bins and a rest.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import count_words, persist_shared, text_of

CAPACITY = 2048
SHARD_ROWS = 4096


def pack_shard(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(row, first word, words, bin, offset in the bin) of every piece, in the order of placing.

    Rows of size 0 are packed as empty pieces, which take no room but keep the constraints.
    """
    source_bit = {s: i for i, s in enumerate(dict.fromkeys(sources))}
    cluster_bit = {c: i for i, c in enumerate(dict.fromkeys(clusters))}
    out, bins, order = [], [], []  # bins: [source bitmap, cluster bitmap]; order: sorted (residual, bin)
    rests = []
    for row, size in enumerate(sizes):
        whole = size // capacity if size > capacity else 0
        for k in range(whole):
            out.append((row, k * capacity, capacity, len(bins), 0))
            bins.append([1 << source_bit[sources[row]], 1 << cluster_bit[clusters[row]]])
        if size - whole * capacity or not whole:
            rests.append((-(size - whole * capacity), row, whole * capacity))
    for negative, row, first in sorted(rests):
        size, s, c = -negative, 1 << source_bit[sources[row]], 1 << cluster_bit[clusters[row]]
        at = bisect_left(order, (size, -1))
        while at < len(order) and (bins[order[at][1]][0] & s or bins[order[at][1]][1] & c):
            at += 1
        if at < len(order):
            left, b = order.pop(at)
        else:
            left, b = capacity, len(bins)
            bins.append([0, 0])
        bins[b][0] |= s
        bins[b][1] |= c
        out.append((row, first, size, b, capacity - left))
        if left > size:
            insort(order, (left - size, b))
    return out


def pack(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    source_col: str = "source",
    cluster_col: str | None = None,
    capacity: int = CAPACITY,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """One row per piece: doc_id, first_word, n_words, shard, bin, bin_offset, source, cluster.

    Sizes are words of the whole text; without ``cluster_col`` rows of equal text are one cluster. Null and empty texts
    are one empty piece; texts longer than a bin are cut into full bins and a rest; null sources are one source, null ids
    ids like others; repeated rows are one cluster and so never share a bin; pieces of equal size are placed in the order
    of id, source, cluster; an empty table gives an empty result; other columns are ignored, so names cannot clash.
    """
    text = text_of(docs, text_col)
    cluster = F.xxhash64(text) if cluster_col is None else docs[cluster_col].cast("long")
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"), docs[source_col].cast("string").alias("source"), cluster.alias("cluster"), count_words(text).alias("size")
    )
    # Only sizes and keys are shuffled. Repeated rows are told apart, so that no shard gets them all.
    rows = persist_shared(rows.withColumn("nth", F.monotonically_increasing_id()), "pack-rows")
    shards = max(1, -(-rows.count() // shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "nth"), F.lit(shards)).cast("int"))
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", "doc_id", "source", "cluster", "size")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(shard: int, held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
            t = pa.concat_tables(held)
            pieces = pack_shard(t.column("size").to_pylist(), t.column("source").to_pylist(), t.column("cluster").to_pylist(), capacity)
            row, first, n, b, offset = (pa.array(x, pa.int64()) for x in zip(*pieces))
            own = t.select(["doc_id", "source", "cluster"]).take(row)
            whole = pa.Table.from_arrays([own.column("doc_id"), first, n, pa.array([shard] * len(row), pa.int32()), b.cast(pa.int32()), offset, own.column("source"), own.column("cluster")], names)
            yield from whole.combine_chunks().to_batches()

        names = ["doc_id", "first_word", "n_words", "shard", "bin", "bin_offset", "source", "cluster"]
        held, shard = [], None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            ids = t.column("shard").to_numpy()
            at = 0
            while at < len(ids):
                end = int(ids.searchsorted(ids[at], side="right"))
                if held and shard != ids[at]:
                    yield from packed(shard, held)
                    held = []
                shard = int(ids[at])
                held.append(t.slice(at, end - at))
                at = end
        if held:
            yield from packed(shard, held)

    return dealt.mapInArrow(work, "doc_id long, first_word long, n_words long, shard int, bin int, bin_offset long, source string, cluster long")
