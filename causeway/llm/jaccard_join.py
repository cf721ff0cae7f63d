"""N-gram Jaccard join by MinHash banding.

Texts with the same shingle set are one class and take part once. Bands and rows are chosen for a target recall at
the threshold; classes meet on band hashes, and each pair is verified on the full shingle sets in the first band
that it shares. Buckets of any size are dealt out as pairs of bounded blocks, and a block pair answers with sums and
a spanning forest of its links, not with the pairs: large groups of near copies cost no quadratic output. Exact link
counts need every pair of a bucket compared, but no shingle set travels to all of them: in a bucket of more than
LEAD_BLOCKS blocks each class is first set against the bucket's lead, its least class, once however many bands share that
lead, and only its difference from the lead, small for near copies, travels to the block pairs. Differences from one
lead give the overlap of two sets exactly. Such a bucket has WIDE_BLOCKS blocks, whatever its classes, until they are full with
MOST_CLASSES, so its rows are copied in proportion to their number until then; a task takes a pair of blocks apart
into pieces of BLOCK_CLASSES, so what it holds besides the rows doesn't depend on the group. Rows are joined before they are
dealt, so that no join makes the copies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.apply import sorted_groups
from ..operators.graph import connected_components
from .common import persist_shared, text_of
from .shingles import band_hashes, choose_bands, fingerprint, shingle_set

N, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.998, 96
#: Bounds of a block: classes, and shingles on average. Small blocks keep the tasks even.
BLOCK_CLASSES, BLOCK_SHINGLES = 128, 250_000
#: The same for blocks of differences.
MOST_CLASSES, MOST_SHINGLES = 4096, 2_000_000
#: Buckets of more blocks send differences instead of sets; over how many keys the classes of one lead are dealt.
LEAD_BLOCKS, LEAD_SALTS = 4, 32
#: Blocks of a bucket of differences, as long as they aren't full.
WIDE_BLOCKS = 6
_GROUP = ["band", "hash", "bi", "bj"]


def text_prints(docs: DataFrame, text_col: str, id_col: str, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, print, fp_a, fp_b, n_shingles, bands: one row per row of ``docs``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c, sizes, hashes = [], [], [], []
            for text in b.column("text"):
                s = shingle_set(text.as_py(), n)
                fa, fb = fingerprint(s)
                a.append(fa)
                c.append(fb)
                sizes.append(len(s))
                hashes.append(band_hashes(s, bands, rows).astype(np.int64) if len(s) else np.zeros(0, np.int64))
            offsets = np.cumsum([0, *map(len, hashes)])
            flat = np.concatenate([np.zeros(0, np.int64), *hashes])
            arrays = [b.column("doc_id"), b.column("print"), pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(sizes, pa.int32())]
            yield pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))], ["doc_id", "print", "fp_a", "fp_b", "n_shingles", "bands"])

    text = text_of(docs, text_col)
    rows_in = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("print"), text.alias("text"))
    return rows_in.mapInArrow(work, "doc_id long, print long, fp_a long, fp_b long, n_shingles int, bands array<long>")


def _new_pairs(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) of the pairs of this block pair that share no earlier band, piece by piece."""
    band = t.column("band")[0].as_py()
    matrix = np.array(t.column("bands").combine_chunks().flatten()).reshape(t.num_rows, -1)
    block = t.column("block").to_numpy()
    left = np.flatnonzero(block == t.column("bi")[0].as_py())
    same = t.column("bi")[0].as_py() == t.column("bj")[0].as_py()
    right = left if same else np.flatnonzero(block == t.column("bj")[0].as_py())
    for at in range(0, len(left), BLOCK_CLASSES):
        for to in range(at if same else 0, len(right), BLOCK_CLASSES):
            l, r = left[at : at + BLOCK_CLASSES], right[to : to + BLOCK_CLASSES]
            fresh = np.ones((len(l), len(r)), bool)
            for k in range(band):
                fresh &= matrix[l, k][:, None] != matrix[r, k][None, :]
            if same and at == to:
                fresh &= l[:, None] < r[None, :]
            i, j = np.nonzero(fresh)
            if len(i):
                yield l[i], r[j]


def _with_new_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block pair the rows that stand in a new pair."""
    for t in sorted_groups(batches, _GROUP):
        stands = np.zeros(t.num_rows, bool)
        for i, j in _new_pairs(t):
            stands[i] = stands[j] = True
        if stands.any():
            yield from t.select([*_GROUP, "block", "cid", "lead"]).take(np.flatnonzero(stands)).combine_chunks().to_batches()


def _part(flat: np.ndarray, offsets: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sets of the rows i and j alone, and their places there."""
    rows, place = np.unique(np.concatenate([i, j]), return_inverse=True)
    sets = [flat[offsets[r] : offsets[r + 1]] for r in rows.tolist()]
    return np.concatenate(sets), np.cumsum([0, *map(len, sets)]), place[: len(i)], place[len(i) :]


def _join_trees(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row of each tree, after the trees of i and j are joined."""
    while (root[i] != root[j]).any():
        a, b = root[i], root[j]
        np.minimum.at(root, a, b)
        np.minimum.at(root, b, a)
        while (root != root[root]).any():
            root = root[root]
    return root


def _overlaps(flat: np.ndarray, offsets: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets of rows i and j."""
    if len(i) <= 64:
        part = [flat[offsets[r] : offsets[r + 1]] for r in range(len(offsets) - 1)]
        return np.array([len(np.intersect1d(part[a], part[b], assume_unique=True)) for a, b in zip(i, j)], dtype=np.int64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.argsort(flat, kind="stable")
    values, owner = flat[order], owner[order]
    term = np.cumsum(np.append(True, values[1:] != values[:-1])) - 1
    common = np.bincount(term) > 1
    here = common[term]
    term, owner = (np.cumsum(common) - 1)[term[here]], owner[here]
    n, width = len(offsets) - 1, 4096
    total = np.zeros((n, n), np.float32)
    cut = np.searchsorted(term, np.arange(0, int(common.sum()) + width, width))
    for k, (at, end) in enumerate(zip(cut[:-1], cut[1:])):
        if end > at:
            m = np.zeros((n, width), np.float32)
            m[owner[at:end], term[at:end] - k * width] = 1
            total += m @ m.T
    return total[i, j].astype(np.int64)


def _verifier(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """cid, root, links: for each class of a block pair the documents that it links to, and a class of its tree."""
        for t in sorted_groups(batches, _GROUP):
            deltas = t.column("delta").combine_chunks()
            offsets = deltas.offsets.to_numpy() - deltas.offsets[0].as_py()
            flat = deltas.flatten().to_numpy().view(np.uint64)
            sizes, copies, missing = (t.column(c).to_numpy() for c in ("n_shingles", "copies", "n_missing"))
            links, root = np.zeros(t.num_rows), np.arange(t.num_rows)
            for i, j in _new_pairs(t):
                # |A & B| = |L| - |L - A| - |L - B| + |dA & dB| with the lead L and dX, what is in just one of X and L.
                both = t.column("n_lead")[0].as_py() - missing[i] - missing[j] + _overlaps(*_part(flat, offsets, i, j))
                near = both >= threshold * (sizes[i] + sizes[j] - both) - 1e-9
                i, j = i[near], j[near]
                links += np.bincount(i, copies[j], t.num_rows) + np.bincount(j, copies[i], t.num_rows)
                root = _join_trees(root, i, j)
            rows, cid = np.flatnonzero(links > 0), t.column("cid").to_numpy()
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(cid[rows]), pa.array(cid[root[rows]]), pa.array(links[rows].astype(np.int64))], ["cid", "root", "links"])

    return verify


def jaccard_classes(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, most_hashes: int = MOST_HASHES
) -> DataFrame:
    """One row per row of ``docs``: doc_id, print, class_id, class_print, n_links.

    class_id is the smallest doc_id of all documents that links connect; n_links counts the other documents whose
    shingle sets have a Jaccard similarity of ``threshold`` or more, copies included. Null and empty texts, and others
    without words, link to nothing and are classes of their own; very long texts are shingled whole, shorter ones than
    ``n`` words are one shingle; repeated rows are copies of each other; null ids stand last and are answered; ties in id
    fall to the text's hash; an empty table gives an empty result; other columns are ignored, so names cannot clash.
    """
    bands, rows = choose_bands(threshold, recall, most_hashes)
    prints = persist_shared(text_prints(docs, text_col, id_col, n, bands, rows), "jaccard-prints")
    # A null doc_id stands last.
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "print")
    classes = prints.where("n_shingles > 0").groupBy("fp_a", "fp_b").agg(
        F.min(key).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")
    )
    classes = persist_shared(classes.withColumn("cid", F.monotonically_increasing_id()), "jaccard-classes")

    thin = classes.select("cid", "n_shingles", F.posexplode("bands").alias("band", "hash"))
    buckets = thin.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("sum"), F.min("cid").alias("lead")).where("n > 1")
    count = lambda classes, shingles: F.greatest(F.ceil(F.col("n") / classes), F.ceil(F.least(F.col("sum") / shingles, F.col("n")))).cast("int")
    small, wide = count(BLOCK_CLASSES, BLOCK_SHINGLES), count(F.least(F.lit(MOST_CLASSES), F.greatest(F.lit(BLOCK_CLASSES), F.col("n") / WIDE_BLOCKS)), MOST_SHINGLES)
    led = small > LEAD_BLOCKS
    members = thin.drop("n_shingles").join(buckets.select("band", "hash", F.when(led, wide).otherwise(small).alias("blocks"), F.when(led, F.col("lead")).alias("lead")), ["band", "hash"])
    members = members.withColumn("block", F.pmod(F.xxhash64("cid"), "blocks").cast("int"))
    dealt = members.join(classes.select("cid", "bands"), "cid").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("band", "hash", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "cid", "lead", "bands")
    found = dealt.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(_with_new_pairs, "band int, hash long, bi int, bj int, block int, cid long, lead long")
    found = persist_shared(found, "jaccard-candidates")

    leads = found.where("lead is not null")
    wanted = found.select("cid").union(leads.select("lead")).distinct().join(classes, "cid").select("cid", "fp_a", "fp_b", "rep.doc_id", "rep.print", "copies", "n_shingles", "bands")
    wanted = persist_shared(wanted, "jaccard-wanted")
    sets = persist_shared(_sets(docs, wanted, text_col, id_col, n), "jaccard-sets")
    deltas = persist_shared(_deltas(leads, sets), "jaccard-deltas")
    # The places of a class, bounded by bands and blocks, are gathered, joined with its set once and dealt out behind the join.
    places = lambda rows, *by: rows.groupBy(*by).agg(F.collect_list(F.struct(*_GROUP, "block")).alias("at"))
    about = ["copies", "n_shingles", "bands"]
    alone = places(found.where("lead is null"), "cid").join(sets, "cid").select("at", "cid", F.col("shingles").alias("delta"), F.lit(0).alias("n_missing"), F.lit(0).alias("n_lead"), *about)
    apart = places(leads, "cid", "lead").join(deltas, ["cid", "lead"]).select("at", "cid", "delta", "n_missing", "n_lead", *about)
    verified = alone.union(apart).withColumn("at", F.explode("at")).select("at.*", "cid", "delta", "n_missing", "n_lead", *about).repartition(*_GROUP).sortWithinPartitions(*_GROUP)
    links = persist_shared(verified.mapInArrow(_verifier(threshold), "cid long, root long, links long"), "jaccard-links")

    trees = connected_components(links, "cid", "root")
    degree = links.groupBy("cid").agg(F.sum("links").alias("links"))
    labelled = classes.join(trees.select(F.col("node").alias("cid"), "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    firsts = labelled.groupBy("component").agg(F.min("rep").alias("first"))
    labelled = persist_shared(labelled.drop("bands", "rep"), "jaccard-labelled").join(persist_shared(firsts, "jaccard-firsts"), "component").join(degree, "cid", "left")
    told = labelled.select("fp_a", "fp_b", "first", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = prints.join(persist_shared(told, "jaccard-told"), ["fp_a", "fp_b"], "left")
    own = F.col("first").isNull()
    return out.select(
        "doc_id", "print", F.when(own, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.when(own, F.col("print")).otherwise(F.col("first.print")).alias("class_print"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def _deltas(leads: DataFrame, sets: DataFrame) -> DataFrame:
    """cid, lead, delta, n_missing, n_lead, and copies, n_shingles, bands of the class: what is in just one of a class's set and its lead's, how much of the lead the
    class lacks, and the size of the lead. A lead's classes are dealt over LEAD_SALTS keys."""
    own = leads.select("cid", "lead").distinct().withColumn("salt", F.pmod(F.xxhash64("cid"), F.lit(LEAD_SALTS)))
    heads = leads.select("lead").distinct().join(sets.select(F.col("cid").alias("lead"), F.col("shingles").alias("head")), "lead")
    heads = heads.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LEAD_SALTS - 1).cast("long"))))
    met = own.join(sets, "cid").join(heads, ["lead", "salt"]).withColumn("lacks", F.array_except("head", "shingles"))
    delta = F.concat("lacks", F.array_except("shingles", "head")).alias("delta")
    return met.select("cid", "lead", delta, F.size("lacks").alias("n_missing"), F.size("head").alias("n_lead"), "copies", "n_shingles", "bands")


def _sets(docs: DataFrame, wanted: DataFrame, text_col: str, id_col: str, n: int) -> DataFrame:
    """cid, the shingle set, copies, n_shingles and bands of each wanted class, its set from the text of one of its rows."""
    about = ["copies", "n_shingles", "bands"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                found = [shingle_set(x.as_py(), n) for x in part.column("text")]
                offsets = np.cumsum([0, *map(len, found)])
                flat = np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)
                shingles = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column("cid"), shingles, *[part.column(c) for c in about]], ["cid", "shingles", *about])

    text = text_of(docs, text_col)
    key = lambda i, p: F.struct(i.alias("doc_id"), p.alias("print")).alias("_key")  # noqa: E731  structs are equal where their nulls are
    # Repeated rows become one where they are read, and texts are shuffled once, for the join too.
    single = docs.select(key(docs[id_col].cast("long"), F.xxhash64(text)), text.alias("text")).groupBy("_key").agg(F.min("text").alias("text"))
    texts = single.join(wanted.select("cid", key(F.col("doc_id"), F.col("print")), *about), "_key")
    return texts.select("cid", "text", *about).mapInArrow(work, "cid long, shingles array<long>, copies long, n_shingles int, bands array<long>")


def near_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` with one row left of each class, the first by id, with their columns.

    Null, empty and blank texts are classes of their own and stay; a null id is last in its class; very long texts are
    compared whole; of rows that repeat id and text the one whose columns hash lowest stays, however many they are; an
    empty table gives an empty result; columns that clash with the operator's keep their names.
    """
    found = jaccard_classes(docs, text_col, id_col, **options)
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("print") == F.col("class_print")))
    key = lambda i, p: F.struct(i.alias("doc_id"), p.alias("print")).alias("_key")  # noqa: E731  structs are equal where their nulls are
    stay = persist_shared(stay.select(key(F.col("doc_id"), F.col("print"))).distinct(), "jaccard-stay")
    names = [f"_d{i}" for i in range(len(docs.columns))]
    keyed = docs.select(key(docs[id_col].cast("long"), F.xxhash64(text_of(docs, text_col))), *[docs[c].alias(n) for c, n in zip(docs.columns, names)])
    # Repeated rows become one in the tasks that read them, and texts are shuffled once, for the join too.
    single = keyed.groupBy("_key").agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("d"))
    return single.join(stay, "_key", "left_semi").select(*[F.col(f"d.{n}").alias(c) for c, n in zip(docs.columns, names)])
