"""Interaction of filters: what each of five filters removes at each place of every order in which they can run.

A document is the set of filters that it fails, five bits. Documents are counted by part and mask, together with the
good and toxic ones among them; from there on an order of filters is linear algebra. The histograms of a part are the rows
of a matrix, and a product with 32-by-600 matrices of whole numbers (a column for each of 5 places in 120 orders) gives
what is kept, removed, redundant and failed uniquely. The corpus is read once, whatever the number of orders.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, persist_shared, text_of

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: The blanks that end a word, and the symbols of filter D (fixed by the contract).
BLANKS = "\t\n\x0b\x0c\r"
SYMBOLS = r"[#$%&*|]"
#: Parts whose histograms are multiplied at a time.
PARTS_AT_ONCE = 64

SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), "")


def failed_by_text(text: Column) -> Column:
    """Bits of the filters that look at the text alone: A 1, B 2, C 4, D 8."""

    def bits(t: Column) -> Column:
        counts = let(words_of(t), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))
        capitals = F.length(F.regexp_replace(t, "[^A-Z]+", ""))
        few = let(counts, lambda c: F.when(c["n"] < 50, 1).otherwise(0) + F.when(100 * c["distinct"].cast("long") < 65 * c["n"].cast("long"), 2).otherwise(0))
        return few + F.when(100 * capitals.cast("long") > 5 * F.length(t).cast("long"), 4).otherwise(0) + F.when(F.regexp_like(t, F.lit(SYMBOLS)), 8).otherwise(0)

    return let(text, bits)


def outcome_matrices() -> dict[str, np.ndarray]:
    """32-by-600 matrices: whether a document with a mask (row) is kept, removed, ... at a place of an order (column)."""
    at = [(order, i) for order in ORDERS for i in range(len(FILTERS))]
    bit = np.array([1 << FILTERS.index(order[i]) for order, i in at])
    before = np.array([sum(1 << FILTERS.index(x) for x in order[:i]) for order, i in at])
    mask = np.arange(32)[:, None]
    fails, gone = (mask & bit) != 0, (mask & before) != 0
    out = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": np.broadcast_to(mask == bit, fails.shape)}
    return {k: v.astype(np.int64) for k, v in out.items()}


def _audit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (part, histogram entries) to 600 rows for each part."""
    m = outcome_matrices()
    orders = np.repeat(np.array(ORDERS, dtype=object), len(FILTERS))
    steps = np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS))
    letter = np.array([FILTERS.index(o[s - 1]) for o, s in zip(orders, steps)])
    by_filter = (letter[:, None] == np.arange(len(FILTERS))).astype(np.int64)
    for frame in frames:
        for at in range(0, len(frame), PARTS_AT_ONCE):
            some = frame.iloc[at : at + PARTS_AT_ONCE]
            stacked = np.zeros((len(some), 3, 32), dtype=np.int64)
            for i, entries in enumerate(some["entries"]):
                for e in entries:
                    stacked[i, :, e["mask"]] = e["n"], e["good"], e["toxic"]
            all_docs, good, toxic = stacked[:, 0], stacked[:, 1], stacked[:, 2]
            removed = all_docs @ m["removed"]
            columns = {"kept": all_docs @ m["kept"], "removed": removed, "redundant": all_docs @ m["redundant"], "unique_fails": all_docs @ m["unique_fails"],
                       "good_lost": good @ m["removed"], "toxic_lost": toxic @ m["removed"], "shapley": (removed @ by_filter)[:, letter]}
            yield pd.DataFrame({"part": np.repeat(some["part"].to_numpy(), len(orders)), "filter_order": np.tile(orders, len(some)), "step": np.tile(steps, len(some))} | {k: v.ravel() for k, v in columns.items()})


def filter_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents counted by part and set of failed filters (E is bit 16)."""
    text = let(text_of(docs), lambda t: F.struct(F.unhex(F.sha2(t, 256)).alias("digest"), failed_by_text(t).cast("int").alias("fails")))
    read = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["source"].cast("string"), F.lit("")).alias("part"), text.alias("t"))
    facts = persist_shared(read.select("doc_id", "part", "t.digest", "t.fails"), "filter-facts")
    # Repeated rows fold before they are joined. A text's first row is found by digest and id at once, so the copies of
    # one text meet in many tasks.
    rows = facts.groupBy("doc_id", "digest", "part", "fails").agg(F.count(F.lit(1)).alias("n"))
    first = facts.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where(F.col("doc_id").isNotNull()).withColumn("first", F.lit(True))
    told = labels.groupBy(labels["doc_id"].alias("doc_id")).agg(*[F.max(F.when(labels[c] == 1, 1).otherwise(0)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    joined = rows.join(first, ["digest", "doc_id"], "left").join(told, "doc_id", "left")
    counted = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0))
    return joined.groupBy("part", (F.col("fails") + F.when(copy, 16).otherwise(0)).alias("mask")).agg(F.sum("n").alias("n"), counted("good").alias("good"), counted("toxic").alias("toxic"))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step: what the step's filter does to the documents of the part.

    Null texts are empty, null sources the part ''; a row that repeats is counted as often as it occurs, and none of the
    rows with a text's smallest id is a copy; a null id is smaller or larger than none, so its row is never a copy. A
    document with several rows of labels is good (toxic) if one of them says so, without labels or an id it is neither. An empty table
    gives no rows. Texts of any length are read whole; other columns of the tables aren't looked at.
    """
    entries = F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("entries")  # 32 at most
    return filter_masks(docs, labels).groupBy("part").agg(entries).mapInPandas(_audit, SCHEMA)
