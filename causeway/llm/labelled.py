"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, allowed: Column, per_class: int | tuple[int, int], text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """_id, text and label of at most ``per_class`` rows of each label, in the order of a hash of the id.

    An id that many rows share gives one row, with the text whose hash is least, so the bound holds for rows too.
    ``per_class`` may be a pair, for labels 0 and 1. ``allowed`` is a condition on ``_id``. Rows without id, label or
    text are left out, as are labels but 0 and 1.
    """
    chosen = None
    for label in (0, 1):
        rows = labels.select(labels[id_col].cast("long").alias("_id"), labels[label_col].cast("int").alias("label"))
        rows = rows.where(F.col("_id").isNotNull() & (F.col("label") == label) & allowed).distinct()
        most = per_class if isinstance(per_class, int) else per_class[label]
        rows = rows.orderBy(F.xxhash64("_id"), "_id").limit(most)
        chosen = rows if chosen is None else chosen.union(rows)
    # As many ids as the parameter allows.
    texts = docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].cast("string").alias("text")).where("text is not null")
    first = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))
    return texts.join(F.broadcast(chosen), "_id").groupBy("_id", "label").agg(first.alias("first")).select("_id", "first.text", "label")
