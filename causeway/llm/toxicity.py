"""Toxicity: a bidirectional GRU with attention pooling scores all overlapping windows of every whole text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gru import Network, fit, platt
from .labelled import fold, labelled_sample

#: The most labelled rows of each class that are learned from; their whole texts come to the driver.
ROWS_PER_CLASS = 900
#: The most labelled rows, clean and toxic, that calibrate the scores: near the proportions of the corpus, never trained
#: on, and scored on the executors.
CALIBRATION_ROWS = (4000, 500)
FOLDS, HELD_OUT = 5, 0


def fit_toxicity(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", rows_per_class: int = ROWS_PER_CLASS) -> Network:
    """Learns from bounded samples of labelled rows outside the held-out fold, of four fifths of the ids, and calibrates
    on the last fifth. Texts are learned from whole. An id of many rows gives one row; rows without id, text or label
    are left out; without labels of both kinds nothing is predicted toxic.
    """
    allowed, apart = fold(F.col("_id"), FOLDS) != HELD_OUT, F.pmod(F.xxhash64(F.lit(5), "_id"), F.lit(5)) == 0
    rows = sorted(labelled_sample(docs, labels, "toxic", allowed & ~apart, rows_per_class, text_col, id_col).collect())
    rows = [rows[i] for i in np.random.default_rng(1).permutation(len(rows))]
    model = fit([r["text"] for r in rows], np.array([r["label"] for r in rows], dtype=np.float64))
    return _calibrate(model, labelled_sample(docs, labels, "toxic", allowed & apart, CALIBRATION_ROWS, text_col, id_col))


def _calibrate(model: Network, sample: DataFrame) -> Network:
    """Calibrate on rows that weren't trained on, scored where they are."""
    model.forget()

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = np.concatenate([model.text_logits(b.column("text")[at : at + 256].to_pylist()) for at in range(0, max(b.num_rows, 1), 256)])
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("label"), pa.array(z.astype(np.float64))], ["_id", "label", "logit"])

    rows = sorted(sample.mapInArrow(logits, "_id long, label int, logit double").collect())
    platt(model, np.array([r["logit"] for r in rows]), np.array([r["label"] for r in rows], dtype=np.float64))
    return model


def score_toxicity(docs: DataFrame, model: Network, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    A text's score is that of its most toxic window. Null and empty texts, and others without words, are scored as one
    window of padding; very long texts are scored whole, some windows at a time; repeated rows are scored alike; rows
    with a null id count as of the empty id; an empty table gives an empty result; other columns are ignored, so
    clashing names cannot arise.
    """
    model.forget()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, out = b.column("text"), np.empty(b.num_rows)
            for at in range(0, b.num_rows, 256):
                out[at : at + 256] = model.scores(model.text_logits(texts[at : at + 256].to_pylist()).astype(np.float64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out)], ["doc_id", "score"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    scored = rows.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def classify_toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return score_toxicity(docs, fit_toxicity(docs, labels, **options))


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with their columns, in one pass over the texts.

    Rows are judged as in ``score_toxicity``, one by one, repeated ones and those with a null id too; columns of any name
    pass through; an empty table gives an empty result, and without labels of both kinds all rows stay.
    """
    model = fit_toxicity(docs, labels, text_col, id_col)
    model.forget()

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text_col).cast(pa.string())
            keep = [model.scores(model.text_logits(texts[at : at + 256].to_pylist())) < 0.5 for at in range(0, b.num_rows, 256)]
            if keep:
                yield b.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(clean, docs.schema)
