"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Trees, calibrate, fit_trees
from .doc_stats import NAMES, stats_matrix
from .labelled import fold, labelled_sample

#: At most so many labelled rows of each class are learned from; their statistics alone come to the driver.
ROWS_PER_CLASS = 3000
FOLDS, HELD_OUT = 3, 1


def _stats_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = stats_matrix(b.column("text").to_pylist())
        stats = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("label"), stats], ["_id", "label", "stats"])


def fit_quality(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", rows_per_class: int = ROWS_PER_CLASS) -> Trees:
    """Trees on the statistics of a bounded sample of rows outside the held-out fold; a fifth of it calibrates."""
    allowed = fold(F.col("_id"), FOLDS) != HELD_OUT
    sample = labelled_sample(docs, labels, "quality", allowed, rows_per_class, text_col, id_col)
    rows = sorted(sample.mapInArrow(_stats_of, "_id long, label int, stats array<double>").collect())
    x = np.array([r["stats"] for r in rows], dtype=np.float64).reshape(-1, len(NAMES))
    y = np.array([r["label"] for r in rows], dtype=np.float64)
    held = np.arange(len(y)) % 5 == 4
    return calibrate(fit_trees(x[~held], y[~held]), x[held], y[held])


def score_quality(docs: DataFrame, model: Trees, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Null and empty texts are scored as empty; very long texts are described whole; repeated rows are scored alike; rows
    with a null id count as of the empty id; an empty table gives an empty result; other columns are ignored, so clashing
    names cannot arise. Without labels of both kinds the score is the smoothed share of the label.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, out = b.column("text"), np.empty(b.num_rows)
            for at in range(0, b.num_rows, 512):
                out[at : at + 512] = model.predict(stats_matrix(texts[at : at + 512].to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out)], ["doc_id", "score"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    scored = rows.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def classify_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return score_quality(docs, fit_quality(docs, labels, **options))
