"""Vectors as whole numbers, so that distances and products are exact and sums don't depend on their order."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def largest_component(width: int) -> int:
    """Components so large keep squared distances and products of ``width`` numbers within 2**60."""
    return math.isqrt(2**60 // max(width, 1)) // 2


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int, width: int | None = None) -> DataFrame:
    """id, v array<int>: floor(scale * x) of each component, as double.

    Rows whose vector is null, has null or non-finite components or (given ``width``) another number of them are left out.
    A component beyond ``largest_component`` of the width (of 64, if none is given) counts as that, for products to fit in 64 bits.
    """
    vec = df[vector_col].cast("array<double>")
    most = float(largest_component(width or 64))
    finite = F.forall(vec, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))  # NaN is larger than infinity
    fits = vec.isNotNull() & finite if width is None else vec.isNotNull() & (F.size(vec) == width) & finite

    def whole(x: Column) -> Column:
        return F.greatest(F.least(F.floor(F.greatest(F.least(x * scale, F.lit(most)), F.lit(-most))), F.lit(int(most))), F.lit(-int(most))).cast("int")

    return df.where(fits).select(df[id_col].alias("id"), F.transform(vec, whole).alias("v"))


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    """Rows of equal width as int64."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows, -1)


def lists(values: np.ndarray) -> pa.ListArray:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.ravel()))
