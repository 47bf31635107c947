"""Arrow vector columns as matrices, shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """True for vectors that are not null and hold neither null nor non-finite components."""
    column = F.col(vector)
    finite = F.forall(column, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))  # NaN sorts above all
    return column.isNotNull() & finite


def widest(vectors: DataFrame, vector: str) -> int:
    """Components of the longest vector; shorter ones count as followed by zeros."""
    return vectors.agg(F.max(F.size(vector))).first()[0] or 0


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Usable vectors as rows of doubles, followed by zeros up to the width."""
    flat = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def integers(values: np.ndarray, scale: int, limit: int) -> np.ndarray:
    """floor(scale * x) as doubles, saturated at +-limit."""
    return np.clip(np.floor(values * scale), -limit, limit)
