"""What the vector searches share: whole vectors as packed rows, and the reduction of inner products to distances.

With every vector x lengthened by sqrt(M - |x|^2), M the largest |x|^2, and queries by 0,
|q - x|^2 = |q|^2 + M - 2 q.x: the largest inner product is the least distance, and the triangle
inequality holds for it. Vectors of fewer components than others count as ending in zeros.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v) of the rows whose id is not null and whose vector is not null and has finite components only."""
    v = F.col(vector_col).cast("array<double>")
    rows = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    return rows.where("id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")


def batch_arrays(b: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and the matrix of a batch (id, v), short vectors filled up with zeros."""
    ids, lists = b.column(0).to_numpy(), b.column(1)
    sizes, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
    if len(sizes) and (sizes == width).all():
        return ids, flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return ids, out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= cut)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]
