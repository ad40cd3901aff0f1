"""Cosine similarity over ``array<float>`` columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cosine(a, b) -> Column:
    """Cosine similarity of two array columns, in double precision.

    NULL for a NULL or zero vector, for unequal lengths and for NaN components, so that such rows
    drop out of any threshold filter (``NaN > x`` is true in Spark).
    """
    x, y = _col(a).cast("array<double>"), _col(b).cast("array<double>")
    zero = F.lit(0.0)
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), zero, lambda s, v: s + v)
    norm2 = lambda v: F.aggregate(v, zero, lambda s, p: s + p * p)
    sim = F.try_divide(dot, F.sqrt(norm2(x)) * F.sqrt(norm2(y)))
    return F.when((F.size(x) == F.size(y)) & ~F.isnan(sim), sim)


def matrix_of(vectors: pa.Array) -> np.ndarray:
    """Rows of a non-null Arrow list column as one float64 matrix (all of equal length)."""
    sizes = pc.unique(pc.list_value_length(vectors))
    if len(sizes) > 1:
        raise ValueError("vectors of different widths have no common matrix")
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64, copy=False).reshape(len(vectors), -1)


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; zero rows become NaN and never pass a comparison."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def similarity_to(c, query, once: bool = False) -> Column:
    """Cosine similarity to one fixed query vector.

    One matrix-vector product per Arrow batch: about twice as fast as the higher-order-function
    form on 64 dimensions, and the gap widens with the dimension. Rows whose vector is NULL, of
    another length, zero or NaN give NULL. ``once`` keeps the optimiser from repeating the score in a filter.
    """
    q = np.asarray(query, dtype=np.float64)
    length = np.sqrt(q @ q)
    q = q / length if length > 0 else np.full_like(q, np.nan)
    width = len(q)

    @F.arrow_udf("double")
    def score(v: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(v), -1).to_numpy(zero_copy_only=False)
        usable = sizes == width
        out = np.full(len(v), np.nan)
        if usable.any():
            rows = v if usable.all() else v.filter(pa.array(usable))
            out[usable] = unit_rows(matrix_of(rows)) @ q
        return pa.array(out, type=pa.float64(), mask=np.isnan(out))

    return (score.asNondeterministic() if once else score)(_col(c))
