"""Vector columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(
        F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def cosine(left: Column, right: Column) -> Column:
    """Cosine of two array columns; null when either has no length."""
    norm = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    return F.when(norm > 0, dot(left, right) / norm)


def cosine_to(vector: Column, query: Sequence[float]) -> Column:
    """Cosine of an array column to one fixed vector; null for a zero vector or another dimension.

    One Arrow batch is one matrix product, which beats a lambda per element in the JVM.
    """
    target = np.asarray(query, dtype="float64")
    length = math.sqrt(float(target @ target))

    @F.arrow_udf(T.DoubleType())
    def run(batch: pa.Array) -> pa.Array:
        out = np.full(len(batch), np.nan)
        # Arrow holds all numbers of a batch in one flat array, so no row is touched alone
        fits = pc.fill_null(pc.equal(pc.list_value_length(batch), len(target)), False)
        if length and pc.any(fits).as_py():
            flat = batch.filter(fits).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            fits = fits.to_numpy(zero_copy_only=False)
            matrix = flat.reshape(-1, len(target))
            norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix)) * length
            out[fits] = np.divide(matrix @ target, norms, out=np.full(len(norms), np.nan), where=norms > 0)
        return pa.array(out)

    return F.nanvl(run(vector), F.lit(None).cast("double"))
