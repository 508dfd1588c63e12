"""Column and SQL functions over vectors stored as arrays."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from .text import _col


def dot_product(left: Column | str, right: Column | str) -> Column:
    """Inner product in double precision; NULL when either vector is NULL or the lengths differ."""
    products = F.zip_with(_col(left), _col(right), lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, value: total + value)


def l2_norm(vector: Column | str) -> Column:
    total = F.aggregate(
        _col(vector), F.lit(0.0), lambda acc, value: acc + value.cast("double") * value.cast("double")
    )
    return F.sqrt(total)


def _not_finite(number: Column) -> Column:
    return F.isnan(number) | (number == float("inf"))


def cosine_distance(left: Column | str, right: Column | str) -> Column:
    """1 - cosine similarity, within [0, 2]. NULL vector: NULL. Different lengths: an error.

    NaN where a vector has no direction: all zeros, or with an element that is NaN or infinite.
    """
    left, right = _col(left), _col(right)
    # One-element array: the three sums are computed once and used by name.
    sums = F.array(F.struct(dot_product(left, right).alias("dot"), (l2_norm(left) * l2_norm(right)).alias("norms")))
    distance = F.transform(
        sums,
        lambda s: F.when((s["norms"] == 0) | _not_finite(s["norms"]), F.lit(float("nan"))).otherwise(
            F.least(F.greatest(1 - s["dot"] / s["norms"], F.lit(0.0)), F.lit(2.0))
        ),
    )
    mismatch = F.raise_error(
        F.format_string("different vector dimensions %d and %d", F.size(left), F.size(right))
    ).cast("double")
    return (
        F.when(left.isNull() | right.isNull(), F.lit(None).cast("double"))
        .when(F.size(left) != F.size(right), mismatch)
        .otherwise(F.get(distance, F.lit(0)))
    )


def vector_literal(values: Sequence[float]) -> Column:
    """A Python vector as an ``ARRAY<DOUBLE>`` literal."""
    return F.array(*[F.lit(float(value)) for value in values])


def _distances(left: pa.Array, right: pa.Array) -> pa.Array:
    """:func:`cosine_distance` of two list columns, a whole batch at a time."""
    missing = pc.or_(left.is_null(), right.is_null())
    here = pc.invert(missing)
    left, right = left.filter(here), right.filter(here)
    lengths, others = np.asarray(left.value_lengths()), np.asarray(right.value_lengths())
    if (lengths != others).any():
        first = int(np.flatnonzero(lengths != others)[0])
        raise ValueError(f"different vector dimensions {lengths[first]} and {others[first]}")
    found = np.full(len(missing), np.nan)
    values = np.empty(len(lengths))
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        a, b = (np.asarray(side.take(pa.array(rows)).flatten(), dtype=np.float64).reshape(len(rows), length) for side in (left, right))
        with np.errstate(all="ignore"):
            norms = np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b))
            distance = np.clip(1 - np.einsum("ij,ij->i", a, b) / norms, 0.0, 2.0)
        values[rows] = np.where((norms == 0) | ~np.isfinite(norms), np.nan, distance)
    found[np.asarray(here)] = values
    return pa.array(found, mask=np.asarray(missing))


def register_functions(spark: SparkSession) -> None:
    """Make ``cosine_distance(a, b)`` known to SQL in this session.

    It takes whole batches of vectors to the Python workers as Arrow data and computes them there as matrices, instead of
    walking through the elements of every array; it may stand anywhere in a statement, ORDER BY included.
    """
    ship_package(spark)
    spark.udf.register("cosine_distance", F.arrow_udf(_distances, "double"))
