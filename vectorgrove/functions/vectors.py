"""Vector arithmetic as Catalyst expressions over ``array<float|double>``.

All sums are accumulated in double precision.  A null vector, or a null
component, makes the result null.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)),
        F.lit(0.0),
        lambda s, x: s + x,
    )


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, not clamped; null where a norm is zero."""
    n = norm(a) * norm(b)
    return F.when(n != 0, dot(a, b) / n)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine(a, b)


def normalize(a: Column) -> Column:
    n = norm(a)
    return F.when(n != 0, F.transform(as_double(a), lambda x: x / n))


def is_valid(v: Column, dims: int) -> Column:
    """Of the right dimension and finite throughout."""
    return F.coalesce(
        (F.size(v) == dims)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))),
        F.lit(False),
    )


def assert_valid(v: Column, dims: int, nonzero: bool = False) -> Column:
    """The vector itself; the job fails on one of wrong dimension, not finite, or (nonzero) zero."""
    ok = is_valid(v, dims)
    if nonzero:
        ok = ok & F.exists(v, lambda x: x != 0)
    return F.when(ok, v).otherwise(F.raise_error(F.lit("invalid embedding")).cast("array<float>"))
