"""Similarity of vectors in array columns, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; null if the lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda total, x: total + x))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """1 minus the cosine distance; null for zero vectors."""
    both = norm(a) * norm(b)
    return F.when(both > 0, dot(a, b) / both)


def euclidean(a: Column, b: Column) -> Column:
    """1 / (1 + squared distance), a similarity from 0 to 1."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.when(F.size(a) == F.size(b), 1 / (1 + F.aggregate(squares, F.lit(0.0), lambda total, x: total + x)))
