"""Distances of numeric arrays. Arrays of different length raise an error."""

from pyspark.sql import functions as F


def _checked(a, b, value):
    return F.when(F.size(a) == F.size(b), value).otherwise(
        F.raise_error(F.lit("Vector length mismatch")).cast("double")
    )


def _sum(values):
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def as_doubles(vector):
    return vector.cast("array<double>")


def l2_distance(a, b):
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return _checked(a, b, F.sqrt(_sum(squares)))


def l1_distance(a, b):
    return _checked(a, b, _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y))))


def cosine_similarity(a, b):
    """0 when a vector has no length."""
    norm = lambda v: F.sqrt(_sum(F.transform(v, lambda x: x * x)))
    scale = norm(a) * norm(b)
    dot = _sum(F.zip_with(a, b, lambda x, y: x * y))
    return _checked(a, b, F.when(scale == 0, F.lit(0.0)).otherwise(dot / scale))


def cosine_distance(a, b):
    return 1 - cosine_similarity(a, b)
