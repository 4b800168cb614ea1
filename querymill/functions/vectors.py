"""Distances and scores.

Two distances (``cosine`` and ``sql2``, squared Euclidean) and two ways to read a score off a
distance: ``reference`` is ``max(0, 1 - d^2 / 2)``, ``cosine`` is ``1 - d``.
"""

import math

from pyspark.sql import Column, functions as F

METRICS = ("cosine", "sql2")
SCORES = ("reference", "cosine")


def is_vector(col: Column) -> Column:
    """Neither null, empty, all zero nor holding a number that is not finite."""
    usable = F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(usable & F.exists(col, lambda x: x != 0.0), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1.0 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def squared_l2_distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2))
    return F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)


def distance_to_score(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - F.pow(distance, 2) / 2.0)


def clamp_confidence(col: Column) -> Column:
    return F.least(F.greatest(col, F.lit(0.0)), F.lit(1.0))


def largest_distance(threshold: float, score: str) -> float:
    """The distance beyond which the score is below the threshold; infinite if none is."""
    if score == "reference":
        return math.inf if threshold <= 0 else math.sqrt(2.0 * (1.0 - threshold)) if threshold <= 1 else -1.0
    return 1.0 - threshold
