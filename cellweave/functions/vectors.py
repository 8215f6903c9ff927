"""Vector and score arithmetic as Column functions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")))


def l2_normalize(v: Column | str) -> Column:
    """Of length 1; a zero vector stays zero."""
    v = _c(v)
    size = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / size)


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(1e-12))


def softmax(v: Column | str) -> Column:
    v = _c(v)
    e = F.transform(v, lambda x: F.exp(x - F.array_max(v)))
    return F.transform(e, lambda x: x / _sum(e))


def sigmoid(x: Column | str) -> Column:
    return 1 / (1 + F.exp(-_c(x)))


def mix(a: Column | str, b: Column | str, weight: float) -> Column:
    """(1 - weight) a + weight b, element by element."""
    return F.zip_with(_c(a), _c(b), lambda x, y: (1 - weight) * x + weight * y)
