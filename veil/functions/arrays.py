"""Array math as Catalyst higher-order functions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Elements are widened to double before any product: float32 arrays would
# otherwise multiply in single precision.
def asum(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def sqnorm(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0).cast("double"),
                       lambda acc, x: acc + x.cast("double") * x.cast("double"))


def l2norm(a) -> Column:
    return F.sqrt(sqnorm(a))


def scale(a, s) -> Column:
    s = _c(s) if not isinstance(s, (int, float)) else F.lit(float(s))
    return F.transform(_c(a), lambda x: x * s)


def add(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def sub(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def to_double(a) -> Column:
    return F.transform(_c(a), lambda x: x.cast("double"))


def cosine(a, b) -> Column:
    return dot(a, b) / (l2norm(a) * l2norm(b))


def log_softmax(a) -> Column:
    """Shifted by the maximum so exp never overflows."""
    a = _c(a)
    m = F.array_max(a)
    lse = m + F.log(F.aggregate(a, F.lit(0.0).cast("double"), lambda acc, x: acc + F.exp(x - m)))
    return F.transform(a, lambda x: x - lse)


def softmax(a) -> Column:
    return F.transform(log_softmax(a), lambda x: F.exp(x))


def argmax(a) -> Column:
    """0-based position of the first maximum."""
    return F.array_position(_c(a), F.array_max(_c(a))) - 1
