"""Vector algebra over array columns, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)


def wide(x) -> Column:
    return _c(x).cast("array<double>")


def dot(a, b) -> Column:
    return total(F.zip_with(wide(a), wide(b), lambda x, y: x * y))


def product(a, b) -> Column:
    return F.zip_with(wide(a), wide(b), lambda x, y: x * y)


def add(a, b) -> Column:
    return F.zip_with(wide(a), wide(b), lambda x, y: x + y)


def scale(a, k) -> Column:
    return F.transform(wide(a), lambda x: x * k)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def distmult(h, t, m) -> Column:
    """d^-1/2 * sum(h * t * m)."""
    return dot(product(h, t), m) / F.sqrt(F.size(_c(m)).cast("double"))


def rotation_gap(h, t, m) -> Column:
    """d^-1/2 * sum((m * h - t)^2)."""
    return total(F.zip_with(product(m, h), wide(t), lambda x, y: (x - y) * (x - y))) / F.sqrt(F.size(_c(m)).cast("double"))


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


def log_sum_exp(xs) -> Column:
    top = F.array_max(wide(xs))
    return top + F.log(total(F.transform(wide(xs), lambda x: F.exp(x - top))))


def softmax(xs) -> Column:
    lse = log_sum_exp(xs)
    return F.transform(wide(xs), lambda x: F.exp(x - lse))


def cross_entropy(logits, target) -> Column:
    """-log softmax of the target (from 0)."""
    return log_sum_exp(logits) - F.element_at(wide(logits), _c(target) + 1)


def bce_with_logits(x, y) -> Column:
    x, y = _c(x), _c(y)
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
