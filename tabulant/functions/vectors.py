"""Vector arithmetic on array<double> columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A lambda body is evaluated for every element and has no common
    subexpression elimination, so row constants are bound outside it.
    """
    return F.transform(F.array(value), body)[0]


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def l2_normalize(v: Column) -> Column:
    """v divided by its Euclidean length (at least 1e-12)."""
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return bind(norm, lambda n: F.transform(v, lambda x: x / n))


def softmax(z: Column) -> Column:
    """Softmax of one row of logits, shifted by its maximum."""
    shifted = bind(F.array_max(z), lambda m: F.transform(z, lambda x: F.exp(x - m)))
    return bind(shifted, normalize_sum)


def normalize_sum(v: Column) -> Column:
    """Non-negative scores scaled to sum to one; all-zero rows become uniform."""
    return bind(
        total(v),
        lambda s: F.transform(v, lambda x: F.when(s > 0, x / s).otherwise(1.0 / F.size(v))),
    )


def argmax_label(p: Column, levels) -> Column:
    """Name of the largest score; the first level wins a tie."""
    names = F.array(*[F.lit(level) for level in levels])
    return F.element_at(names, F.array_position(p, F.array_max(p)).cast("int"))
