"""Vector arithmetic as column expressions over ``ARRAY<DOUBLE>`` columns of any width.

Two vectors of unequal width are an error, never a silent truncation or a NULL.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

# Up to this width, expressions are written out element by element and stay in generated JVM code.
# Measured for the gradient: at 64 wide the generated method is no longer optimised (3.9 s an
# iteration, against 0.7 s for the Arrow form).
UNROLL_WIDTH = 32


def _same_width(a: Column, b: Column, result: Column) -> Column:
    message = F.concat(
        F.lit("vectors of unequal width: "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string")
    )
    return F.when(F.size(a) == F.size(b), result).otherwise(F.raise_error(message))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v)


def dot(a: Column, b: Column) -> Column:
    return _same_width(a, b, _sum(F.zip_with(a, b, lambda u, v: u * v)))


def scale(a: Column, factor: Column) -> Column:
    return F.transform(a, lambda v: v * factor)


def add(a: Column, b: Column) -> Column:
    return _same_width(a, b, F.zip_with(a, b, lambda u, v: u + v))


def subtract(a: Column, b: Column) -> Column:
    return _same_width(a, b, F.zip_with(a, b, lambda u, v: u - v))


def squared_distance(a: Column, b: Column) -> Column:
    return _same_width(a, b, _sum(F.zip_with(a, b, lambda u, v: (u - v) * (u - v))))


def constant(value: Column, width: int) -> Column:
    return F.array_repeat(value.cast("double"), width)


def center_distances(x: Column, centers: Column) -> Column:
    """Squared distance of ``x`` to each vector of the ``ARRAY<ARRAY<DOUBLE>>`` column ``centers``."""
    return F.transform(centers, lambda c: squared_distance(x, c))


def nearest(distances: Column) -> Column:
    """Index of the smallest distance; the lowest index wins a tie, and 0 if none is a number."""
    return (F.array_position(distances, F.array_min(distances)) - 1).cast("int")


def checked(x: Column, width: int) -> Column:
    """``x`` as doubles, or an error if it does not hold exactly ``width`` values, none of them NULL."""
    x = x.cast("array<double>")
    if width <= UNROLL_WIDTH:
        # The sum is NULL if one of the values is.
        complete = reduce(lambda a, b: a + b, [F.get(x, F.lit(i)) for i in range(width)]).isNotNull()
    else:
        complete = ~F.exists(x, lambda v: v.isNull())
    return F.when(x.isNotNull() & (F.size(x) == width) & complete, x).otherwise(F.raise_error(F.lit(f"expected a vector of {width} numbers")))


def unrolled_dot(x: str, w: str, width: int) -> str:
    """SQL text of the dot product of known small width: one flat expression, compiled into the loop body.

    Much faster than ``dot`` up to a few dozen values; beyond that the generated method becomes
    too long for the JVM to optimise.
    """
    return " + ".join(f"get({x}, {i}) * get({w}, {i})" for i in range(width))


def array_of_sums(terms: Sequence[str]) -> str:
    """SQL text of one array holding the sum of each term."""
    return f"array({', '.join(f'sum({t})' for t in terms)})"


def as_text(x: Column) -> Column:
    return F.concat_ws(" ", x.cast("array<string>"))
