"""Vector arithmetic on ``array`` columns.

Sums over a known dimension are written out element by element: that keeps
them in generated code, which higher-order functions would leave. They are
given as SQL text, as hundreds of single column objects are slow to build.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _element(vec: str, i: int) -> str:
    return f"cast(get({vec}, {i}) as double)"


def _dot(a: str, b: str | list[float], dim: int) -> str:
    other = [_element(b, i) if isinstance(b, str) else f"{float(b[i])!r}D" for i in range(dim)]
    return "(" + " + ".join(f"{_element(a, i)} * {other[i]}" for i in range(dim)) + ")"


def cosine(a: str, b: str | list[float], dim: int) -> Column:
    """Cosine of column ``a`` with column ``b`` or with given numbers."""
    square = _dot(b, b, dim) if isinstance(b, str) else f"{sum(float(x) ** 2 for x in b)!r}D"
    return F.expr(f"{_dot(a, b, dim)} / (sqrt({_dot(a, a, dim)}) * sqrt({square}))")


def dot(a: Column, b: Column) -> Column:
    """Sum of products of two arrays, first element first, as ``cosine`` adds them; null where an element is missing."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def element_sums(vec: str, dim: int) -> list[Column]:
    """One sum aggregate ``_s<i>`` per element; nulls (words without a vector) add nothing."""
    return [F.expr(f"coalesce(sum({_element(vec, i)}), 0D) as _s{i}") for i in range(dim)]


def pad(vec: Column, length: int) -> Column:
    """Fill up with zeros to ``length``."""
    return F.concat(vec, F.array_repeat(F.lit(0.0), F.lit(length) - F.size(vec)))


def normalise(weights: Column) -> Column:
    """Divide by the sum."""
    total = F.aggregate(weights, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(weights, lambda x: x / total)


def rounded(value: Column, digits: int = 6) -> Column:
    """Round, with -0.0 turned into 0.0."""
    return F.round(value, digits) + F.lit(0.0)
