"""Hyper-parameter ranges and their text form."""

from __future__ import annotations

import ast
from typing import Any

from pyspark.sql import Column, functions as F


def log_range(low: int, high: int, base: int = 10) -> Column:
    """Array of ``base`` to the powers ``low`` .. ``high - 1``."""
    return F.transform(F.sequence(F.lit(low), F.lit(high - 1)), lambda i: F.pow(F.lit(float(base)), i))


def linear_range(low: Column | float, high: Column | float, count: int) -> Column:
    """Array of ``count`` evenly spaced values from ``low`` to ``high``, both included."""
    low, high = [x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high)]
    step = (high - low) / F.lit(float(max(count - 1, 1)))
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: low + step * i)


def params_text(params: dict) -> str:
    """The text form used in result lines: ``{'n_neighbors': 12, 'weights': 'distance'}``."""
    return str(dict(sorted(params.items())))


def typed_params(params: dict[str, str]) -> dict[str, Any]:
    """Settings of one parsed result row as the values they were written from; the embedding keys are left out."""
    def value(text: str) -> Any:
        try:
            return ast.literal_eval(text)
        except (ValueError, SyntaxError):
            return text

    return {k: value(v) for k, v in params.items() if k not in ("Sentence Embedding", "Word Embedding")}


def params_map(text: Column) -> Column:
    """Parse that text form into a map; tuples such as ``(100, 50)`` stay whole."""
    bare = F.regexp_replace(text, r"[{}']", "")
    return F.str_to_map(bare, F.lit(", (?=[A-Za-z_ ]+:)"), F.lit(": "))
