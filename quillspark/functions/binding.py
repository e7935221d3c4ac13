"""Evaluate an expression once and use it inside lambdas.

The optimizer may inline a computed column into every place that mentions it, also into
lambda bodies, where it would run per element. A value bound by ``let`` runs once per row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def once(value: Column | str) -> Column:
    """The value of a computed array column, for exploding.

    Exploding a bare column makes the optimizer infer a size filter and push it below the
    projections, where the column's whole expression is inlined and runs again.
    """
    return let(F.col(value) if isinstance(value, str) else value, lambda v: v)
