"""Vector arithmetic on ARRAY columns, always in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.binding import let


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column) -> Column:
    """L2-normalised; a zero vector stays zero (norm clamped at 1e-12)."""
    return let(
        as_double(v),
        lambda d: let(F.greatest(norm(d), F.lit(1e-12)), lambda n: F.transform(d, lambda x: x / n)),
    )


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(eps))


def masked_mean(token_vectors: Column, mask: Column) -> Column:
    """Mean over the tokens whose mask is 1; an all-masked row divides by 1e-9."""
    zero = F.transform(as_double(F.get(token_vectors, F.lit(0))), lambda x: F.lit(0.0))
    pairs = F.arrays_zip(token_vectors.alias("v"), mask.alias("m"))
    summed = F.aggregate(
        pairs,
        zero,
        lambda acc, p: F.zip_with(
            acc, as_double(p["v"]), lambda x, y: x + y * p["m"].cast("double")
        ),
    )
    weight = F.greatest(total(mask.cast("array<double>")), F.lit(1e-9))
    return let(weight, lambda w: F.transform(summed, lambda x: x / w))


def log_sum_exp(v: Column) -> Column:
    """ln(sum(exp)), shifted by the maximum so that large inputs stay finite."""
    return let(
        F.array_max(as_double(v)),
        lambda top: top + F.ln(total(F.transform(as_double(v), lambda x: F.exp(x - top)))),
    )


def argmax(v: Column) -> Column:
    """Zero-based position of the first maximum."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")
