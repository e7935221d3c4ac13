"""Reduce token gradients, given as arrays, to one score per token."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.binding import let

from quillspark.functions.vectors import dot


def mean_attribution(grads: Column, embeds: Column) -> Column:
    """Mean of gradient x embedding over the dimensions, per token."""
    return F.zip_with(grads, embeds, lambda g, e: dot(g, e) / F.size(g))


def mean_gradient(grads: Column) -> Column:
    """Mean of an integrated gradient over the dimensions, per token."""
    return F.transform(
        grads, lambda g: F.aggregate(g, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(g)
    )


def signed_attribution(grads: Column, embeds: Column) -> Column:
    """Sum of gradient x embedding per token, divided by the L1 norm over tokens."""
    sums = F.zip_with(grads, embeds, lambda g, e: dot(g, e))
    size = lambda s: F.aggregate(s, F.lit(0.0), lambda a, x: a + F.abs(x))
    return let(sums, lambda s: let(size(s), lambda l1: F.transform(s, lambda x: x / l1)))


def masked(xs: Column, mask: Column) -> Column:
    """Drop the entries whose mask is 0."""
    kept = F.filter(F.arrays_zip(xs.alias("x"), mask.alias("m")), lambda p: p["m"] == 1)
    return F.transform(kept, lambda p: p["x"])


def second_start(tokens: Column, mark: str = "[CLS]") -> Column:
    """0-based position of the second mark."""
    at = F.filter(
        F.transform(tokens, lambda t, i: F.when(t == mark, i)), lambda i: i.isNotNull()
    )
    return F.get(at, F.lit(1))


def split_pair(xs: Column, tokens: Column) -> tuple[Column, Column]:
    """The parts of xs before and from the second mark on."""
    at = second_start(tokens)
    return F.slice(xs, F.lit(1), at), F.slice(xs, at + 1, F.size(xs) - at)
