"""Repeatable randomness: every draw is an md5 of a seed and the row's own keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(seed, *keys: Column) -> Column:
    """Hex digest that stands for one random draw."""
    parts = [F.lit(str(seed))] + [k.cast("string") for k in keys]
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def draw32(seed, *keys: Column) -> Column:
    """The draw as an unsigned 32-bit integer."""
    return F.conv(F.substring(draw(seed, *keys), 1, 8), 16, 10).cast("bigint")


def coin(seed, *keys: Column) -> Column:
    return (draw32(seed, *keys) % 2).cast("int")


def randint(seed, high: Column, *keys: Column) -> Column:
    """Uniform integer in 1..high."""
    return (1 + draw32(seed, *keys) % high).cast("int")


def sample_size(seed, n: Column, *keys: Column) -> Column:
    """1..max(1, 30 % of n), and 0 for an empty list."""
    high = F.greatest(F.lit(1), F.floor(F.lit(0.3) * n).cast("int"))
    return F.when(n > 0, randint(seed, high, *keys)).otherwise(0)


def shuffled(seed, words: Column, *keys: Column) -> Column:
    """A list of distinct strings in random order."""
    tagged = F.transform(words, lambda w: F.concat(draw(seed, *keys, w), w))
    return F.transform(F.sort_array(tagged), lambda s: F.substr(s, F.lit(33)))


def sample_some(seed, words: Column, *keys: Column) -> Column:
    """Random-size random subset of a list of distinct strings."""
    k = sample_size(f"{seed}k", F.size(words), *keys)
    return F.slice(shuffled(seed, words, *keys), F.lit(1), k)
