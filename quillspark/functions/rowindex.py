"""An index inside a row: lists grouped by key and joined by key, without leaving the row.

Looking a key up in a map walks the map, so a list looked up entry by entry costs the square of
its length. ``map_zip_with`` instead meets two maps by hash, all keys at once, and sorting finds
the runs of equal keys; together they join two lists of a row in n log n.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.binding import let


def sorted_runs(entries: Column, use: Callable[[Column, Column], Column]) -> Column:
    """``use(sorted, starts)`` for a list of structs whose first field is ``k``: the list in order
    and the places (from 0) where a run of equal ``k`` starts."""

    def with_starts(s: Column) -> Column:
        opens = F.transform(s, lambda e, i: F.when((i == 0) | (e["k"] != F.get(s, i - 1)["k"]), i))
        return let(F.filter(opens, lambda i: i.isNotNull()), lambda starts: use(s, starts))

    return let(F.sort_array(F.filter(entries, lambda e: e["k"].isNotNull())), with_starts)


def run_ends(s: Column, starts: Column, j: Column) -> Column:
    return F.coalesce(F.get(starts, j + 1), F.size(s))


def grouped(entries: Column) -> Column:
    """map<k, array<struct>>: a list of structs (k, …) by k, every group in order; null keys go."""

    def cut(s: Column, starts: Column) -> Column:
        return F.map_from_entries(
            F.transform(starts, lambda a, j: F.struct(F.get(s, a)["k"], F.slice(s, a + 1, run_ends(s, starts, j) - a)))
        )

    return sorted_runs(entries, cut)


def greatest(entries: Column) -> Column:
    """map<k, struct>: the greatest entry of every k."""

    def cut(s: Column, starts: Column) -> Column:
        return F.map_from_entries(
            F.transform(starts, lambda a, j: F.struct(F.get(s, a)["k"], F.get(s, run_ends(s, starts, j) - 1)))
        )

    return sorted_runs(entries, cut)


def met(left: Column, right: Column, use: Callable[[Column, Column], Column]) -> Column:
    """``use(left value, right value)`` for every key of two maps, null where one lacks it, as one list."""
    return F.map_values(F.map_zip_with(left, right, lambda k, a, b: use(a, b)))
