"""Greedy packing of ordered items, as folds over arrays of lengths. A fold keeps sums and the places where groups
begin, never texts, so its state stays small."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Items of one inner fold. Appending to an array copies it, so places are gathered by blocks of items.
BLOCK = 256


def group_starts(items: Column, begins: Callable[[Column, Column, Column, Column], Column], grows: Callable[[Column, Column], Column], size: Callable[[Column], Column]) -> Column:
    """Places (from 0) at which groups begin.

    ``begins(total, first, count, item)`` tells whether an item opens a new group, given the open group's total, the size
    of its first item and its items so far; ``grows(total, item)`` is the total with the item, ``size(item)`` that of a
    group of the item alone. No items give no places.
    """
    state = lambda total, first, count, i, starts: F.struct(
        total.cast("int").alias("total"), first.cast("int").alias("first"), count.cast("int").alias("count"), i.cast("int").alias("i"), starts.alias("starts")
    )
    none, zero = F.array().cast("array<int>"), F.lit(0)

    def step(a: Column, x: Column) -> Column:
        new = (a["count"] == 0) | begins(a["total"], a["first"], a["count"], x)
        return state(
            F.when(new, size(x)).otherwise(grows(a["total"], x)), F.when(new, size(x)).otherwise(a["first"]),
            F.when(new, 1).otherwise(a["count"] + 1), a["i"] + 1, F.when(new, F.concat(a["starts"], F.array(a["i"]))).otherwise(a["starts"]),
        )

    def block(a: Column, b: Column) -> Column:
        done = F.aggregate(F.slice(items, b * BLOCK + 1, F.lit(BLOCK)), state(a["total"], a["first"], a["count"], a["i"], none), step)
        return F.transform(F.array(done), lambda d: state(d["total"], d["first"], d["count"], d["i"], F.concat(a["starts"], F.array(d["starts"]))))[0]

    count = F.ceil(F.size(items) / BLOCK).cast("int")
    blocks = F.when(count > 0, F.sequence(zero, count - 1)).otherwise(none)
    return F.flatten(F.aggregate(blocks, state(zero, zero, zero, zero, F.array().cast("array<array<int>>")), block, lambda a: a["starts"]))


def capped_starts(lengths: Column, cap: int, joint: int = 1) -> Column:
    """Groups of items joined by ``joint`` characters, each as long as possible within ``cap``; a longer item is alone."""
    return group_starts(lengths, lambda total, first, n, x: total + joint + x > cap, lambda total, x: total + joint + x, lambda x: x)


def groups(items: Column, starts: Column) -> Column:
    """The items between one start and the next, as an array of arrays."""
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array(F.size(items)))
    spans = F.filter(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda s: s["a"].isNotNull())
    return F.transform(spans, lambda s: F.slice(items, s["a"] + 1, s["b"] - s["a"]))
