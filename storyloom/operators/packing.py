"""Greedy packing of ordered texts up to a length, for runs of any number of entries.

What a range of items makes of the open group it begins with is a function of that group's length alone, so it is a small
array; functions of neighbouring ranges are composed by doubling. Each range then knows the length it really begins with,
and finds its groups by itself. All this is done over lengths. Texts meet the places where groups begin at the end, and are
dealt once for it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from storyloom.operators.scans import running
from storyloom.sources.scratch import saved


def steps(n: np.ndarray, hard: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """For each item, where the next group begins if one begins there; and, for each length of a group that is open
    before the first item (cap + 1: full, or none), where the first group begins."""
    upto = np.cumsum(n + 1)
    before = upto - (n + 1)
    size = len(n)
    # The first item at or after each that must begin a group.
    forced = np.minimum.accumulate(np.where(hard, np.arange(size), size)[::-1])[::-1]
    after = np.minimum(np.searchsorted(upto, before + cap + 1, "right"), np.append(forced[1:], size))
    following = np.maximum(after, np.arange(size) + 1)
    first = np.minimum(np.searchsorted(upto, cap - np.arange(cap + 2), "right"), forced[0] if size else 0)
    return following, first


def effect(n: np.ndarray, hard: np.ndarray, cap: int) -> np.ndarray:
    """The length of the group that is open after the items, for each length of the one open before them."""
    following, first = steps(n, hard, cap)
    upto, size = np.cumsum(n + 1), len(n)
    end = np.minimum(upto[-1] - (upto - n), cap + 1)
    out, nxt = end.tolist(), following.tolist()
    for i in range(size - 1, -1, -1):
        if nxt[i] < size:
            out[i] = out[nxt[i]]
    opened = np.minimum(np.arange(cap + 2) + upto[-1], cap + 1)
    return np.where(first < size, np.array(out)[np.minimum(first, size - 1)], opened)


def starts(n: np.ndarray, hard: np.ndarray, cap: int, opened: int) -> np.ndarray:
    following, first = steps(n, hard, cap)
    flags, i, nxt = np.zeros(len(n), bool), int(first[opened]), following.tolist()
    while i < len(n):
        flags[i] = True
        i = nxt[i]
    return flags


def entered(effects: DataFrame, cap: int) -> DataFrame:
    """(range, opened): the length of the group that is open where each range begins. ``effects`` (range, f) are composed
    by doubling: after k rounds, f of a row is that of up to 2^k ranges that end with its own."""
    effects = saved(effects, "effects")
    # Ranges without rows leave no gaps; only their numbers are in one task.
    t = saved(effects.join(effects.select("range").withColumn("i", F.row_number().over(Window.orderBy("range"))), "range"), "effects")
    n, width = t.count(), 1
    while width < n:
        back = t.select((F.col("i") + width).alias("i"), F.col("f").alias("g"))
        composed = F.when(F.col("g").isNotNull(), F.transform("g", lambda x: F.get("f", x))).otherwise(F.col("f"))
        t = saved(t.join(back, "i", "left").select("range", "i", composed.alias("f")), "effects")
        width *= 2
    ends = t.select((F.col("i") + 1).alias("i"), F.get("f", F.lit(cap + 1)).alias("opened"))
    return t.select("range", "i").join(ends, "i", "left").select("range", F.coalesce("opened", F.lit(cap + 1)).alias("opened"))


def begun(lengths: DataFrame, cap: int) -> DataFrame:
    """(range, place, book_id) of the entries that begin groups, of ``lengths`` (range, place, book_id, n, hard, alone),
    without those that are ``alone``."""
    slim = saved(lengths, "lengths")
    own = [slim.schema[c] for c in ("range", "place", "book_id")]

    def column(items: pa.Table, name: str) -> np.ndarray:
        return items[name].to_numpy()

    def effect_of(items: pa.Table) -> pa.Table:
        items = items.sort_by("place")
        f = effect(column(items, "n"), column(items, "hard").astype(bool), cap)
        return pa.table({"range": items["range"][:1], "f": pa.array([f.tolist()], pa.list_(pa.int32()))})

    def starts_of(items: pa.Table) -> pa.Table:
        items = items.sort_by("place")
        flags = starts(column(items, "n"), column(items, "hard").astype(bool), cap, int(column(items, "opened")[0]))
        return items.select(["range", "place", "book_id"]).filter(pa.array(flags & ~column(items, "alone").astype(bool)))

    known = entered(slim.select("range", "place", "n", "hard").groupBy("range").applyInArrow(effect_of, "range long, f array<int>"), cap)
    return saved(slim.join(F.broadcast(known), "range").groupBy("range").applyInArrow(starts_of, T.StructType(own)), "starts")


def packed(placed: DataFrame, hard: Callable[[DataFrame], DataFrame], cap: int, numbered: bool = False, alone: Column | None = None) -> DataFrame:
    """Groups of neighbouring entries of at most ``cap`` characters with single spaces between texts, none across a
    ``hard`` entry, which begins a group. ``placed`` comes from ``scans.dealt`` by book_id first and has lengths ``n``;
    ``hard`` adds that column to the rows without their texts. Gives book_id, pos of the first entry, n_entries, speaker,
    instruct and text, and if ``numbered`` the ``id`` of each group in its book.

    ``alone`` tells, by an entry itself, that it and the one after it are ``hard``. Such an entry is a group as it is, so
    its text is not dealt again. Not with ``numbered``, as a number comes from all groups before.
    """
    if numbered and alone is not None:
        raise ValueError("groups are numbered only if no entry is told to be alone")
    told = hard(placed.drop("text"))
    apart = F.lit(False) if alone is None else F.coalesce(alone, F.lit(False))
    first = begun(told.select("range", "place", "book_id", F.col("n").cast("long").alias("n"), F.coalesce("hard", F.lit(True)).alias("hard"), apart.alias("alone")), cap)
    one = F.lit(1).cast("long")
    first = running(first, ["book_id"], one, "id") if numbered else first.withColumn("id", one)
    # Entries before the first begin of their range belong to the last range before that has one.
    ends = placed.select("range").distinct().join(first.groupBy("range").agg(F.min("place").alias("from")), "range", "left")
    earlier = F.last(F.when(F.col("from").isNotNull(), F.col("range")), True).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    homes = F.broadcast(ends.select("range", "from", earlier.alias("earlier")))
    e = F.struct("place", "book_id", "pos", "text", "speaker", "instruct")
    home = F.when(F.col("place") >= F.col("from"), F.col("range")).otherwise(F.col("earlier"))
    rows = placed.filter(~apart).join(homes, "range").select(home.alias("home"), "place", F.lit(1).alias("kind"), e.alias("e"))
    marks = first.select(F.col("range").alias("home"), "place", F.lit(0).alias("kind"), F.struct("place", "id").alias("g"))
    upto = Window.partitionBy("home").orderBy("place", "kind").rowsBetween(Window.unboundedPreceding, 0)
    t = rows.unionByName(marks, allowMissingColumns=True).withColumn("g", F.last("g", True).over(upto)).filter("kind = 1")
    g = t.groupBy("home", "g").agg(F.array_sort(F.collect_list("e")).alias("es"))
    first = F.col("es")[0]
    groups = g.select(
        first["book_id"].alias("book_id"), first["pos"].alias("pos"), F.size("es").alias("n_entries"), first["speaker"].alias("speaker"),
        first["instruct"].alias("instruct"), F.array_join(F.transform("es", lambda x: x["text"]), " ").alias("text"),
        *([(F.col("g.id") - 1).alias("id")] if numbered else []),
    )
    if alone is None:
        return groups
    return groups.unionByName(placed.filter(apart).select("book_id", "pos", F.lit(1).alias("n_entries"), "speaker", "instruct", "text"))
