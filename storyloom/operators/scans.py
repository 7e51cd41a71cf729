"""Running sums and earlier rows over tables of any shape, also where one key has most of the rows.

A table is dealt by ranges of its order and written; work within a range is a window, and what crosses from range to range
is a small table with a row for each key of each range. So no task holds more than a range, however long a book is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyloom.sources.scratch import saved

#: Rows of a range, about.
RANGE_ROWS = 1 << 20


def dealt(rows: DataFrame, *order: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with ``place``, which grows with the order, and ``range``. Rows that are equal in the whole order are dealt
    by their place in the input, so that many of them are several ranges."""
    n = rows.count()
    whole = rows.withColumn("tie", F.monotonically_increasing_id())
    sort = [*order, "tie"]
    parted = whole.repartitionByRange(max(1, -(-n // range_rows)), *sort).sortWithinPartitions(*sort).drop("tie")
    placed = saved(parted.withColumn("place", F.monotonically_increasing_id()), "dealt")
    return placed.withColumn("range", F.shiftright("place", 33))


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join in which null keys are equal; the columns of ``keys`` come from the left."""
    other = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return left.join(other, same, how).drop(*[f"_{k}" for k in keys])


def running(placed: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """The sum of ``value`` over the rows of the same keys up to each row."""
    t = placed.withColumn("_v", value)
    own = ["range", *keys]
    sums = t.groupBy(*own).agg(F.sum("_v").alias("_s"))
    before = sums.withColumn("_b", F.sum("_s").over(Window.partitionBy(*keys).orderBy("range")) - F.col("_s")).drop("_s")
    here = F.sum("_v").over(Window.partitionBy(*own).orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return joined(t.withColumn("_h", here), before, own).withColumn(name, F.col("_h") + F.col("_b")).drop("_v", "_h", "_b")


def earlier(placed: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """The ``value`` of the row before, of the same keys, as the struct ``name`` with the field v; null for the first."""
    t = placed.withColumn("_v", F.struct(value.alias("v")))
    own = ["range", *keys]
    ends = t.groupBy(*own).agg(F.max_by("_v", "place").alias("_e"))
    before = ends.withColumn("_b", F.lag("_e").over(Window.partitionBy(*keys).orderBy("range"))).drop("_e")
    here = F.lag("_v").over(Window.partitionBy(*own).orderBy("place"))
    return joined(t.withColumn("_h", here), before, own).withColumn(name, F.coalesce("_h", "_b")).drop("_v", "_h", "_b")


def preceding(placed: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """As ``earlier``, for rows that are dealt by ``key`` first: the row before in the whole order is that of the key, or
    the key has none. So one row crosses from each range to the next, and rows are dealt once, by range."""
    t = placed.withColumn("_v", F.struct(F.col(key).alias("k"), value.alias("v")))
    ends = t.groupBy("range").agg(F.max_by("_v", "place").alias("_e"))
    # Only one row of each range is in one task.
    before = ends.select("range", F.lag("_e").over(Window.orderBy("range")).alias("_b"))
    here = F.lag("_v").over(Window.partitionBy("range").orderBy("place"))
    found = t.withColumn("_h", here).join(before, "range").withColumn("_p", F.coalesce("_h", "_b"))
    same = F.col("_p").isNotNull() & F.col("_p.k").eqNullSafe(F.col(key))
    return found.withColumn(name, F.when(same, F.struct(F.col("_p.v").alias("v")))).drop("_v", "_h", "_b", "_p")
