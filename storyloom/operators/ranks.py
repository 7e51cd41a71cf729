"""Ranks over a whole table, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyloom.sources.scratch import saved


def ranked(rows: DataFrame, *order, ranges: int | None = None) -> DataFrame:
    """``rows`` with ``rank`` (from 0, in the order of the columns) and ``total``.

    Rows are dealt by ranges of the order, so many ``ranges`` or as many as Spark deals to by default, and written with
    their place in the range; a table of one count per range gives the places of the ranges. Rows that are equal in all
    columns of the order get neighbouring ranks, by their places in the input, so that ranges may part them.
    """
    told = rows.withColumn("place", F.monotonically_increasing_id())
    sort = [*order, "place"]
    placed = (told.repartitionByRange(ranges, *sort) if ranges else told.repartitionByRange(*sort)).sortWithinPartitions(*sort)
    placed = saved(placed.withColumn("place", F.monotonically_increasing_id()), "ranked")
    mask = F.lit((1 << 33) - 1)
    placed = placed.withColumn("range", F.shiftright("place", 33)).withColumn("place", F.col("place").bitwiseAND(mask))
    counts = placed.groupBy("range").agg(F.count("*").alias("n"))
    before = counts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()[0]
    return placed.join(before, "range").withColumn("rank", F.col("before") + F.col("place")).withColumn("total", F.lit(total).cast("long")).drop("range", "place", "before")
