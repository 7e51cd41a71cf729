"""Exact duplicates by two passes over a Bloom filter: only rows whose hash may be repeated are dealt by their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.shared import saved, spread_join

#: A bitmap of the filter has so many bits, as Spark's bitmap functions make them; each half takes one bit of a hash.
BLOCK_BITS = 1 << 15

#: Bitmaps of the first filter, which is a table of its set cells, and at most of the second, which is broadcast: 4 KB
#: each, so 32 MB.
SPARSE_BLOCKS, FILTER_BLOCKS = 1 << 30, 1 << 13

SPACES = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without any character of [\\x20\\x09-\\x0D]; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def places(h: Column) -> tuple[Column, tuple[Column, Column]]:
    """Bitmap of a 64-bit hash in the first filter, and its two bits there."""
    half = BLOCK_BITS // 2
    return F.shiftrightunsigned(h, 34), (h.bitwiseAND(half - 1), F.shiftrightunsigned(h, 14).bitwiseAND(half - 1) + half)


def is_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, bit.bitwiseAND(7).cast("int")) == 1


def repeated_filter(hashes: DataFrame, blocks: int = FILTER_BLOCKS) -> DataFrame:
    """(block, bits): the Bloom filter of the cells that two or more of the hashes ``h`` set.

    The first filter is counted cell by cell, after counts within each task, and may be of any size, as no machine holds
    it. Its repeated cells are folded into ``blocks`` bitmaps, a power of two; folding only adds hashes that may be repeated.
    """
    block, bits = places(F.col("h"))
    cells = hashes.select(F.explode(F.array(*[block * BLOCK_BITS + b for b in bits])).alias("cell"))
    twice = cells.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1")
    folded = twice.select(F.shiftrightunsigned("cell", 15).bitwiseAND(blocks - 1).alias("block"), F.col("cell").bitwiseAND(BLOCK_BITS - 1).alias("bit"))
    return folded.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))


def judged(rows: DataFrame, blocks: int = FILTER_BLOCKS) -> DataFrame:
    """``rows`` (row, id, t) as row, id, keep_id, group_size, kept and text_sha256; see ``exact_duplicates``."""
    hashed = rows.withColumn("t0", normalised(F.col("t"))).withColumn("h", F.xxhash64("t0"))
    seen = F.broadcast(saved(repeated_filter(hashed.select("h"), blocks), "repeated"))
    block, bits = places(F.col("h"))
    probed = hashed.withColumn("block", block.bitwiseAND(blocks - 1)).join(seen, "block", "left")
    may = F.coalesce(is_set(F.col("bits"), bits[0]) & is_set(F.col("bits"), bits[1]), F.lit(False))
    keyed = probed.select("row", "id", F.length(F.coalesce("t", F.lit(""))).alias("n"), F.sha2("t0", 256).alias("key"), may.alias("may"))

    single = keyed.filter(~F.col("may")).select("row", "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("key").alias("text_sha256"))
    # Places of rows are written once, so that rows equal in all else are told apart in the same way wherever they are read.
    maybe = saved(keyed.filter("may").drop("may").withColumn("place", F.monotonically_increasing_id()), "maybe-repeated")
    order = F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("no_id"), "id", "place")
    groups = saved(maybe.groupBy("key").agg(F.count("*").alias("group_size"), F.min(order).alias("best")), "groups")
    joined = spread_join(maybe, groups, ["key"], "group_size", maybe.count())
    grouped = joined.select("row", "id", F.col("best.id").alias("keep_id"), "group_size", (F.col("place") == F.col("best.place")).alias("kept"), F.col("key").alias("text_sha256"))
    return single.unionByName(grouped)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", blocks: int = FILTER_BLOCKS) -> DataFrame:
    """One row per row of ``docs``: the id, keep_id, group_size, kept and text_sha256, of the text without whitespace.

    Texts are equal when they are identical without the characters of [\\x20\\x09-\\x0D]; null and empty texts are equal.
    Of equal texts, that of the most code points stays, then that of the smallest id, null ids last; of rows that agree
    in both, one. Every row counts, also repeated ones. Very long texts are hashed whole. Other columns are not read. An
    empty table gives an empty result.

    The first pass over the texts shuffles two numbers a row, counted within tasks before; the second looks every hash
    up in a broadcast filter of at most 4 KB a block. Rows whose hash is certainly alone go straight to the result; only
    the others are written, grouped by SHA-256 and joined with their groups, where groups of more than a thousandth of
    them stay where they are. A filter too small for its hashes costs time, never rows.
    """
    slim = docs.select(F.lit(None).cast("boolean").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return judged(slim, blocks).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256")


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", blocks: int = FILTER_BLOCKS) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, that ``exact_duplicates`` keeps."""
    whole = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return judged(whole, blocks).filter("kept").select("row.*")
