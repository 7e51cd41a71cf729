"""Sharding along a Hilbert curve over quantised metadata, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.operators.ranks import ranked

#: Bits of every dimension.
BITS = 5

#: Bytes of text that a range of whole rows has, about.
RANGE_BYTES = 64 << 20


def category(value: Column, bits: int = BITS) -> Column:
    """A cell number for a string: equal values share a cell, so a filter on the value names one cell. Null is ''."""
    digits = F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit("")).cast("binary")), 1, 4), 16, 10)
    return (digits.cast("long") % (1 << bits)).cast("int")


def magnitude(value: Column, bits: int = BITS) -> Column:
    """A cell number for a count of at least 1: the position of its highest bit. Null is 0."""
    return F.least(F.coalesce(F.length(F.bin(F.greatest(value, F.lit(1)))) - 1, F.lit(0)), F.lit((1 << bits) - 1)).cast("int")


def hilbert_index(dims: list[Column], bits: int = BITS) -> Column:
    """Position of a cell on the Hilbert curve through the grid of ``len(dims)`` dimensions of ``bits`` bits.

    The published transposed form: undo the rotations bit by bit, Gray-encode, and interleave the bits.
    """
    n = len(dims)
    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def step(x: Column, s: Column) -> Column:
        q, low = s["q"], s["q"] - 1
        hit = F.get(x, s["i"]).bitwiseAND(q) != 0
        swap = F.get(x, F.lit(0)).bitwiseXOR(F.get(x, s["i"])).bitwiseAND(low)
        return F.transform(
            x,
            lambda v, k: F.when((k == 0) & hit, v.bitwiseXOR(low))
            .when(((k == 0) | (k == s["i"])) & ~hit, v.bitwiseXOR(swap))
            .otherwise(v),
        )

    turned = F.aggregate(steps, F.array(*[d.cast("int") for d in dims]), step)

    def coded(x: Column) -> Column:
        gray, out = None, []
        for i in range(n):
            gray = F.get(x, F.lit(i)) if gray is None else gray.bitwiseXOR(F.get(x, F.lit(i)))
            out.append(gray)
        return F.array(*out)

    def finish(g: Column) -> Column:
        flips = F.lit(0)
        for b in range(bits - 1, 0, -1):
            flips = flips.bitwiseXOR(F.when(F.get(g, F.lit(n - 1)).bitwiseAND(F.lit(1 << b)) != 0, F.lit((1 << b) - 1)).otherwise(F.lit(0)))
        return F.transform(g, lambda v: v.bitwiseXOR(flips))

    def woven(x: Column) -> Column:
        out = F.lit(0).cast("long")
        for b in range(bits - 1, -1, -1):
            for i in range(n):
                out = F.shiftleft(out, 1).bitwiseOR(F.shiftright(F.get(x, F.lit(i)), b).bitwiseAND(F.lit(1)).cast("long"))
        return out

    coded_ = F.transform(F.array(turned), coded)
    finished = F.transform(coded_, finish)
    return F.transform(finished, woven)[0]


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def hilbert_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", categories: tuple[str, ...] = ("lang", "source"), whole_rows: bool = False) -> DataFrame:
    """One row per row of ``docs``: the id, size, text_crc32, law, shard, slot, grown_shard and hilbert.

    Dimensions are the categories and the magnitude of the size; rows are ordered by curve index, text_crc32, size and
    id, and cut into ``shards`` runs whose row counts differ by at most one (law ``rows``). With ``whole_rows`` the
    columns of ``docs`` come in a struct ``row``. A null text has size 1 and text_crc32 0, null categories share the
    cell of '', null ids come first among equals, repeated rows get neighbouring slots; an empty table gives an empty
    result.
    """
    text = F.col(text_col)
    carry = [F.struct("*").alias("row")] if whole_rows else []
    slim = docs.select(
        F.col(id_col).alias("id"), size_of(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.array(*[category(F.col(c)) for c in categories], magnitude(size_of(text))).alias("cell"), *carry,
    )
    cells = [F.get("cell", F.lit(k)) for k in range(len(categories) + 1)]
    slim = slim.withColumn("hilbert", hilbert_index(cells)).drop("cell")
    ranges = None
    if whole_rows:
        # Texts go with their rows, so there are as many ranges as their bytes ask for.
        least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        total = docs.agg(F.coalesce(F.sum(size_of(text)), F.lit(0))).first()[0]
        ranges = max(least, -(-total // RANGE_BYTES))
    placed = ranked(slim, "hilbert", "text_crc32", "size", "id", ranges=ranges)
    shard = F.expr(f"rank * {shards} div greatest(total, 1)")
    start = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    placed = placed.withColumn("shard", shard).withColumn("slot", F.col("rank") - start)
    return placed.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        "slot", F.lit(None).cast(T.IntegerType()).alias("grown_shard"), "hilbert", *(["row"] if whole_rows else []),
    )


def shard_ranges(sharded: DataFrame, *dims: str) -> DataFrame:
    """The manifest by which files are pruned: per shard its rows and the smallest and largest value of each dimension."""
    bounds = [f(d).alias(f"{n}_{d}") for d in dims for n, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), *bounds)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard with rows in curve order, so that the files' column ranges are narrow. A shard is cut into
    ranges of slots, a file for each, which are written by tasks of their own."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
