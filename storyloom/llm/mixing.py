"""Mixing sources to target weights by temperature, realised as budgeted permutations of blocks of documents."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyloom.llm.shared import saved, spread_join

BYTES_PER_TOKEN = 4

#: Tokens of a block at least, and blocks of a source at most; a source's number of blocks is a power of two.
BLOCK_TOKENS = 1 << 20
MOST_BLOCKS = 4096

#: Halvings of the range of exponents, and how many of them one pass over the sources makes.
STEPS = 20
PER_PASS = 4


def token_count(text: Column) -> Column:
    """Tokens of a text, estimated as a quarter of its UTF-8 bytes, rounded up; none for null."""
    return F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / BYTES_PER_TOKEN).cast("long")


def digest(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))


def exponent(shares: DataFrame, entropy: float, repetition: float, stretch: float) -> float:
    """The exponent of the token shares ``p``, bisected in [0, 1] on a grid of 2^-STEPS.

    The largest whose weights have at least ``entropy`` times the entropy of equal weights; but no smaller than the
    smallest at which no source is repeated more than ``repetition`` times, where ``stretch`` is the budget by the tokens
    there are. If even 1 repeats more, 1. The sources stay where they are: a pass sums up what the next PER_PASS halvings
    of both searches may ask for, and only these sums come to the driver.
    """
    scale = 1 << STEPS

    def looked_up(places: set[int]) -> dict[int, tuple[float, float]]:
        """Per grid point: entropy of its weights, and the most that a source is repeated."""
        sums = []
        for x in sorted(places):
            w = F.pow("p", F.lit(x / scale))
            sums += [F.sum(w).alias(f"z{x}"), F.sum(w * F.log(w)).alias(f"e{x}"), F.max(w / F.col("p")).alias(f"m{x}")]
        row = shares.agg(*sums).first()
        return {x: (math.log(row[f"z{x}"]) - row[f"e{x}"] / row[f"z{x}"], row[f"m{x}"] / row[f"z{x}"] * stretch) for x in places}

    n = shares.count()
    spread_fits = lambda v: v[0] >= math.log(n) * entropy
    repeats = lambda v: v[1] > repetition
    ends = looked_up({0, scale})
    at = {spread_fits: 0, repeats: 0}
    for done in range(0, STEPS, PER_PASS):
        width = 1 << (STEPS - done - PER_PASS)
        known = looked_up({start + k * width for start in at.values() for k in range(1, 1 << PER_PASS)})
        for fits in at:
            for step in range(done, done + PER_PASS):
                ahead = at[fits] + (1 << (STEPS - 1 - step))
                at[fits] = ahead if fits(known[ahead]) else at[fits]
    by_spread = scale if spread_fits(ends[scale]) else at[spread_fits]
    by_repeats = at[repeats] + 1 if repeats(ends[0]) else 0
    return max(by_spread, by_repeats) / scale


def weights(sources: DataFrame, entropy: float, repetition: float, budget: int | None, keep_all: bool = False) -> DataFrame:
    """(source, available, target): tokens of each source that has some, and those that it gets.

    With ``keep_all`` the budget grows until no source gets less than it has.
    """
    have = sources.filter("available > 0")
    total = int(have.agg(F.coalesce(F.sum("available"), F.lit(0))).first()[0])
    if not total:
        return have.withColumn("target", F.lit(0).cast("long"))
    budget = total if budget is None else budget
    shares = have.withColumn("p", F.col("available") / F.lit(total))
    alpha = exponent(shares, entropy, repetition, budget / total)
    shares = shares.withColumn("w", F.pow("p", F.lit(alpha)))
    z, least = shares.agg(F.sum("w"), F.max(F.col("available") / F.col("w"))).first()
    if keep_all:
        budget = max(budget, math.ceil(least * z * (1 + 1e-9)))
    return shares.select("source", "available", F.floor(F.col("w") / z * budget + 0.5).cast("long").alias("target"))


def cut(available: Column, block_tokens: int) -> Column:
    """Blocks of a source: the least power of two of which each has ``block_tokens`` or fewer on average."""
    want = F.greatest(F.ceil(available / block_tokens), F.lit(1).cast("long"))
    bits = F.when(want > 1, F.length(F.bin(want - 1))).otherwise(0)
    return F.least(F.call_function("shiftleft", F.lit(1).cast("long"), bits), F.lit(MOST_BLOCKS).cast("long"))


def turn_of(seed: int) -> Column:
    """Place of a block, by its source's columns and ``number``, in the last pass over the source."""
    return digest(F.lit(seed), F.col("source"), F.col("epochs"), F.col("number") % F.col("n_blocks"))


def source_plan(slim: DataFrame, seed: int, entropy: float, repetition: float, budget: int | None, keep_all: bool, block_tokens: int) -> tuple[DataFrame, int]:
    """(source, docs, n_blocks, epochs, whole, split, upto), and the number of documents: a document comes ``epochs``
    times, and once more in the last pass if its block's turn is at most ``whole``, or is ``split``, in which the budget
    ends, and the document's digest is at most ``upto``.

    ``slim`` has source, number, tokens and key, and numbers documents below MOST_BLOCKS; a block is what has the same
    remainder by the source's number of blocks. Only the documents of the blocks in which budgets end are sorted.
    """
    fine = saved(slim.groupBy("source", "number").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")), "blocks")
    sources = saved(fine.groupBy("source").agg(F.sum("tokens").alias("available"), F.sum("docs").alias("docs")), "sources")
    target = weights(sources, entropy, repetition, budget, keep_all).select("source", "target")
    plan = sources.join(target, "source", "left").select(
        "source", "docs", cut(F.col("available"), block_tokens).alias("n_blocks"), F.coalesce(F.expr("target div available"), F.lit(0)).alias("epochs"),
        F.coalesce(F.expr("target % available"), F.lit(0)).alias("rest"),
    )
    turns = fine.select("source", "number", "tokens").join(plan, "source").withColumn("turn", turn_of(seed)).groupBy("source", "rest", "turn").agg(F.sum("tokens").alias("tokens"))
    turns = turns.withColumn("upto", F.sum("tokens").over(Window.partitionBy("source").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)))
    ends = F.when((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("tokens") < F.col("rest")), F.struct("turn", (F.col("rest") - F.col("upto") + F.col("tokens")).alias("room")))
    cuts = turns.groupBy("source").agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("turn"))).alias("whole"), F.max(ends).alias("end"))
    plan = saved(plan.drop("rest").join(cuts, "source").select("source", "docs", "n_blocks", "epochs", "whole", F.col("end.turn").alias("split"), F.col("end.room").alias("room")), "plan")
    total = plan.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
    inside = spread_join(slim, plan.filter("split is not null"), ["source"], "docs", total).filter(turn_of(seed) == F.col("split"))
    upto = inside.withColumn("sum", F.sum("tokens").over(Window.partitionBy("source").orderBy("key").rangeBetween(Window.unboundedPreceding, 0)))
    upto = upto.filter("sum <= room").groupBy("source").agg(F.max("key").alias("upto"))
    return saved(plan.drop("room").join(upto, "source", "left"), "plan"), total


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", entropy: float = 0.95, repetition: float = 4.0, budget: int | None = None, seed: int = 7, block_tokens: int = BLOCK_TOKENS, keep_all: bool = False, whole_rows: bool = False) -> DataFrame:
    """One row per row of ``docs``: the id, source, tokens and copies (0 or more) in the mixture.

    Source weights are token shares raised to an exponent (see ``exponent``), normalised; ``budget`` tokens (all of the
    corpus by default) are dealt by them. A source's documents are dealt into blocks by a digest of their ids; each pass
    over the source goes through its blocks in an order of its own, and the last pass ends where the budget does, within
    a block at the last document that fits. So copies of one source differ by at most one. Null sources form one source;
    rows without text have no tokens and go with their block. Rows of equal id share their fate. With ``whole_rows`` the
    columns of ``docs`` come in a struct ``row``. An empty table gives an empty result.
    """
    carry = [F.struct("*").alias("row")] if whole_rows else []
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.col(source_col).alias("said"), token_count(F.col(text_col)).alias("tokens"), *carry)
    rows = rows.withColumn("key", digest(F.lit(seed), F.col("id")))
    rows = rows.withColumn("number", F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % MOST_BLOCKS)
    slim = saved(rows.select("source", "number", "tokens", "key"), "sizes")
    plan, total = source_plan(slim, seed, entropy, repetition, budget, keep_all, block_tokens)
    out = spread_join(rows, plan, ["source"], "docs", total)
    again = (turn_of(seed) <= F.col("whole")) | ((turn_of(seed) == F.col("split")) & (F.col("key") <= F.col("upto")))
    out = out.withColumn("copies", (F.col("epochs") + F.when(again, 1).otherwise(0)).cast("long"))
    return out.select(F.col("id").alias(id_col), F.col("said").alias(source_col), "tokens", "copies", *(["row"] if whole_rows else []))


def realised(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, each as often as ``mixed`` says."""
    out = mixed(docs, whole_rows=True, **options).filter("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
