"""Chat formatting by perspective rotation, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.shared import HOT_SHARE, saved, spread_join
from storyloom.operators.ranks import ranked

#: Most turns of one rendered row besides carried system turns; a dialogue of no more turns is one row.
PIECE_TURNS = 1024

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"
NAMELESS = "unknown"


def escaped(text: Column) -> Column:
    """A text in which a mark of the format can't open or close a turn: its bar gets a backslash."""
    for mark in (OPEN, CLOSE):
        text = F.replace(text, F.lit(mark), F.lit(mark.replace("<|", "<\\|")))
    return text


def name_of(role: Column) -> Column:
    return escaped(F.regexp_replace(role, r"[\x00-\x1f\x7f]", " "))


def prefix(role: Column, me: Column) -> Column:
    """Opening of a turn as seen by ``me``: own turns are the assistant's, others are users with their names."""
    user = F.concat(F.lit(f"{OPEN}user name="), name_of(role), F.lit("\n"))
    return F.when(role == SYSTEM, F.lit(f"{OPEN}system\n")).when(role == me, F.lit(f"{OPEN}assistant\n")).otherwise(user)


def pieces_of(turns: DataFrame, conv: Column, turn: Column, role: Column, text: Column, piece_turns: int) -> DataFrame:
    """(conv, piece, said, cast): turns in order as structs, and all participants of the conversation in order.

    Turns are counted first. A conversation of one piece is gathered at once. Only longer ones are ranked, over all of
    them by ranges of their order, so that no task sees the whole of a long conversation, or of many turns with one
    number; pieces are then cut by the distance to the rank at which the conversation begins.
    """
    rows = turns.select(
        conv.alias("conv"), F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit("")).alias("k"), F.coalesce(turn.cast("long"), F.lit(0).cast("long")).alias("turn"),
        F.coalesce(role, F.lit(NAMELESS)).alias("role"), F.coalesce(text, F.lit("")).alias("text"),
    )
    sizes = saved(rows.groupBy("k").agg(F.count("*").alias("turns")), "conversations")
    long_ = sizes.filter(F.col("turns") > piece_turns)
    said, speaker = F.struct("turn", "role", "text"), F.when(F.col("role") != SYSTEM, F.col("role"))
    if long_.isEmpty():
        short = rows
    else:
        total = sizes.agg(F.sum("turns")).first()[0]
        hot = F.col("turns") * HOT_SHARE > total
        cool = rows.join(F.broadcast(long_.filter(hot)), "k", "left_anti")
        short = cool.join(long_.filter(~hot), "k", "left_anti")
    whole = short.groupBy("k", "conv").agg(F.array_sort(F.collect_list(said)).alias("said"), F.array_sort(F.collect_set(speaker)).alias("cast"))
    whole = whole.select("conv", F.lit(0).cast("long").alias("piece"), "said", "cast")
    if short is rows:
        return whole
    placed = ranked(spread_join(rows, long_, ["k"], "turns", total).drop("turns"), "k", "turn", "role", "text").drop("total")
    convs = placed.groupBy("k").agg(F.min("rank").alias("begin"), F.count("*").alias("turns"), F.array_sort(F.collect_set(speaker)).alias("cast"))
    placed = spread_join(placed, saved(convs, "conversations"), ["k"], "turns", total).withColumn("at", F.col("rank") - F.col("begin"))
    placed = placed.withColumn("piece", F.expr(f"at div {piece_turns}"))
    at = F.struct("at", "turn", "role", "text").alias("said")
    own = placed.select("conv", "k", "piece", at, F.when(F.col("at") % piece_turns == 0, F.col("cast")).alias("cast"))
    later = F.explode(F.expr(f"sequence(1L, (turns - 1) div {piece_turns})")).alias("piece")
    carried = placed.filter((F.col("piece") == 0) & (F.col("role") == SYSTEM)).select("conv", "k", later, at, F.lit(None).cast("array<string>").alias("cast"))
    pieces = own.unionByName(carried).groupBy("k", "conv", "piece").agg(F.array_sort(F.collect_list("said")).alias("said"), F.max("cast").alias("cast"))
    told = F.transform("said", lambda s: F.struct(s["turn"].alias("turn"), s["role"].alias("role"), s["text"].alias("text"))).alias("said")
    return whole.unionByName(pieces.select("conv", "piece", told, "cast"))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", piece_turns: int = PIECE_TURNS) -> DataFrame:
    """One row per conversation, piece and participant: conv_id, piece, participant, n_turns, rendered and mask.

    The dialogue is rendered with the participant as assistant, other participants as named users and system turns as
    they are. ``mask`` lists the half-open code-point ranges of ``rendered`` to train on: the participant's texts with
    their closing mark. A dialogue of up to ``piece_turns`` turns is one piece. A longer one is cut into pieces of so
    many turns, all rendered for everyone who speaks anywhere in it; later pieces begin with the system turns of the
    first, and one in which the participant is silent has an empty mask. A conversation of system turns only is rendered
    for the participant null.

    Turns are ordered by number, role and text; repeated rows are turns of their own. A null role is ``unknown``, a null
    text is empty, a null turn number is 0; null conversation ids form one conversation. Marks of the format inside texts
    and names are escaped, see ``escaped``, and control characters in names become blanks. Other columns are not read.
    An empty table gives an empty result.
    """
    pieces = pieces_of(turns, F.col(conv_col), F.col(turn_col), F.col(role_col), F.col(text_col), piece_turns)
    views = pieces.select("conv", "piece", "said", F.explode_outer("cast").alias("me"))
    parts = F.transform(
        "said",
        lambda s: F.struct(
            prefix(s["role"], F.col("me")).alias("open"), F.concat(escaped(s["text"]), F.lit(CLOSE)).alias("body"),
            (s["role"].eqNullSafe(F.col("me")) & (s["role"] != SYSTEM)).alias("mine"),
        ),
    )
    sized = F.transform("parts", lambda x: F.struct((F.length(x["open"]) + F.length(x["body"]) + 1).alias("n"), F.length(x["open"]).alias("open"), x["mine"].alias("mine")))
    views = views.withColumn("parts", parts)
    mask = F.aggregate(
        sized,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + x["n"]).alias("at"),
            F.when(x["mine"], F.concat(a["spans"], F.array(F.struct((a["at"] + x["open"]).alias("start"), (a["at"] + x["n"] - 1).alias("end"))))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return views.select(
        F.col("conv").alias(conv_col), "piece", F.col("me").alias("participant"), F.size("said").cast("long").alias("n_turns"),
        F.array_join(F.transform("parts", lambda x: F.concat(x["open"], x["body"], F.lit("\n"))), "").alias("rendered"), mask.alias("mask"),
    )
