"""Voice configuration: lookups, routing, style and seed rules, and the order of render requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyloom.functions import text as T
from storyloom.operators.ranks import ranked

PLAIN_VOICE = "A clear, natural speaking voice"
TYPES = ("custom", "clone", "lora", "builtin_lora", "design")


def with_config(rows: DataFrame, config: DataFrame) -> DataFrame:
    """Rows beside their speaker's configuration in struct ``voice``, null without one. Spark picks the join: a small
    configuration is broadcast once its size is known, a large one shuffled."""
    return rows.join(config.select("speaker", F.struct(*[c for c in config.columns if c != "speaker"]).alias("voice")), "speaker", "left")


def single_route(kind: Column, has_config: Column) -> Column:
    """How one chunk is rendered; without configuration, or of an unknown type, it is skipped."""
    return F.when(~has_config, F.lit("skip")).when(kind.isin("lora", "builtin_lora"), F.lit("lora")).when(T.text_of(kind).isin("", "custom"), F.lit("custom")).when(kind.isin("clone", "design"), kind).otherwise(F.lit("skip"))


def batch_route(kind: Column) -> Column:
    """How a chunk of a batch is rendered; without configuration it is custom."""
    return F.when(kind.isin("lora", "builtin_lora"), F.lit("lora")).when(kind.isin("clone", "design"), kind).otherwise(F.lit("custom"))


def group_key(kind: Column, speaker: Column, adapter: Column) -> Column:
    """Chunks with equal keys use the same voice or adapter."""
    return (
        F.when(kind == "clone", F.concat(F.lit("clone:"), speaker))
        .when(kind.isin("lora", "builtin_lora"), F.concat(F.lit("lora:"), T.text_of(adapter)))
        .when(kind == "design", F.lit("design"))
        .otherwise(F.lit("custom"))
    )


def single_instruct(instruct: Column, default_style: Column) -> Column:
    return F.coalesce(T.non_empty(instruct), T.non_empty(default_style), F.lit("neutral"))


def batch_instruct(instruct: Column, character_style: Column, default_style: Column) -> Column:
    return F.concat_ws(" ", F.coalesce(T.non_empty(instruct), F.lit("neutral")), F.coalesce(T.non_empty(character_style), T.non_empty(default_style)))


def lora_instruct(instruct: Column, character_style: Column, default_style: Column) -> Column:
    """In a chat turn; null if there is nothing to say."""
    both = T.strip(F.concat_ws(" ", T.non_empty(instruct), F.coalesce(T.non_empty(character_style), T.non_empty(default_style))))
    return F.when(both != "", T.chat_turn(both))


def design_description(base: Column, instruct: Column) -> Column:
    return F.coalesce(T.non_empty(T.joined_style(base, instruct, ", ")), F.lit(PLAIN_VOICE))


def resolved_seed(per_line: Column, place: Column, overall: Column) -> Column:
    """The line's own seed if there is one of at least 0, else the overall one if at least 0, else -1."""
    own = F.get(per_line, place)
    return F.when(own >= 0, own).when(overall >= 0, overall).otherwise(-1).cast("long")


def grouped_order(requests: DataFrame) -> DataFrame:
    """Requests (book_id, req_pos, key) with ``place``: keys in order of first request, requests of a key in their own.
    Dealt by book once; both windows work on that."""
    first = requests.repartition("book_id").withColumn("first_pos", F.min("req_pos").over(Window.partitionBy("book_id", "key")))
    return first.withColumn("place", (F.row_number().over(Window.partitionBy("book_id").orderBy("first_pos", "req_pos")) - 1).cast("long"))


def upserted(config: DataFrame, changes: DataFrame) -> DataFrame:
    """Configuration in which every changed speaker has its new row as a whole."""
    return config.join(changes.select("speaker"), "speaker", "left_anti").unionByName(changes, allowMissingColumns=True)


def adapters(builtin: DataFrame, own: DataFrame, present: DataFrame) -> DataFrame:
    """Built-in adapters whose files are present, then the user's own, with ``builtin`` and their order ``rank``."""
    there = builtin.join(present, "id", "left_semi").withColumn("builtin", F.lit(True))
    both = there.unionByName(own.withColumn("builtin", F.lit(False)), allowMissingColumns=True)
    return ranked(both, F.desc("builtin"), "id").withColumn("rank", F.col("rank") + 1).drop("total")


def deleted(builtin: DataFrame, own: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(own adapters without the ``ids``, what became of every id): a built-in one is ``forbidden``, an unknown one
    ``missing``, others are ``deleted``."""
    asked = ids.select("id").distinct()
    fate = asked.join(builtin.select("id", F.lit(True).alias("b")).distinct(), "id", "left").join(own.select("id", F.lit(True).alias("o")).distinct(), "id", "left")
    fate = fate.select("id", F.when(F.col("b"), "forbidden").when(F.col("o"), "deleted").otherwise("missing").alias("fate"))
    return without(own, fate.filter("fate = 'deleted'")), fate


def without(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not among ``ids``."""
    return rows.join(ids.select(key), key, "left_anti")


def first_match(rows: DataFrame, key: str, value, order: str) -> DataFrame:
    return rows.filter(F.col(key) == value).orderBy(order).limit(1)


def name_collisions(speakers: DataFrame) -> DataFrame:
    """File stems that several speakers share."""
    stems = speakers.select("speaker", T.file_stem(F.col("speaker")).alias("stem")).distinct()
    return stems.groupBy("stem").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("speaker")), ", ").alias("speakers")).filter("n > 1")
