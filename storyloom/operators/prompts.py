"""Prompts for a language model, put together from parts of books, and the settings of a call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyloom.functions import text as T
from storyloom.operators import script

#: Entries before a chunk, and before a batch, that its prompt shows.
SHOWN, SHOWN_IN_REVIEW = 3, 2

#: Defaults of the settings, by section.
DEFAULTS = {
    "llm": {"base_url": "http://localhost:11434/v1", "api_key": "local", "model_name": "richardyoung/qwen3-14b-abliterated:Q8_0"},
    "tts": {"mode": "external", "url": "http://127.0.0.1:7860", "device": "auto"},
}
CONFIG = "struct<llm:struct<base_url:string,api_key:string,model_name:string>,tts:struct<mode:string,url:string,device:string>,prompts:struct<system_prompt:string,user_prompt:string>>"


def earlier(entries: DataFrame, parts: DataFrame, part: str, k: int) -> DataFrame:
    """Per (book_id, ``part``) of ``parts``, the JSON texts of the last ``k`` entries of earlier parts, as an array.

    Parts are rows of their own before their entries, so a part without entries is seen too; one window per book.
    """
    told = entries.select("book_id", part, F.lit(1).alias("kind"), "pos", T.entry_json(F.col("speaker"), F.col("text"), F.col("instruct")).alias("e"))
    marks = parts.select("book_id", part).distinct().select("book_id", part, F.lit(0).alias("kind"), F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("e"))
    order = Window.partitionBy("book_id").orderBy(part, "kind", "pos")
    # The j-th entry back, not counting marks.
    order_sql = f"(partition by book_id order by {part}, kind, pos)"
    back = [F.expr(f"lag(e, {j}) ignore nulls over {order_sql}").alias(f"e{j}") for j in range(k, 0, -1)]
    seen = told.unionByName(marks).withColumn("n", F.row_number().over(order)).select("book_id", part, "kind", *back)
    return seen.filter("kind = 0").select("book_id", part, F.array_compact(F.array(*[f"e{j}" for j in range(k, 0, -1)])).alias("tail"))


def section(title: str, lines: Column) -> Column:
    """An array of a title and lines, empty if there are none."""
    return F.when(F.size(lines) > 0, F.concat(F.array(F.lit(title)), lines)).otherwise(F.array().cast("array<string>"))


def generation_prompts(parts: DataFrame, entries: DataFrame, template: str) -> DataFrame:
    """(book_id, chunk_no, prompt) of each chunk of text (book_id, chunk_no, text): the ``template`` with {chunk} and with
    {context}, which tells the chunk's position, who spoke in earlier chunks, and the last entries of these.

    ``entries`` (with chunk_no) are what the model made of earlier chunks; a null text is empty. A book without entries
    has positions only; an empty table gives an empty result.
    """
    who = script.rosters(entries, "chunk_no", parts)
    before = earlier(entries, parts, "chunk_no", SHOWN)
    t = script.position_label(parts).join(who, ["book_id", "chunk_no"], "left").join(before, ["book_id", "chunk_no"], "left")
    names = F.when(T.text_of(F.col("roster")) != "", F.array(F.concat(F.lit("Characters in this book: "), "roster"))).otherwise(F.array().cast("array<string>"))
    context = F.array_join(F.concat(F.array("label"), names, section("\nPrevious section ended with:", F.coalesce("tail", F.array().cast("array<string>")))), "\n")
    return t.select("book_id", "chunk_no", T.filled(template, context=context, chunk=F.col("text")).alias("prompt"))


def review_prompts(batches: DataFrame, template: str, sources: DataFrame | None = None) -> DataFrame:
    """(book_id, batch_no, prompt) of each batch of entries (book_id, batch_no, idx, speaker, text, instruct): the
    ``template`` with {batch}, the entries as indented JSON, and with {context}, which tells the batch's number, how the
    batch before ended and, from ``sources`` (book_id, batch_no, source), the text behind it. One row per batch is made
    first, so the windows are over batches.
    """
    e = F.struct("idx", F.struct("speaker", "text", "instruct").alias("e"))
    t = batches.groupBy("book_id", "batch_no").agg(F.transform(F.array_sort(F.collect_list(e)), lambda x: x["e"]).alias("es"))
    book = Window.partitionBy("book_id")
    last = F.slice("es", -F.least(F.size("es"), F.lit(SHOWN_IN_REVIEW)), F.least(F.size("es"), F.lit(SHOWN_IN_REVIEW)))
    t = t.withColumn("tail", F.lag(last).over(book.orderBy("batch_no"))).withColumn("n", F.count("*").over(book)).withColumn("i", F.row_number().over(book.orderBy("batch_no")))
    tail = F.transform(F.coalesce("tail", F.slice("es", 1, 0)), lambda x: T.entry_json(x["speaker"], x["text"], x["instruct"]))
    t = t.join(sources, ["book_id", "batch_no"], "left") if sources is not None else t.withColumn("source", F.lit(None).cast("string"))
    source = F.when(T.text_of(F.col("source")) != "", F.array(F.concat(F.lit("\nORIGINAL SOURCE TEXT (for reference):\n"), "source"))).otherwise(F.array().cast("array<string>"))
    context = F.array_join(F.concat(F.array(F.format_string("Batch %d of %d.", "i", "n")), section("\nPrevious batch ended with:", tail), source), "\n")
    return t.select("book_id", "batch_no", T.filled(template, context=context, batch=T.pretty_entries(F.col("es"))).alias("prompt"))


def with_defaults(config: Column, system_prompt: Column, user_prompt: Column) -> Column:
    """Settings from a JSON text: null is a missing file, for which everything is the default. Of a file that is there,
    only blank prompts are filled in."""
    c = F.from_json(config, CONFIG)
    leaf = lambda s, f: F.when(config.isNull(), F.lit(DEFAULTS[s][f])).otherwise(c[s][f]).alias(f)
    prompt = lambda f, default: F.coalesce(T.non_empty(c["prompts"][f]), default).alias(f)
    sections = [F.struct(*[leaf(s, f) for f in fields]).alias(s) for s, fields in DEFAULTS.items()]
    return F.struct(*sections, F.struct(prompt("system_prompt", system_prompt), prompt("user_prompt", user_prompt)).alias("prompts"))


def optional_fields(**values: Column) -> Column:
    """A map of the values that are given: null and, for arrays of tokens, empty ones are left out. Values are JSON texts."""
    pairs = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])
    return F.map_filter(pairs, lambda _, v: v.isNotNull() & (v != "[]"))
