"""Planning of render batches, and figures of what was rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyloom.functions import text as T
from storyloom.operators import chunks, fold, timeline, voices
from storyloom.operators.models import LINE, Speech, called, spoken

MIN_SIZE, RATIO, MAX_CHARS = 4, 5.0, 3000
NEW_TOKENS = 2048
UNLIMITED = 9999


def item_limit(estimate: Column, manual: Column) -> Column:
    """The stricter of the memory estimate and the manual limit; 0 and null are none, and null is no limit at all."""
    return F.least(F.nullif(estimate, F.lit(0)), F.nullif(manual, F.lit(0)))


def sub_batches(chunks: DataFrame, *by: str, min_size: int = MIN_SIZE, ratio: float = RATIO, max_chars: int = MAX_CHARS, max_items: int | None = None, enabled: bool = True, beside: tuple[str, ...] = ()) -> DataFrame:
    """Chunks (``by``..., id, text) in order of length, cut into sub-batches: ``sub_no`` and ``idx`` in the sorted batch,
    with the columns that are to stay ``beside`` them.

    A chunk opens a new sub-batch when the open one has ``max_items``, or would exceed ``max_chars``, or has
    ``min_size`` and the chunk is more than ``ratio`` times as long as its first. Batches are of bounded size.
    """
    item = F.struct(F.length(F.coalesce("text", F.lit(""))).alias("n"), "id", *[F.col(c).alias(f"_{c}") for c in beside])
    arrays = chunks.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("items"))
    sizes = F.transform("items", lambda x: x["n"])

    def begins(total: Column, first: Column, count: Column, x: Column) -> Column:
        full = (count >= max_items) if max_items else F.lit(False)
        return full | (total + x > max_chars) | ((count >= min_size) & (x > F.greatest(first, F.lit(1)) * ratio))

    starts = fold.group_starts(sizes, begins, lambda total, x: total + x, lambda x: x) if enabled else F.array(F.lit(0))
    cut = arrays.select(*by, "items", starts.alias("starts"))
    parts = cut.select(*by, F.posexplode(fold.groups(F.col("items"), F.col("starts"))).alias("sub_no", "g"))
    return parts.select(*by, "sub_no", F.posexplode("g").alias("idx", "x")).select(*by, "sub_no", "idx", "x.id", F.col("x.n").alias("n_chars"), *[F.col(f"x._{c}").alias(c) for c in beside])


def sub_batch_figures(plan: DataFrame, *by: str) -> DataFrame:
    n = F.col("n_chars")
    return plan.groupBy(*by, "sub_no").agg(F.count("*").alias("n_items"), F.sum(n).cast("long").alias("chars"), F.min(n).alias("shortest"), F.max(n).alias("longest"))


def estimated_items(layers: Column, kv_heads: Column, head_dim: Column, prompt: Column, ref_chars: Column, text_chars: Column, free_bytes: Column) -> Column:
    """Sequences that fit into 80 % of the free memory, with twice the cache of each; 9999 if memory is unknown."""
    per_token = layers * 2 * kv_heads * head_dim * 2
    third = lambda c: F.floor(c / 3)
    tokens = prompt + third(ref_chars) + third(text_chars) + 10 + NEW_TOKENS
    fits = F.floor(free_bytes * 0.8 / (per_token * tokens * 2.0))
    return F.when(fits.isNull(), UNLIMITED).otherwise(F.greatest(F.lit(1), fits)).cast("long")


def real_time_factor(dur_s: Column, wall_s: Column) -> Column:
    return F.when(wall_s > 0, dur_s / wall_s).otherwise(0.0)


def progress(results: DataFrame, *by: str) -> DataFrame:
    """Running completed and failed counts of results (``by``..., seq, ok), beside the total."""
    part = Window.partitionBy(*by)
    w = part.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return results.withColumn("completed", F.count_if("ok").over(w)).withColumn("failed", F.count_if(~F.col("ok")).over(w)).withColumn("total", F.count("*").over(part))


def batch_results(results: DataFrame, *by: str) -> DataFrame:
    """Completed ids and failed (id, error) pairs per batch, in order of id."""
    done = F.array_sort(F.collect_list(F.when(F.col("ok"), F.col("id"))))
    bad = F.array_sort(F.collect_list(F.when(~F.col("ok"), F.struct("id", "error"))))
    return results.groupBy(*by).agg(done.alias("completed"), bad.alias("failed"))


def render_plan(table: DataFrame, requests: DataFrame, config: DataFrame, batch_size: int, by_voice: bool = False, **limits) -> DataFrame:
    """Calls of the speech model for the requested chunks that have text, one row an item: book_id, batch, route, key,
    sub_no, idx, item, id, speaker, text, instruct, voice and adapter.

    Batches are ``batch_size`` requests in their order, or in that of their voices. A batch is parted by route and key,
    the speaker of a cloned voice or the adapter, before it is sorted by length and cut (see ``sub_batches``), so no call
    mixes voices or adapters; lines of a designed voice are calls of their own.
    """
    asked = voices.with_config(chunks.renderable(table, requests), config)
    of = lambda f: F.col(f"voice.{f}") if f in config.columns else F.lit(None).cast("string")
    asked = asked.withColumn("route", voices.batch_route(of("type"))).withColumn("key", voices.group_key(of("type"), F.col("speaker"), of("adapter_id")))
    placed = voices.grouped_order(asked) if by_voice else asked.withColumn("place", F.row_number().over(Window.partitionBy("book_id").orderBy("req_pos")) - 1)
    apart = F.when(F.col("route") == "design", F.concat(F.col("key"), F.lit(":"), F.col("place").cast("string"))).otherwise(F.col("key"))
    placed = placed.withColumn("batch", F.expr(f"place div {batch_size}")).withColumn("item", F.col("place").cast("long")).withColumn("key", apart)
    by = ("book_id", "batch", "route", "key")
    style = F.when(F.col("route") == "lora", voices.lora_instruct(F.col("instruct"), of("character_style"), of("default_style")))
    style = style.when(F.col("route") == "design", voices.design_description(of("description"), F.col("instruct")))
    style = style.when(F.col("route") == "custom", voices.batch_instruct(F.col("instruct"), of("character_style"), of("default_style")))
    told = placed.select(*by, F.col("item").alias("id"), F.col("id").alias("chunk"), "speaker", "text", style.alias("instruct"), of("voice").alias("voice"), of("adapter_id").alias("adapter"))
    plan = sub_batches(told, *by, **limits, beside=("chunk", *LINE))
    return plan.select(*by, F.col("id").alias("item"), F.col("chunk").alias("id"), "speaker", "text", "instruct", "voice", "adapter", "sub_no", "idx", "n_chars")


def performed(plan: DataFrame, speech: Speech = spoken) -> DataFrame:
    """(book_id, batch, item, id, speaker, ok, error, dur_ms, mp3_bytes) of every planned item, by one call of the speech
    model for each sub-batch.

    Sub-batches are dealt to tasks by voice, the calls of a voice over several tasks, and sorted by it, so a task loads
    each of its voices once. A call that raises, or gives another number of results, fails the items of its own sub-batch
    only. Items of an adapter voice without adapter fail before the model is called, audio without duration fails after.
    """
    t = called(plan, speech)
    error = F.when(F.col("call_error").isNotNull(), F.col("call_error")).when(F.coalesce("dur_ms", F.lit(0)) == 0, "Audio has 0 duration")
    return t.select("book_id", "batch", "item", "id", "speaker", error.isNull().alias("ok"), error.alias("error"), "dur_ms", "mp3_bytes")


def named(results: DataFrame) -> DataFrame:
    """Results with the path of the audio that was made."""
    files = timeline.file_names(results, "mp3_bytes")
    return files.select("book_id", "batch", "item", "id", "ok", "error", "dur_ms", F.when(F.col("ok"), F.concat(F.lit("voicelines/"), "file_name")).alias("audio_path"))


def rendered(plan: DataFrame, speech: Speech = spoken) -> DataFrame:
    """(book_id, batch, item, id, ok, error, dur_ms, audio_path) of every planned item; see ``performed``."""
    return named(performed(plan, speech))


def settled(results: DataFrame, table: DataFrame) -> DataFrame:
    """As ``named``, against the chunks as they are after the calls: audio has the name of the speaker of now, and what was
    made for a place that is gone has failed."""
    now = table.select(F.col("book_id").alias("b"), F.col("id").alias("i"), F.col("speaker").alias("s"))
    t = results.join(now, F.col("book_id").eqNullSafe(F.col("b")) & (F.col("id") == F.col("i")), "left")
    gone = F.col("i").isNull() & F.col("ok")
    t = t.withColumn("error", F.when(gone, "Index out of range after reload").otherwise(F.col("error")))
    return named(t.withColumn("ok", F.col("ok") & ~gone).withColumn("speaker", F.coalesce("s", "speaker")))


def render_status(table: DataFrame, results: DataFrame) -> DataFrame:
    """The chunk table after rendering: done with its audio, or error with the audio it had; others are as before."""
    log = results.select("book_id", "id", F.col("item").alias("seq"), F.when(F.col("ok"), "done").otherwise("error").alias("status"), "audio_path")
    last = log.groupBy("book_id", "id").agg(F.max_by(F.struct("status", "audio_path"), "seq").alias("s"))
    t = table.join(last, ["book_id", "id"], "left")
    return t.select("book_id", "id", *chunks.FIELDS, F.coalesce("s.status", "status").alias("status"), F.coalesce("s.audio_path", "audio_path").alias("audio_path"))
