"""Queries over the script operators. Each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions import jsonfix
from storyloom.functions import text as T
from storyloom.operators import chunks, dataset, render, script, timeline, voices
from storyloom.operators.models import answered
from storyloom.operators.ranks import ranked
from storyloom.plans import loop_queries, loop_sql, project_queries, project_sql, range_queries, range_sql, script_sql, stream_queries, stream_sql, tables
from storyloom.streaming import progress

Query = Callable[[SparkSession, str], DataFrame]


def speakers_sorted(spark, sf):
    e = tables.table(spark, sf, "conversations")
    return ranked(script.speakers(e, "role"), "speaker").select("speaker", (F.col("rank") + 1).alias("rank"))


def voices_with_config(spark, sf):
    found = voices.with_config(script.speakers(tables.entries(spark, sf)), tables.voices(spark))
    return found.select("speaker", "voice.type", "voice.default_style", F.col("voice").isNotNull().alias("configured"))


def roster_prefix(spark, sf):
    return script.rosters(script.batches(tables.entries(spark, sf), 5).withColumnRenamed("batch_no", "chunk_no"), "chunk_no")


def norm_words(spark, sf):
    d = tables.table(spark, sf, "documents")
    return d.select("doc_id", T.normalised(F.col("text")).alias("norm"), T.word_count(F.col("text")).alias("n_words"))


def safe_names(spark, sf):
    c = tables.table(spark, sf, "customer")
    name = F.concat(F.lit(" É-"), F.col("c_name"), F.lit(" / "), F.col("c_mktsegment"), F.lit("! "))
    return c.select("c_custkey", T.file_stem(name).alias("stem"), T.project_name(name).alias("project"))


def text_predicates(spark, sf):
    e = tables.entries(spark, sf)
    return e.select("book_id", "pos", T.is_structural(F.col("text")).alias("structural"), T.is_section_break(F.col("text")).alias("section_break"), T.preview(F.col("text"), 60, F.col("instruct")).alias("preview"))


def mojibake_fixed(spark, sf):
    e = tables.table(spark, sf, "documents")
    bad = F.col("text")
    for word, (seen, _) in zip(("e th", "n th", "e de", "d th", "t th", "s de", "r th", "a de"), T.MOJIBAKE, strict=True):
        bad = F.replace(bad, F.lit(word), F.lit(seen))
    return e.select("doc_id", T.without_mojibake(bad).alias("text"))


def review_batches(spark, sf):
    b = script.batches(tables.entries(spark, sf))
    return script.tails(b, "batch_no", 2, "last").select("book_id", "batch_no", F.array_join("tail", "|").alias("tail"))


def generation_context(spark, sf):
    b = script.batches(tables.entries(spark, sf), 5)
    return script.tails(b, "batch_no", 3).select("book_id", "batch_no", F.array_join("tail", "|").alias("tail"))


def sides(spark, sf):
    b = script.batches(tables.entries(spark, sf))
    return b, tables.corrected(b)


def entry_diff(spark, sf):
    stats = script.review_stats(*sides(spark, sf))
    return stats.select("book_id", "batch_no", "n_original", "n_corrected", "text_changed", "speaker_changed", "instruct_changed")


def text_loss_gate(spark, sf):
    stats = script.review_stats(*sides(spark, sf))
    return stats.select("book_id", "batch_no", "words_original", "words_corrected", "ratio", "passed")


def review_totals(spark, sf):
    return script.review_totals(script.review_stats(*sides(spark, sf)))


def reviewed_entries(spark, sf):
    a, b = sides(spark, sf)
    return script.reviewed(a, b, script.review_stats(a, b))


def group_chunks(spark, sf):
    return script.render_chunks(tables.entries(spark, sf)).select("book_id", "id", "speaker", "instruct", "text", F.col("n_entries").cast("long").alias("n_entries"))


def merge_narrators(spark, sf):
    got = script.merged_narration(tables.entries(spark, sf))
    return got.select("book_id", "pos", "speaker", "text", F.col("n_entries").cast("long").alias("n_entries"))


def split_text(spark, sf):
    return script.position_label(script.prompt_chunks(tables.books(spark, sf), 1000)).select("book_id", F.col("chunk_no").cast("long").alias("chunk_no"), "text", "label")


def timeline_rows(spark, sf):
    line = timeline.timeline(tables.rendered(tables.entries(spark, sf)))
    return line.select("book_id", "id", "speaker", "start_ms", "end_ms")


def labels_txt(spark, sf):
    """Flagship: lines to chunks, durations, timeline and labels."""
    got = script.render_chunks(tables.entries(spark, sf))
    return timeline.label_lines(timeline.timeline(tables.rendered(got, "id")))


def speaker_tracks(spark, sf):
    return timeline.tracks(timeline.timeline(tables.rendered(tables.entries(spark, sf)))).select("book_id", "id", "speaker", "gap_ms")


def track_summary(spark, sf):
    return timeline.track_summary(timeline.timeline(tables.rendered(tables.entries(spark, sf))))


def lof_text(spark, sf):
    return timeline.track_list(timeline.timeline(tables.rendered(tables.entries(spark, sf))))


def audio_names(spark, sf):
    rows = tables.entries(spark, sf).select("book_id", F.col("pos").alias("id"), "speaker", (F.length("text") * 20).alias("mp3_bytes"))
    return timeline.file_names(rows).select("book_id", "id", "file_name")


def sub_batches(spark, sf):
    rows = tables.entries(spark, sf).select(F.expr("book_id div 10").alias("req"), (F.col("book_id") * 100000 + F.col("pos")).alias("id"), "text")
    return render.sub_batches(rows, "req", max_items=40).select("req", F.col("sub_no").cast("long").alias("sub_no"), "id", F.col("n_chars").cast("long").alias("n_chars"))


def sub_batch_figures(spark, sf):
    rows = tables.entries(spark, sf).select(F.expr("book_id div 10").alias("req"), (F.col("book_id") * 100000 + F.col("pos")).alias("id"), "text")
    got = render.sub_batch_figures(render.sub_batches(rows, "req"), "req")
    return got.select("req", F.col("sub_no").cast("long").alias("sub_no"), "n_items", "chars", F.col("shortest").cast("long").alias("shortest"), F.col("longest").cast("long").alias("longest"))


def batch_limit(spark, sf):
    p = tables.table(spark, sf, "part")
    c = F.col("p_size").cast("long")
    got = render.estimated_items(c, F.lit(8), F.lit(128), F.lit(64), c * 7, c * 11, F.when(c % 7 > 0, F.col("p_partkey") * 1000000))
    return p.select("p_partkey", got.alias("max_items"))


def voiced(spark, sf):
    return voices.with_config(tables.entries(spark, sf), tables.voices(spark))


def voice_routes(spark, sf):
    v = voiced(spark, sf)
    return v.select(
        "book_id", "pos", voices.single_route(F.col("voice.type"), F.col("voice").isNotNull()).alias("single"), voices.batch_route(F.col("voice.type")).alias("batch"),
        voices.group_key(F.col("voice.type"), F.col("speaker"), F.col("voice.adapter_id")).alias("key"),
    )


def voice_groups(spark, sf):
    v = voiced(spark, sf).select("book_id", F.col("pos").alias("req_pos"), voices.group_key(F.col("voice.type"), F.col("speaker"), F.col("voice.adapter_id")).alias("key"))
    return voices.grouped_order(v).select("book_id", "req_pos", "key", "place")


def instruct_resolve(spark, sf):
    v = F.col("voice")
    return voiced(spark, sf).select(
        "book_id", "pos", voices.single_instruct(F.col("instruct"), v["default_style"]).alias("single"),
        voices.batch_instruct(F.col("instruct"), v["character_style"], v["default_style"]).alias("batch"),
        voices.lora_instruct(F.col("instruct"), v["character_style"], v["default_style"]).alias("lora"),
        voices.design_description(v["description"], F.col("instruct")).alias("design"),
    )


def seed_resolve(spark, sf):
    e = tables.entries(spark, sf)
    seeds = F.array(F.lit(5), F.lit(-1), (F.col("book_id") % 3 - 1).cast("int"))
    return e.select("book_id", "pos", voices.resolved_seed(seeds, F.col("pos").cast("int"), (F.col("book_id") % 4 - 1)).alias("seed"))


def voice_upsert(spark, sf):
    change = tables.table(spark, sf, "documents").select(F.concat(F.lit("Voice "), "source").alias("speaker")).distinct().unionByName(spark.createDataFrame([("Bob",)], "speaker string"))
    return voices.upserted(tables.voices(spark), change.withColumn("type", F.lit("custom"))).select("speaker", "type", "adapter_id")


def adapter_union(spark, sf):
    own = tables.table(spark, sf, "supplier").select(F.concat(F.lit("u"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"))
    builtin = tables.table(spark, sf, "nation").select(F.concat(F.lit("b"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey"))
    there = builtin.filter("n_regionkey > 0").select("id")
    gone = own.filter("id = 'u3'").select("id")
    got = voices.without(voices.adapters(builtin.select("id", "name"), own, there), gone)
    return got.select("id", "name", "builtin", "rank")


def stem_collisions(spark, sf):
    c = tables.table(spark, sf, "customer")
    return voices.name_collisions(c.select(F.concat_ws(" ", "c_mktsegment", F.substring("c_name", -2, 1)).alias("speaker")).unionByName(c.select(F.concat_ws("!", F.lower("c_mktsegment"), F.substring("c_name", -2, 1)).alias("speaker"))))


def edits(spark, sf):
    return tables.table(spark, sf, "documents").select(F.col("doc_id").alias("book_id"), (F.col("doc_id") % 5 - 1).alias("at"))


def chunk_insert(spark, sf):
    return chunks.insert_after(tables.listed(spark, sf), edits(spark, sf))


def chunk_delete(spark, sf):
    return chunks.delete_at(tables.listed(spark, sf), edits(spark, sf))


def chunk_restore(spark, sf):
    back = edits(spark, sf).select("book_id", (F.col("at") * 3).alias("at"), F.lit("Bob").alias("speaker"), F.lit("back").alias("text"), F.lit("").alias("instruct"), F.lit("done").alias("status"), F.lit("x.mp3").alias("audio_path"))
    return chunks.restore_at(tables.listed(spark, sf), back)


def chunk_update(spark, sf):
    new = F.when(F.col("at") == 1, F.create_map(F.lit("text"), F.lit(None).cast("string"))).otherwise(F.create_map(F.lit("speaker"), F.lit("Zed")))
    return chunks.update_fields(tables.listed(spark, sf), edits(spark, sf).select("book_id", F.col("at").cast("long").alias("id"), new.alias("fields")))


def chunk_status(spark, sf):
    log = tables.table(spark, sf, "events").select((F.col("user_id") % 200).alias("book_id"), F.expr("event_id % 5").alias("id"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("audio_path"))
    return chunks.latest_status(tables.listed(spark, sf), log)


def renderable_requests(spark, sf):
    want = tables.table(spark, sf, "documents").select(F.col("doc_id").alias("book_id"), F.posexplode(F.array(*[F.lit(i).cast("long") for i in (4, 0, 99999, 2, 0)])).alias("req_pos", "id"))
    return chunks.renderable(tables.listed(spark, sf), want).select("book_id", F.col("req_pos").cast("long").alias("req_pos"), "id", "text")


def builder_merge(spark, sf):
    e = tables.entries(spark, sf)
    old = e.filter("pos < 6 OR book_id % 3 = 1").select("book_id", "pos", F.when(F.col("pos") == 2, "other").otherwise(F.concat(F.lit(" "), "text")).alias("text"), F.lit("done").alias("status"), F.concat_ws("/", F.lit("u"), "pos").alias("audio_url"))
    return dataset.merged_rows(e.select("book_id", "pos", "text"), old)


def dataset_filter(spark, sf):
    return dataset.usable(tables.samples(spark, sf)).select("name", "idx", "duration")


def dataset_skips(spark, sf):
    return dataset.skipped(tables.samples(spark, sf), "name")


def dataset_summary(spark, sf):
    return dataset.project_summary(tables.samples(spark, sf))


def reference_samples(spark, sf):
    return dataset.reference_sample(tables.samples(spark, sf), 20)


def json_repair(spark, sf):
    r = tables.responses(spark, sf).withColumn("got", jsonfix.entries_of(F.col("response")))
    return r.select("conv_id", "turn", "got.how", F.size("got.entries").cast("long").alias("n"), F.coalesce(F.get("got.entries", F.lit(0))["text"], F.lit("")).alias("first_text"))


def annotated_turns(spark, sf):
    r = tables.responses(spark, sf).select(F.col("conv_id").alias("book_id"), F.expr("turn div 3").alias("chunk_no"), (F.col("turn") % 3).alias("attempt"), "response")
    return answered(r).select("book_id", "chunk_no", "attempt", F.size("entries").cast("long").alias("n"))


def log_lines(spark, sf):
    return tables.table(spark, sf, "events").select(F.col("event_type").alias("task"), F.col("event_id").alias("seq"), F.col("props").alias("line"))


def log_tail(spark, sf):
    return progress.tail(log_lines(spark, sf), 100)


def log_counts(spark, sf):
    return progress.counts(log_lines(spark, sf))


def progress_running(spark, sf):
    r = tables.table(spark, sf, "events").select("event_type", F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"), (F.col("user_id") % 50).alias("job"))
    return render.progress(r.select("job", "seq", "ok"), "job").select("job", "seq", "completed", "failed", "total")


def best_loss(spark, sf):
    e = tables.table(spark, sf, "events")
    steps = e.select((F.col("user_id") % 10).alias("run"), F.expr("event_id div 500").alias("epoch"), F.when(F.col("event_type") != "error", F.col("value")).alias("loss"))
    return dataset.epoch_losses(steps, "run").select("run", "epoch", F.round("avg_loss", 6).alias("avg_loss"), "n_steps", "is_best", F.round("best_loss", 6).alias("best_loss"))


def accumulation_steps(spark, sf):
    e = tables.table(spark, sf, "events").select((F.col("user_id") % 10).alias("run"), F.col("event_id").alias("step"))
    return dataset.optimiser_steps(e, 4, "run").select("run", "step", "applies")


ALL = (
    speakers_sorted, voices_with_config, roster_prefix, norm_words, safe_names, text_predicates, mojibake_fixed, review_batches, generation_context,
    entry_diff, text_loss_gate, review_totals, reviewed_entries, group_chunks, merge_narrators, split_text, timeline_rows, labels_txt, speaker_tracks,
    track_summary, lof_text, audio_names, sub_batches, sub_batch_figures, batch_limit, voice_routes, voice_groups, instruct_resolve, seed_resolve,
    voice_upsert, adapter_union, stem_collisions, chunk_insert, chunk_delete, chunk_restore, chunk_update, chunk_status, renderable_requests,
    builder_merge, dataset_filter, dataset_skips, dataset_summary, reference_samples, json_repair, annotated_turns, log_tail, log_counts,
    progress_running, best_loss, accumulation_steps,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (*ALL, *project_queries.ALL, *loop_queries.ALL, *stream_queries.ALL, *range_queries.ALL)}


def oracle_sql() -> dict[str, str]:
    return script_sql.oracle_sql() | project_sql.oracle_sql() | loop_sql.oracle_sql() | stream_sql.oracle_sql() | range_sql.oracle_sql()
