"""Queries over prompts, rendering, projects, files and settings. Each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom.functions import jsonfix
from storyloom.functions import text as T
from storyloom.operators import chunks, dataset, models, projects, prompts, render, script, timeline, voices
from storyloom.plans import tables
from storyloom.sources import files
from storyloom.sources.scratch import new_path

SHOWN_TEMPLATE, REVIEW_TEMPLATE = "{context}\n\nTEXT:\n{chunk}\n", "{context}\n---\n{batch}"


def generation_prompts(spark, sf):
    e = script.batches(tables.entries(spark, sf), 5).withColumnRenamed("batch_no", "chunk_no")
    lines = F.array_sort(F.collect_list(F.struct("pos", "text")))
    parts = e.groupBy("book_id", "chunk_no").agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("text"))
    return prompts.generation_prompts(parts, e, SHOWN_TEMPLATE)


def review_prompts(spark, sf):
    return prompts.review_prompts(script.batches(tables.entries(spark, sf)), REVIEW_TEMPLATE)


def render_requests(spark, sf):
    """Voices with one that has no adapter, and requests of every book: some twice, some that do not exist."""
    lost = spark.createDataFrame([("Élan & co", "lora")], "speaker string, type string")
    config = tables.voices(spark).unionByName(lost, allowMissingColumns=True)
    ids = F.concat(F.array(*[F.lit(i).cast("long") for i in (4, 0, 99999, 2, 10, 0)]), F.sequence(F.lit(11).cast("long"), F.lit(60).cast("long")))
    return config, tables.table(spark, sf, "documents").select(F.col("doc_id").alias("book_id"), F.posexplode(ids).alias("req_pos", "id"))


def planned(spark, sf):
    config, want = render_requests(spark, sf)
    return render.render_plan(tables.listed(spark, sf), want, config, 12, by_voice=True, max_items=5)


def render_calls(spark, sf):
    """Which call of the speech model has which lines."""
    return planned(spark, sf).select("book_id", "batch", "route", "key", F.col("sub_no").cast("long").alias("sub_no"), F.col("idx").cast("long").alias("idx"), "id", "instruct")


def rendering(spark, sf):
    return tables.listed(spark, sf), render.rendered(planned(spark, sf), tables.faulty_speech)


def render_status(spark, sf):
    return render.render_status(*rendering(spark, sf)).select("book_id", "id", "status", "audio_path")


def render_results(spark, sf):
    got = render.batch_results(rendering(spark, sf)[1], "book_id")
    failed = F.transform("failed", lambda x: F.concat(x["id"].cast("string"), F.lit(":"), x["error"]))
    return got.select("book_id", F.array_join(F.transform("completed", lambda x: x.cast("string")), ",").alias("completed"), F.array_join(failed, ",").alias("failed"))


def speech_durations(spark, sf):
    rows = tables.table(spark, sf, "conversations").select(F.col("conv_id").alias("book_id"), F.col("turn").alias("id"), "text", F.col("role").alias("voice"))
    return models.synthesised(rows).select("book_id", "id", "dur_ms", "ok")


def stored(spark, sf):
    e = tables.entries(spark, sf)
    name = F.concat(F.lit("book_"), F.col("book_id").cast("string"))
    store = e.filter("book_id % 3 = 0").select(name.alias("script_name"), "pos", "speaker", "text", "instruct")
    current = e.filter("book_id % 6 = 0 AND pos < 3").select(F.concat(F.lit(" Book "), F.col("book_id").cast("string"), F.lit("! ")).alias("script_name"), "pos", "speaker", "text", "instruct")
    configs = tables.table(spark, sf, "documents").filter("doc_id % 2 = 0").select(F.concat(F.lit("book_"), F.col("doc_id").cast("string")).alias("script_name"), F.lit("Bob").alias("speaker"), F.lit("clone").alias("type"))
    return projects.save_scripts(store, current), configs


def script_store(spark, sf):
    return projects.script_list(*stored(spark, sf))


def script_load(spark, sf):
    d = tables.table(spark, sf, "documents").select(F.col("doc_id").alias("book_id"), F.concat(F.lit("book_"), F.col("doc_id").cast("string")).alias("script_name"))
    now = d.select("book_id", F.lit("Ann").alias("speaker"), F.lit("custom").alias("type"))
    entries, config = projects.load_script(*stored(spark, sf), d.filter("book_id % 4 < 2"), now.filter("book_id % 4 < 2"))
    n = entries.groupBy("book_id").agg(F.count("*").alias("n_entries"))
    return config.join(n, "book_id", "left").select("book_id", "speaker", "type", F.coalesce("n_entries", F.lit(0)).alias("n_entries"))


def builder_names(spark, sf):
    r, n = tables.table(spark, sf, "region"), tables.table(spark, sf, "nation")
    old = r.select(T.project_name(F.col("r_name")).alias("name"), F.lit("old").alias("description"), F.lit("5").alias("global_seed"))
    asked = r.select(F.concat("r_name", F.lit("!")).alias("name")).unionByName(n.select(F.concat(F.lit(" "), "n_name", F.lit("?")).alias("name"))).unionByName(spark.createDataFrame([("!!!",)], "name string"))
    return projects.create_projects(old, asked)


def builder_create(spark, sf):
    return builder_names(spark, sf)[1]


def builder_meta(spark, sf):
    change = tables.table(spark, sf, "nation").filter("n_nationkey % 2 = 0").select(T.project_name(F.col("n_name")).alias("name"), F.concat(F.lit("voice "), F.col("n_nationkey").cast("string")).alias("description"), F.lit("9").alias("global_seed"))
    return projects.update_meta(builder_names(spark, sf)[0], change)


def saving(spark, sf):
    s = tables.samples(spark, sf)
    names = s.select("name").distinct()
    asked = names.unionByName(spark.createDataFrame([("nobody",)], "name string")).withColumn("ref_index", F.lit(20).cast("long"))
    return projects.save_datasets(s, asked, names.filter(F.length("name") % 3 == 0))


def dataset_save(spark, sf):
    return saving(spark, sf)[1].select("name", "outcome", "sample_count", "ref_idx", "ref_text")


def dataset_metadata(spark, sf):
    return saving(spark, sf)[0]


def export_files(spark, sf):
    return projects.export_files(timeline.timeline(timeline.for_labels(tables.rendered(tables.entries(spark, sf)))))


def config_defaults(spark, sf):
    c, kind = tables.table(spark, sf, "customer"), F.col("c_custkey") % 5
    made = F.when(kind == 1, '{"prompts":{"system_prompt":"own","user_prompt":""}}').when(kind == 2, '{"llm":{"base_url":"x"}}').when(kind == 3, '{"prompts":{"system_prompt":"a","user_prompt":"b"}}').when(kind == 4, '{"prompts":{},"tts":{"mode":"local"}}')
    got = c.select("c_custkey", prompts.with_defaults(made, F.lit("S"), F.lit("U")).alias("x"))
    return got.select("c_custkey", F.col("x.llm.base_url").alias("base_url"), F.col("x.tts.mode").alias("mode"), F.col("x.prompts.system_prompt").alias("system_prompt"), F.col("x.prompts.user_prompt").alias("user_prompt"))


def optional_fields(spark, sf):
    p, size = tables.table(spark, sf, "part"), F.col("p_size")
    given = prompts.optional_fields(top_k=F.when(size % 3 > 0, size), min_p=F.when(size % 2 == 0, F.lit("0")), banned_tokens=F.when(size % 5 == 0, F.lit("[]")).otherwise(F.lit("[7]")))
    pairs = F.transform(F.map_entries(given), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return p.select("p_partkey", F.array_join(F.array_sort(pairs), " ").alias("fields"))


def chunks_loaded(spark, sf):
    t = tables.listed(spark, sf)
    first = t.filter("id < 2").groupBy("book_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("id", "speaker", "text", "instruct", F.lit("done").alias("status"), "audio_path")))).alias("saved"))
    kept = F.when(F.col("book_id") % 3 == 0, F.col("saved")).when(F.col("book_id") % 3 == 1, F.substring("saved", F.lit(1), F.length("saved") - 5))
    return chunks.loaded(first.select("book_id", kept.alias("saved")), t)


def chunks_with_audio(spark, sf):
    there = spark.range(0, 40, 4).select(F.concat(F.lit("a/"), F.col("id").cast("string")).alias("path"))
    return chunks.with_audio(tables.listed(spark, sf), there).select("book_id", "id", "audio_path")


def chunks_reset(spark, sf):
    return chunks.reset(tables.listed(spark, sf), tables.table(spark, sf, "documents").filter("doc_id % 3 > 0").select(F.col("doc_id").alias("book_id"))).select("book_id", "id", "status")


def adapter_delete(spark, sf):
    own = tables.table(spark, sf, "supplier").select(F.concat(F.lit("a"), F.col("s_suppkey").cast("string")).alias("id"))
    builtin = tables.table(spark, sf, "nation").select(F.concat(F.lit("a"), F.col("n_nationkey").cast("string")).alias("id"))
    asked = tables.table(spark, sf, "part").filter("p_partkey % 2 = 0").select(F.concat(F.lit("a"), F.col("p_partkey").cast("string")).alias("id"))
    return voices.deleted(builtin, own.join(builtin, "id", "left_anti"), asked)[1]


def total_changes(spark, sf):
    b = script.batches(tables.entries(spark, sf))
    totals = script.review_totals(script.review_stats(b, tables.corrected(b)))
    return script.total_changes(totals, script.narrator_merges(script.merged_narration(tables.entries(spark, sf))))


def scripts_of(spark, sf):
    """One script for each conversation."""
    return tables.table(spark, sf, "conversations").select(F.col("conv_id").alias("book_id"), F.col("turn").alias("pos"), F.col("role").alias("speaker"), "text", F.lit("é").alias("instruct"))


def one_file_each(spark, rows, label):
    path = new_path(spark, label)
    files.write_single(rows, path)
    return path


def script_files(spark, sf):
    path = one_file_each(spark, files.script_array(scripts_of(spark, sf)), "scripts")
    return files.read_scripts(spark, path, "speaker string, text string, instruct string").select(F.col("pos").cast("long").alias("pos"), "speaker", "text", "instruct")


def book_files(spark, sf):
    lines = F.array_sort(F.collect_list(F.struct("pos", "text")))
    made = scripts_of(spark, sf).groupBy("book_id").agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("content"))
    # The text sink ends a file with a line break.
    return files.read_books(spark, one_file_each(spark, made, "books")).select(F.rtrim(F.col("text"), F.lit("\n")).alias("text"))


def jsonl_files(spark, sf):
    c = tables.table(spark, sf, "conversations")
    name = F.format_string("%d_%d.wav", "conv_id", "turn")
    path = new_path(spark, "metadata")
    files.write_jsonl(c.select(F.when(F.col("turn") % 2 == 0, name).alias("audio_filepath"), F.when(F.col("turn") % 2 == 1, name).alias("audio"), "text"), path)
    return files.read_jsonl(spark, path, "audio_filepath string, audio string, text string").select("audio_filepath", "text")


def jsonl_count(spark, sf):
    path = new_path(spark, "metadata")
    files.write_jsonl(tables.table(spark, sf, "conversations").select("text"), path)
    return files.count_jsonl(spark, path).agg(F.sum("n").alias("n"))


def log_appended(spark, sf):
    e, path = tables.table(spark, sf, "events"), new_path(spark, "log")
    for part in range(3):
        files.append_log(e.filter(F.col("event_id") % 3 == part).select(F.col("event_type").alias("task"), F.col("event_id").alias("seq"), F.col("props").alias("line")), path)
    return spark.read.schema("task string, seq long, line string").json(path)


def script_listing(spark, sf):
    n = tables.table(spark, sf, "nation")
    names = n.select(F.concat("n_name", F.lit(".json")).alias("name")).unionByName(n.filter("n_regionkey = 1").select(F.concat("n_name", F.lit(".voice_config.json")).alias("name"))).unionByName(n.select(F.concat("n_name", F.lit(".wav")).alias("name")))
    return files.saved_scripts(names).select("name", "script", "has_voice_config")


def prompt_files(spark, sf):
    p = tables.table(spark, sf, "part")
    parts = files.prompt_parts(F.concat(F.lit(" "), "p_name", F.lit("\n---SEPARATOR---\n"), "p_type", F.lit("\n")))
    return p.select("p_partkey", parts.alias("x")).select("p_partkey", "x.system", "x.user")


def requested_samples(spark, sf):
    c = tables.table(spark, sf, "conversations")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("emotion"), F.when(x["turn"] % 5 == 4, " ").otherwise(F.concat(F.lit(" "), x["text"])).alias("text")))
    asked = c.groupBy("conv_id").agg(rows.alias("all")).select(F.col("conv_id").cast("string").alias("name"), F.when(F.col("conv_id") % 2 == 0, F.col("all")).alias("samples"), F.transform("all", lambda x: x["text"]).alias("texts"))
    return dataset.requested_samples(asked)


def reference_audio(spark, sf):
    d = tables.table(spark, sf, "documents")
    audio = F.when(F.col("doc_id") % 50 == 7, F.lit("ref.wav")).otherwise(F.format_string("s%d.wav", "doc_id"))
    return dataset.reference_audio(d.select(F.col("lang").alias("name"), F.col("doc_id").alias("pos"), audio.alias("audio"), F.when((F.col("doc_id") % 2 == 1) & F.col("lang").isin("en", "de"), F.lit("own.wav")).alias("ref_audio"))).withColumnRenamed("reference", "ref_audio")


def dataset_prepared(spark, sf):
    d = tables.table(spark, sf, "documents")
    audio = F.when(F.col("doc_id") % 50 == 7, F.lit("ref.wav")).otherwise(F.format_string("s%d.wav", "doc_id"))
    rows = d.select(F.col("source").alias("name"), F.col("doc_id").alias("pos"), audio.alias("audio"), "text", (F.col("n_chars") / 15.0).alias("duration"), F.lit("").alias("ref_audio"))
    return dataset.prepared(rows).select("name", "pos", "audio", "duration", "ref_audio")


def dataset_ingest(spark, sf):
    c, kind = tables.table(spark, sf, "conversations"), F.col("conv_id") % 4
    path = F.when(kind == 0, "metadata.jsonl").when(kind == 1, "top/metadata.jsonl").when(kind == 2, "top/deep/metadata.jsonl").otherwise("notes.txt")
    return dataset.ingested(c.select(F.col("conv_id").alias("dataset"), path.alias("path"), F.when(F.col("turn") % 3 == 1, " ").otherwise(F.col("text")).alias("line")))


def pretty_scripts(spark, sf):
    return files.pretty_script_array(scripts_of(spark, sf))


def stamped_ids(spark, sf):
    return tables.table(spark, sf, "events").select("event_id", T.stamped(F.concat(F.lit("My "), "event_type"), F.col("event_id") + 1700000000).alias("id"))


def script_delete(spark, sf):
    store, configs = stored(spark, sf)
    gone = tables.table(spark, sf, "documents").filter("doc_id % 9 = 0").select(F.concat(F.lit("book_"), F.col("doc_id").cast("string")).alias("script_name"))
    return projects.script_list(projects.delete_named(store, gone), projects.delete_named(configs, gone))


def builder_delete(spark, sf):
    gone = tables.table(spark, sf, "nation").filter("n_nationkey % 2 = 0").select(T.project_name(F.col("n_name")).alias("name"))
    return projects.delete_named(builder_names(spark, sf)[0], gone, "name")


def point_lookup(spark, sf):
    return voices.first_match(tables.table(spark, sf, "customer"), "c_mktsegment", "BUILDING", "c_custkey").select("c_custkey", "c_name")


def scalar_rules(spark, sf):
    p, key = tables.table(spark, sf, "part"), F.col("p_partkey")
    path = F.when(key % 2 == 0, F.concat(F.lit("/abs/"), "p_name")).otherwise(F.col("p_name"))
    size = F.col("p_size").cast("double")
    blank = F.transform(F.sequence(F.lit(1), (F.col("p_size") % 4 + 1).cast("int")), lambda x: x.cast("string"))
    return p.select(
        "p_partkey", T.filled("a {x} b {y} {x}", x=F.col("p_name"), y=F.lit("{x}")).alias("filled"), T.resolved_path("/root/", path).alias("path"),
        T.stem_of(F.concat("p_name", F.lit(".voice_config.json")), ".voice_config.json").alias("stem"), T.stem_of(F.concat(F.lit("v1.2."), "p_brand", F.lit(".wav"))).alias("last_stem"),
        F.round(dataset.combined_loss(size, size / 4), 6).alias("loss"), F.round(render.real_time_factor(size, size % 7), 6).alias("speed"),
        F.array_join(dataset.padded(blank, F.lit(3), F.lit("-")), ",").alias("padded"), dataset.sample_description(F.lit("calm"), F.when(key % 3 > 0, F.col("p_type"))).alias("description"),
        render.item_limit(F.col("p_size") % 9, F.col("p_size") % 4).cast("long").alias("most_items"), T.entry_json(F.concat(F.lit('"é\\'), "p_name"), F.lit("a\nb\tc"), F.lit(None)).alias("entry"),
    )


def json_salvage(spark, sf):
    c = tables.table(spark, sf, "conversations")
    said = F.concat(F.lit('{"speaker": "'), "role", F.lit('", "text": "'))
    kind = F.expr("(conv_id + turn) % 4")
    made = (
        F.when(kind == 0, F.concat(F.lit("["), said, F.lit('line\nbreak\tand tab", "instruct": ""}]')))
        .when(kind == 1, F.concat(F.lit("["), said, F.lit('odd \\q \\"here\\"", "instruct": "x"}, nothing]')))
        .when(kind == 2, F.concat(F.lit("["), said, F.lit('one", "instruct": ""}, bad '), said, F.lit('two", "instruct": ""}]')))
        .otherwise(F.concat(F.lit("[{"), F.lit('"text": "b", "speaker": "A"}, {"text": ]')))
    )
    r = c.select("conv_id", "turn", jsonfix.entries_of(made).alias("r"))
    return r.select("conv_id", "turn", "r.how", F.array_join(F.transform("r.entries", lambda e: e["text"]), "|").alias("texts"))


ALL = (
    render_calls,
    generation_prompts, review_prompts, render_status, render_results, speech_durations, script_store, script_load, builder_create, builder_meta, dataset_save,
    dataset_metadata, export_files, config_defaults, optional_fields, chunks_loaded, chunks_with_audio, chunks_reset, adapter_delete, total_changes, script_files,
    book_files, jsonl_files, jsonl_count, log_appended, script_listing, prompt_files, requested_samples, reference_audio, point_lookup, scalar_rules, json_salvage,
    dataset_prepared, dataset_ingest, pretty_scripts, stamped_ids, script_delete, builder_delete,
)
