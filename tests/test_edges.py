"""Script queries and operators on empty tables, nulls, repeated places and long runs."""

import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from storyloom.operators import chunks, fold, projects, prompts, render, script, timeline, voices
from storyloom.plans import script_queries

SF = "/root/testdata/sf0.001"
ENTRY = "book_id long, pos long, speaker string, text string, instruct string"
CHUNK = "book_id long, id long, speaker string, text string, instruct string, status string, audio_path string"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()

#: Queries with rows of their own besides those of the tables.
OWN_ROWS = {"voice_upsert", "builder_create", "dataset_save", "jsonl_count"}


@pytest.fixture(scope="module")
def empty_tables(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('empty')}"
    for t in TABLES:
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{folder}/{t}.parquet")
    return folder


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("names", [sorted(script_queries.queries())[k::8] for k in range(8)])
def test_empty_tables(spark, empty_tables, names):
    for name in names:
        df = script_queries.queries()[name](spark, empty_tables)
        assert df.columns and (df.count() == 0 or name in OWN_ROWS), name


def test_packing_of_a_long_run_equals_plain_packing(spark):
    rng = random.Random(9)
    sizes = [rng.randint(0, 300) for _ in range(3000)]
    rows = spark.createDataFrame([(sizes,), ([],), ([7],)], "s array<int>")
    got = [r.g for r in rows.select(fold.capped_starts(F.col("s"), 500).alias("g")).collect()]
    want, total = [], None
    for i, n in enumerate(sizes):
        if total is None or total + 1 + n > 500:
            want.append(i)
            total = n
        else:
            total += 1 + n
    assert got == [want, [], [0]] and len(sizes) > 10 * fold.BLOCK


def test_null_texts_and_speakers(spark):
    rows = [(1, 0, None, None, None), (1, 1, None, None, None), (1, 2, "Ann", "It is so.", None), (1, 3, "Ann", "It was so.", None), (None, 0, "Bo", "x.", "y")]
    df = spark.createDataFrame(rows, ENTRY)
    got = {(r.book_id, r.id): r.text for r in script.render_chunks(df).collect()}
    assert got == {(1, 0): "", (1, 1): "", (1, 2): "It is so. It was so.", (None, 0): "x."}
    assert script.speakers(df).count() == 2 and script.merged_narration(df).count() == 5
    assert render.sub_batches(df.withColumn("id", F.col("pos")), "book_id").count() == 5
    assert timeline.timeline(df.select("book_id", F.col("pos").alias("id"), "speaker", "text", F.lit(None).cast("long").alias("dur_ms"))).count() == 0


def test_repeated_places(spark):
    """Entries of one place keep an order by their other columns, and none is lost."""
    rows = [(1, 0, "A", "b.", ""), (1, 0, "A", "a.", ""), (1, 1, "A", "c.", "")]
    got = script.render_chunks(spark.createDataFrame(rows, ENTRY)).collect()
    assert sum(len(r.text.split()) for r in got) == 3
    config = spark.createDataFrame([("A", "clone"), ("B", None)], "speaker string, type string")
    routed = voices.with_config(spark.createDataFrame([("A",), ("A",), ("C",), (None,)], "speaker string"), config)
    assert routed.count() == 4


def test_prompts_of_parts_without_entries(spark):
    parts = spark.createDataFrame([(1, 0, "one"), (1, 1, "two"), (1, 2, None), (2, 0, "only")], "book_id long, chunk_no long, text string")
    entries = spark.createDataFrame([(1, 0, 0, "Zoë", 'say "hi"', "calm"), (1, 1, 0, "NARRATOR", "then", ""), (1, 2, 0, None, None, None), (1, 3, 0, "Al", "end", "")], "book_id long, pos long, chunk_no long, speaker string, text string, instruct string")
    got = {(r.book_id, r.chunk_no): r.prompt for r in prompts.generation_prompts(parts, entries, "{context}|{chunk}").collect()}
    tail = '\n\nPrevious section ended with:\n{"speaker": "NARRATOR", "text": "then", "instruct": ""}\n{"speaker": null, "text": null, "instruct": null}\n{"speaker": "Al", "text": "end", "instruct": ""}|'
    assert got[1, 0] == "(Beginning of text)|one" and got[2, 0] == "(Beginning of text)|only"
    assert got[1, 1] == "(Part 2 of 3)\nCharacters in this book: Al, Zoë" + tail + "two" and got[1, 2] == "(End of text)\nCharacters in this book: Al, Zoë" + tail
    batch = spark.createDataFrame([(1, 0, 0, "A", "é", "x")], "book_id long, batch_no long, idx long, speaker string, text string, instruct string")
    source = spark.createDataFrame([(1, 0, "book")], "book_id long, batch_no long, source string")
    assert prompts.review_prompts(batch, "{context}|{batch}", source).first().prompt == (
        'Batch 1 of 1.\n\nORIGINAL SOURCE TEXT (for reference):\nbook|[\n  {\n    "speaker": "A",\n    "text": "é",\n    "instruct": "x"\n  }\n]'
    )


def test_rendering_with_failures(spark):
    table = spark.createDataFrame([(1, i, s, t, "", "pending", None) for i, (s, t) in enumerate([("A", "one"), ("L", "two"), ("A", " "), ("B", "x" * 50), ("A", "bad")])], CHUNK)
    asked = spark.createDataFrame([(1, k, i) for k, i in enumerate([4, 3, 1, 0, 2, 9])], "book_id long, req_pos long, id long")
    config = spark.createDataFrame([("A", "clone", "v", None), ("L", "lora", None, "")], "speaker string, type string, voice string, adapter_id string")
    plan = render.render_plan(table, asked, config, 2)
    assert sorted((r.batch, r.id) for r in plan.collect()) == [(0, 3), (0, 4), (1, 0), (1, 1)]

    def voice(bad):
        def load(route, key):
            def call(lines):
                if bad == "raises" and (lines["text"] == "bad").any():
                    raise RuntimeError("no device")
                ms = lines["text"].str.len() * 60 * (lines["text"] != "bad")
                return pd.DataFrame({"dur_ms": ms, "mp3_bytes": ms * 16 - 2000})[: len(lines) - (bad == "short" and len(lines) == 1 and lines["text"].iloc[0] == "bad")]

            return call

        return load

    done = render.rendered(plan.repartition(1), voice("silent"))
    assert {r.id: (r.ok, r.error) for r in done.collect()} == {4: (False, "Audio has 0 duration"), 3: (True, None), 1: (False, "No adapter"), 0: (True, None)}
    status = {r.id: (r.status, r.audio_path) for r in render.render_status(table, done).collect()}
    assert status == {0: ("done", "voicelines/voiceline_0001_a.wav"), 1: ("error", None), 2: ("pending", None), 3: ("done", "voicelines/voiceline_0004_b.mp3"), 4: ("error", None)}
    for bad, error in (("raises", "Batch error: no device"), ("short", "Batch error: 1 lines gave 0 results")):
        assert {r.id: r.error for r in render.rendered(plan.repartition(1), voice(bad)).collect()} == {4: error, 3: None, 1: "No adapter", 0: None}


def test_calls_keep_voices_apart(spark, tmp_path):
    who = ["A", "B", "L", "M", "N", "C", "D"]
    table = spark.createDataFrame([(1, i, who[i % 7], "x" * (i + 1), "", "pending", None) for i in range(70)], CHUNK)
    asked = spark.createDataFrame([(1, i, i) for i in range(70)], "book_id long, req_pos long, id long")
    config = spark.createDataFrame([("A", "clone", None), ("B", "clone", None), ("L", "lora", "a1"), ("M", "builtin_lora", "a1"), ("N", "lora", "a2"), ("D", "design", None)], "speaker string, type string, adapter_id string")
    loads = tmp_path / "loads"

    def load(route, key):
        with open(loads, "a") as f:
            f.write(f"{os.getpid()} {key.split(':')[0] if route == 'design' else key}\n")

        def call(lines):
            if route == "clone" and lines["text"].str.len().max() > 60:
                raise RuntimeError(",".join(lines["speaker"]))
            return pd.DataFrame({"dur_ms": lines["text"].str.len(), "mp3_bytes": [len(lines)] * len(lines)})

        return call

    for by_voice in (False, True):
        plan = render.render_plan(table, asked, config, 35, by_voice, max_items=3).cache()
        subs = {}
        for r in plan.collect():
            subs.setdefault((r.book_id, r.batch, r.route, r.key, r.sub_no), []).append((r.idx, r.speaker, r.adapter, r.id))
        assert sum(len(x) for x in subs.values()) == 70 and max(len(x) for x in subs.values()) == 3
        for (_, batch, route, _, _), items in subs.items():
            assert route == "custom" or len({a if route == "lora" else s for _, s, a, _ in items}) == 1
            assert route != "design" or len(items) == 1
            assert [i for _, _, _, i in sorted(items)] == sorted(i for *_, i in items)
        assert any({s for _, s, _, _ in x} == {"L", "M"} for x in subs.values())
        done = {r.id: r for r in render.rendered(plan, load).collect()}
        broken = {frozenset(i for *_, i in x) for k, x in subs.items() if k[2] == "clone" and max(i for *_, i in x) >= 60}
        assert broken and {i for i, r in done.items() if not r.ok} == set().union(*broken)
        assert all(len(done[i].error.split("Batch error: ")[1].split(",")) == len(group) for group in broken for i in group)
    loads.write_text("")
    render.rendered(plan.filter("route = 'lora'").repartition(1), load).coalesce(1).count()
    assert sorted(x.split()[1] for x in loads.read_text().splitlines()) == ["lora:a1", "lora:a2"]


def test_saved_chunks_and_scripts(spark):
    fresh = spark.createDataFrame([(b, 0, "A", "new", "", "pending", None) for b in (1, 2, 3, 4)], CHUNK)
    books = spark.createDataFrame([(1, '[{"id":0,"speaker":"A","text":"old","status":"done"},{"id":1}]'), (2, '[{"id": 0, "tex'), (3, "[]"), (4, None)], "book_id long, saved string")
    assert sorted((r.book_id, r.id, r.text) for r in chunks.loaded(books, fresh).collect()) == [(1, 0, "old"), (1, 1, None), (2, 0, "new"), (3, 0, "new"), (4, 0, "new")]
    store = spark.createDataFrame([("a", 0, "S", "t", "")], "script_name string, pos long, speaker string, text string, instruct string")
    more = spark.createDataFrame([(" A! ", 0, "S", "u", ""), ("?", 0, "S", "lost", ""), ("b", 0, None, None, None)], store.schema)
    assert sorted(map(tuple, projects.save_scripts(store, more).select("script_name", "text").collect()), key=repr) == [("a", "u"), ("b", None)]


def test_built_in_adapters_stay(spark):
    names = lambda *x: spark.createDataFrame([(v,) for v in x], "id string")
    own, fate = voices.deleted(names("b1", "x"), names("o1", "o2"), names("b1", "o1", "none", "o1"))
    assert sorted(r.id for r in own.collect()) == ["o2"]
    assert sorted(map(tuple, fate.collect())) == [("b1", "forbidden"), ("none", "missing"), ("o1", "deleted")]


@pytest.mark.parametrize("at", [-1, 0, 2, 9, None])
def test_edits_of_books_without_chunks(spark, at):
    none = spark.createDataFrame([], CHUNK)
    edit = spark.createDataFrame([(1, at)], "book_id long, at long")
    assert chunks.insert_after(none, edit).count() == chunks.delete_at(none, edit).count() == 0
    back = spark.createDataFrame([(1, at, "S", "t", "", "done", None)], "book_id long, at long, speaker string, text string, instruct string, status string, audio_path string")
    if at is not None:
        assert [(r.book_id, r.id) for r in chunks.restore_at(none, back).collect()] == [(1, 0)]
