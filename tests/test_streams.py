"""Streams: what they leave equals the result over whole tables, after every batch and across a restart."""

import json
import os
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from storyloom.operators import models, render
from storyloom.plans import stream_queries
from storyloom.sources import scratch
from storyloom.streaming import progress, ring
from storyloom.streaming.render_jobs import REQUEST, RenderJob

CHUNK = "book_id long, id long, speaker string, text string, instruct string, status string, audio_path string"
LINES = 30


@pytest.fixture(scope="module")
def table(spark):
    rows = [(b, i, "ABL"[i % 3], "x" * (i + 1) if i % 5 else " ", "", "pending", "old" if i % 2 else None) for b in (1, 2) for i in range(LINES)]
    return spark.createDataFrame(rows, CHUNK).cache()


@pytest.fixture(scope="module")
def config(spark):
    return spark.createDataFrame([("A", "clone", None), ("L", "lora", "a1")], "speaker string, type string, adapter_id string").cache()


def write_requests(folder):
    folder.mkdir()
    for n, ids in enumerate(([3, 1, 0, 99], [2, 4, 3], [29, 28, 7, 8])):
        (folder / f"{n}.json").write_text("\n".join(json.dumps({"book_id": b, "req_pos": k, "id": i}) for b in (1, 2) for k, i in enumerate(ids)))
        os.utime(folder / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))


def counted(path):
    """Speech that notes every line; lines of eight characters break their call."""

    def load(route, key):
        def call(lines):
            with open(path, "a") as f:
                f.writelines(f"{t}\n" for t in lines["text"].str.len())
            if (lines["text"].str.len() == 8).any():
                raise RuntimeError("eight")
            return pd.DataFrame({"dur_ms": lines["text"].str.len() * 60, "mp3_bytes": 2000}, index=lines.index)

        return call

    return load


def test_a_restart_renders_nothing_twice(spark, table, config, tmp_path):
    write_requests(tmp_path / "requests")
    calls, log, mark = tmp_path / "calls", f"file://{tmp_path}/log", tmp_path / "mark"
    after = table.filter("NOT (book_id = 2 AND id = 29)")

    class Stopped(Exception):
        pass

    def reload():
        if not mark.exists() and calls.exists():
            mark.write_text("")
            raise Stopped("the driver is gone")
        return after

    job = RenderJob(spark, log, lambda: table, lambda: config, counted(calls), 2, limits={"max_items": 2}, reload=reload)
    run = lambda: job.start(str(tmp_path / "requests"), f"{log}/checkpoint").awaitTermination()
    with pytest.raises(PySparkException):
        run()
    first = sorted(calls.read_text().split())
    assert first and {r.status for r in job.statuses().collect()} == {"generating"}
    assert {r.status for r in job.current().filter("id in (1, 3)").collect()} == {"generating"} and job.progress().first().total == 4
    run()
    assert mark.exists()
    asked = [len("x" * (i + 1)) for ids in ([3, 1], [2, 4, 3], [29, 28, 7, 8]) for b in (1, 2) for i in ids if i % 5]
    assert sorted(calls.read_text().split()) == sorted(map(str, asked))
    got = {(r.book_id, r.id): (r.status, r.audio_path) for r in job.current().collect()}
    assert len(got) == 2 * LINES - 1 and got[1, 29] == ("done", "voicelines/voiceline_0030_l.mp3")
    assert got[1, 7][0] == "error" and got[1, 7][1] == "old" and got[1, 5] == ("pending", "old") and got[1, 3] == ("done", "voicelines/voiceline_0004_a.mp3")
    failed = {(r.book_id, r.id): r.error for r in job.failures().collect()}
    assert failed[2, 29] == "Index out of range after reload" and failed[1, 7] == "Batch error: eight" and (1, 29) not in failed
    p = job.progress().first()
    assert (p.completed + p.failed, p.total) == (p.total, len(asked)) and p.failed == len(failed)
    run()
    assert sorted(calls.read_text().split()) == sorted(map(str, asked))


def test_one_batch_equals_the_whole_table(spark, table, config, tmp_path):
    asked = spark.createDataFrame([(b, k, i) for b in (1, 2) for k, i in enumerate([5, 9, 8, 8, 1, 77])], REQUEST)
    job = RenderJob(spark, f"file://{tmp_path}/log", lambda: table, lambda: config, counted(tmp_path / "calls"), 3)
    assert job.statuses().count() == 0 and job.current().count() == 2 * LINES
    job.handle(asked, 0)
    plan = render.render_plan(table, asked, config, 3)
    want = render.render_status(table, render.rendered(plan, counted(tmp_path / "other")))
    assert sorted(map(tuple, job.current().collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def tail_of(lines, kept):
    by = defaultdict(list)
    for t, s, x in lines:
        if s is not None:
            by[t or ""].append((s, x))
    return {t: (len(x), sorted(x)[-kept:]) for t, x in by.items()}


def shown(spark, sink):
    out = defaultdict(list)
    for r in ring.latest(spark, sink).collect():
        out[r.task, r.n_lines].append((r.seq, r.line))
    return {t: (n, sorted(x)) for (t, n), x in out.items()}


def test_the_ring_is_the_tail_after_every_batch(spark, tmp_path):
    source, sink, check = tmp_path / "log", f"file://{tmp_path}/tails", f"file://{tmp_path}/check"
    source.mkdir()
    batches = [
        [("a", i, f"line {i}") for i in range(25)] + [("b", 1, "é")],
        [("a", i, f"line {i}") for i in range(30, 33)] + [("b", 2, "")],
        [("a", i, f"late {i}") for i in (27, 3)] + [("c", None, "no number"), (None, 5, "no task")],
    ]
    for n, lines in enumerate(batches):
        (source / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("task", "seq", "line"), x, strict=True))) for x in lines))
        ring.run_tails(spark, str(source), check, sink, kept=10).awaitTermination()
        so_far = [x for b in batches[: n + 1] for x in b]
        assert shown(spark, sink) == tail_of(so_far, 10)
    rows = spark.createDataFrame([x for b in batches for x in b if x[1] is not None], progress.LOG)
    want = {(r.task or "", r.seq, r.line) for r in progress.tail(rows, 10).collect()}
    assert {(r.task, r.seq, r.line) for r in ring.latest(spark, sink).collect()} == want
    ring.run_tails(spark, str(source), check, sink, kept=10).awaitTermination()
    assert shown(spark, sink) == tail_of([x for b in batches for x in b], 10)


def test_the_ring_with_a_time_to_live(spark, tmp_path):
    source, sink = tmp_path / "log", f"file://{tmp_path}/tails"
    source.mkdir()
    (source / "0.json").write_text(json.dumps({"task": "a", "seq": 1, "line": "x"}))
    ring.run_tails(spark, str(source), f"{sink}-check", sink, kept=2, ttl_ms=1).awaitTermination()
    (source / "1.json").write_text(json.dumps({"task": "a", "seq": 2, "line": "y"}))
    ring.run_tails(spark, str(source), f"{sink}-check", sink, kept=2, ttl_ms=1).awaitTermination()
    assert shown(spark, sink) == {"a": (1, [(2, "y")])}


def test_calls_of_lists_and_of_frames_are_alike(table, config, spark):
    asked = spark.createDataFrame([(b, k, i) for b in (1, 2) for k, i in enumerate([5, 9, 8, 7, 1, 12, 14])], REQUEST)
    plan = render.render_plan(table, asked, config, 3)

    def lists(route, key):
        @models.by_lists
        def call(lines):
            assert set(map(type, lines.values())) == {list}
            n = [len(t) for t in lines["text"]]
            if 8 in n:
                raise RuntimeError("eight")
            return {"dur_ms": [x * 60 for x in n], "mp3_bytes": [2000 if x != 15 else None for x in n][: len(n) - (9 in n)]}

        return call

    def frames(route, key):
        def call(lines):
            n = lines["text"].str.len()
            if (n == 8).any():
                raise RuntimeError("eight")
            return pd.DataFrame({"dur_ms": n * 60, "mp3_bytes": pd.Series(2000, index=n.index).where(n != 15)})[: len(n) - (n == 9).any()]

        return call

    a, b = ({(r.book_id, r.item): tuple(r) for r in render.performed(plan, m).collect()} for m in (lists, frames))
    assert a == b and {r[6] is None for r in a.values()} == {True, False} and any("results" in (r[6] or "") for r in a.values())


def test_a_plan_reads_the_chunks_once(spark, table, config):
    asked = spark.createDataFrame([(1, 0, 1)], REQUEST)
    plan = render.render_plan(table, asked, config, 3, by_voice=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2


def test_a_batch_is_planned_once(spark, table, config, tmp_path, monkeypatch):
    plans, plan = [], render.render_plan
    monkeypatch.setattr(render, "render_plan", lambda *a, **b: plans.append(1) or plan(*a, **b))
    RenderJob(spark, f"file://{tmp_path}/log", lambda: table, lambda: config).handle(spark.createDataFrame([(1, 0, 1)], REQUEST), 0)
    assert len(plans) == 1


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_requests_of_a_batch_are_many_files(spark):
    job = stream_queries.render_job(spark, "/root/testdata/sf0.001")
    path = next(p for p in reversed(scratch._written) if "/requests-" in p)
    files = spark.read.schema(REQUEST).json(path).select("book_id", F.input_file_name().alias("f")).distinct()
    assert files.select("f").distinct().count() > 3 * stream_queries.BATCHES and files.groupBy("book_id").count().filter("count > 1").count() == 0
    assert job.statuses().select("number").distinct().count() == stream_queries.BATCHES
