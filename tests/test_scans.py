"""Work by ranges against windows over whole books, and packing of any run against a fold."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.operators import packing, projects, scans, script, timeline
from storyloom.sources import scratch

ENTRY = "book_id long, pos long, speaker string, text string, instruct string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def entries(seed):
    rng = random.Random(seed)
    out = []
    for book, n in ((1, 400), (2, 1), (None, 60), (3, 90)):
        who, style = "A", ""
        for i in range(n):
            if rng.random() < (0.02 if book == 1 else 0.3):
                who, style = rng.choice(["A", "NARRATOR", "B", None]), rng.choice(["", "calm", None])
            text = rng.choice(["", None, "CHAPTER 1", "x" * 700 + "."]) if rng.random() < 0.04 else "y" * rng.choice([0, 3, 50, 90, 200]) + "."
            out.append((book, i if rng.random() < 0.95 else i + 1, who, text, style))
    return out


@pytest.mark.parametrize(("seed", "range_rows"), [(1, 7), (2, 60), (3, 1 << 20)])
def test_packing_by_ranges_equals_packing_by_books(spark, seed, range_rows):
    df = spark.createDataFrame(entries(seed), ENTRY).repartition(3)
    for long, short in ((script.long_render_chunks, script.render_chunks), (script.long_merged_narration, script.merged_narration)):
        want = short(df)
        assert rows(long(df, range_rows=range_rows).select(*want.columns)) == rows(want)


def test_one_run_of_very_many_entries(spark):
    n = 200_000
    df = spark.range(n).select(F.lit(None).cast("long").alias("book_id"), F.col("id").alias("pos"), F.lit("A").alias("speaker"), F.concat(F.repeat(F.lit("z"), (F.col("id") * 7919 % 120).cast("int")), F.lit(".")).alias("text"), F.lit("").alias("instruct"))
    df = df.withColumn("text", F.concat(F.lit("A long line that is no title, told. "), F.repeat(F.lit("z"), F.lit(60)), "text"))
    got = script.long_render_chunks(df, range_rows=20_000)
    lengths = [len("A long line that is no title, told. ") + 60 + i * 7919 % 120 + 1 for i in range(n)]
    begins, total = [], None
    for i, x in enumerate(lengths):
        if total is None or total + 1 + x > 500:
            begins.append(i)
            total = x
        else:
            total += 1 + x
    assert [r.pos for r in got.orderBy("id").select("pos").collect()] == begins


def test_effects_are_those_of_a_fold():
    rng = random.Random(6)
    for _ in range(200):
        cap, size = rng.randint(0, 12), rng.randint(1, 12)
        n, hard = np.array([rng.randint(0, 14) for _ in range(size)]), np.array([rng.random() < 0.2 for _ in range(size)])
        f = packing.effect(n, hard, cap)
        for opened in range(cap + 2):
            total, flags = opened, []
            for x, h in zip(n.tolist(), hard.tolist(), strict=True):
                new = h or total + 1 + x > cap
                total = min(x if new else total + 1 + x, cap + 1)
                flags.append(new)
            assert f[opened] == total and packing.starts(n, hard, cap, opened).tolist() == flags


@pytest.mark.parametrize("range_rows", [5, 1 << 20])
def test_timelines_by_ranges(spark, range_rows):
    rng = random.Random(8)
    spoken = [(b, i, rng.choice("ABC"), f"t{i}", rng.choice([None, 0, 100, 250])) for b, n in ((1, 80), (None, 20), (2, 1)) for i in range(n)]
    df = spark.createDataFrame(spoken, "book_id long, id long, speaker string, text string, dur_ms long").repartition(3)
    long, short = timeline.long_timeline(df, range_rows), timeline.timeline(df)
    assert rows(long.select(*short.columns)) == rows(short)
    a, b = timeline.long_tracks(long), timeline.tracks(short)
    assert rows(a.select(*b.columns)) == rows(b)


def test_sums_and_earlier_rows(spark):
    df = spark.createDataFrame([(k, i, i * i) for i in range(40) for k in ("x", None)], "k string, i long, v long")
    placed = scans.dealt(df, "i", range_rows=9)
    got = scans.earlier(scans.running(placed, ["k"], F.col("v"), "s"), ["k"], F.col("v"), "e")
    assert placed.select("range").distinct().count() > 4
    assert {(r.k, r.i): (r.s, r.e and r.e.v) for r in got.collect()} == {(k, i): (sum(j * j for j in range(i + 1)), None if i == 0 else (i - 1) ** 2) for i in range(40) for k in ("x", None)}
    same = spark.range(5000).select(F.lit(1).alias("one"))
    assert scans.dealt(same, "one", range_rows=500).groupBy("range").count().agg(F.max("count")).first()[0] < 2500


def test_empty(spark):
    none = spark.createDataFrame([], ENTRY)
    assert script.long_render_chunks(none).count() == 0 and script.long_merged_narration(none).count() == 0
    assert timeline.long_timeline(spark.createDataFrame([], "book_id long, id long, speaker string, text string, dur_ms long")).count() == 0


def test_texts_are_dealt_once_to_ranges_and_once_to_groups(spark):
    df = spark.createDataFrame(entries(4), ENTRY)
    for long in (script.long_render_chunks, script.long_merged_narration):
        before = len(scratch._written)
        plan = long(df, range_rows=60)._jdf.queryExecution().optimizedPlan().toString()
        written = [p for p in scratch._written[before:] if "/dealt-" in p or "/ranked-" in p]
        assert len(written) == 1 and not any("Join" in line and "place" in line.split("Join")[1] for line in plan.splitlines())


@pytest.mark.parametrize(("speech", "narration"), [(40, 40), (40, 1), (0, 40), (40, 0)])
def test_entries_that_are_never_joined_are_not_dealt_to_groups(spark, speech, narration):
    # Stretches of either kind are longer than a range, and some places are repeated.
    kinds = [who for _ in range(3) for who, n in (("A", speech), ("NARRATOR", narration)) for _ in range(n)]
    told = [(b, i - i % 9 // 8, who, f"{'y' * (i * 7 % 90)} told.", "") for b in (1, None) for i, who in enumerate(kinds)]
    df = spark.createDataFrame(told, ENTRY).repartition(3)
    got, want = script.long_merged_narration(df, range_rows=6), script.merged_narration(df)
    assert rows(got.select(*want.columns)) == rows(want)
    plan = got._jdf.queryExecution().optimizedPlan()
    assert plan.nodeName() == "Union"
    dealt, alone = (plan.children().apply(i).toString() for i in range(2))
    assert not any(step in alone for step in ("Window", "Aggregate", "Join", "Repartition", "Sort"))
    assert [sum("Filter" in line and "NOT open" in line for line in side.splitlines()) for side in (dealt, alone)] == [1, 1]


def test_the_row_before_in_the_whole_order(spark):
    df = spark.createDataFrame([(k, i, None if i % 5 == 0 else i) for k, n in (("x", 25), (None, 17), ("y", 1)) for i in range(n)], "k string, i long, v long")
    placed = scans.dealt(df, "k", "i", range_rows=4)
    a, b = (rows(f.select("k", "i", "e")) for f in (scans.preceding(placed, "k", F.col("v"), "e"), scans.earlier(placed, ["k"], F.col("v"), "e")))
    assert a == b and placed.select("range").distinct().count() > 6


def test_an_export_deals_no_more_text_than_its_labels_show(spark):
    spoken = [(1, i, "A", "é" * n, 100) for i, n in enumerate((0, 79, 80, 81, 500))] + [(2, 0, "B", None, 100)]
    df = spark.createDataFrame(spoken, "book_id long, id long, speaker string, text string, dur_ms long")
    cut = timeline.for_labels(df)
    assert max(len(r.text or "") for r in cut.collect()) == 80
    a, b = (rows(projects.export_files(timeline.timeline(t))) for t in (cut, df))
    assert a == b and len(a) == 6
