"""Archives, wave headers, listings and manifests on real files."""

import io
import os
import wave
import zipfile

import pytest
from pyspark.sql import functions as F

from storyloom.sources import archives, audio, files, scratch


def test_archives_round_trip(spark, tmp_path):
    rows = [("a", "voices/é.txt", "Ünï\n" * 500), ("a", "metadata.jsonl", '{"text": "x"}\n\n{"text": "y"}'), ("b", "in/metadata.jsonl", '{"text": "z"}'), ("b", "in/deep/metadata.jsonl", "{}"), ("b", "empty", None)]
    made = archives.archives(spark.createDataFrame(rows, "project string, name string, content string"), "project").collect()
    for r in made:
        (tmp_path / f"{r.project}.zip").write_bytes(bytes(r.archive))
    (tmp_path / "no.zip").write_text("no archive")
    whole = bytearray((tmp_path / "a.zip").read_bytes())
    spot = zipfile.ZipFile(io.BytesIO(bytes(whole))).getinfo("voices/é.txt").header_offset + 60
    whole[spot : spot + 4] = b"\xff\xff\xff\xff"
    (tmp_path / "damaged.zip").write_bytes(bytes(whole))
    found = archives.members(spark, str(tmp_path)).cache()
    got = {(os.path.basename(r.path), r.name): (r.content and bytes(r.content), r.error is None) for r in found.collect()}
    for project, name, content in rows:
        assert got[f"{project}.zip", name] == ((content or "").encode(), True)
    assert got["no.zip", None][1] is False and got["damaged.zip", "voices/é.txt"] == (None, False)
    assert got["damaged.zip", "metadata.jsonl"][1] and len(got) == 8
    lines = {(os.path.basename(r.path), r.name, r.line) for r in archives.metadata(found).collect()}
    assert lines == {(z, "metadata.jsonl", f'{{"text": "{t}"}}') for z in ("a.zip", "damaged.zip") for t in "xy"} | {("b.zip", "in/metadata.jsonl", '{"text": "z"}')}
    assert {r.name for r in archives.members(spark, str(tmp_path), "b.zip", ".jsonl").collect()} == {"in/metadata.jsonl", "in/deep/metadata.jsonl"}


def test_equal_files_are_equal_archives(spark):
    rows = spark.createDataFrame([(1, f"n{i}", f"c{i}") for i in range(9)], "k long, name string, content string")
    a, b = (archives.archives(rows.repartition(n), "k").first().archive for n in (1, 5))
    assert a == b


def test_durations_of_waves(spark, tmp_path):
    want = {}
    for name, rate, frames, channels in (("one", 24000, 24000, 1), ("two", 44100, 12345, 2), ("none", 8000, 0, 1)):
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as w:
            w.setnchannels(channels)
            w.setsampwidth(2)
            w.setframerate(rate)
            w.writeframes(b"\0" * frames * 2 * channels)
        want[f"{name}.wav"] = frames * 1000 // rate
    (tmp_path / "no.wav").write_bytes(b"RIFX")
    (tmp_path / "cut.wav").write_bytes((tmp_path / "one.wav").read_bytes()[:30])
    got = {os.path.basename(r.path): r.dur_ms for r in audio.durations(spark, str(tmp_path)).collect()}
    assert got == want | {"no.wav": None, "cut.wav": None}


def test_listings(spark, tmp_path):
    for n, name in enumerate(["b/x.json", "a/y.json", "a/z.wav", "top.json"]):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("[]" * (n + 1))
        os.utime(tmp_path / name, (1_700_000_000 + n, 1_700_000_000 + n))
    listed = [r.name for r in files.list_files(spark, str(tmp_path)).collect()]
    assert listed == ["top.json", "z.wav", "y.json", "x.json"]
    assert [(r.folder, r.n_files, r.bytes) for r in files.list_folders(spark, f"file://{tmp_path}").orderBy("rank").collect()] == [("a", 2, 10), ("b", 1, 2)]


def test_manifests_that_are_missing_or_broken(spark, tmp_path):
    schema = "id string, n long"
    assert files.read_manifest(spark, str(tmp_path / "none.json"), schema).count() == 0
    (tmp_path / "broken.json").write_text('{"id": "a"')
    (tmp_path / "cut.json").write_text('[{"id": "a", "n": 1}, {"id"')
    (tmp_path / "good.json").write_text(' [{"id": "a", "n": 1}, {"id": "b"}]')
    assert files.read_manifest(spark, str(tmp_path / "broken.json"), schema).count() == 0
    assert [(r.pos, r.id, r.n) for r in files.read_manifest(spark, str(tmp_path / "good.json"), schema).collect()] == [(0, "a", 1), (1, "b", None)]
    assert files.read_manifest(spark, str(tmp_path / "cut.json"), schema).filter(F.col("id") == "b").count() == 0


def test_prompt_files_of_other_than_two_parts(spark):
    one = spark.createDataFrame([("a---SEPARATOR---b",)], "t string").select(files.prompt_parts(F.col("t")).alias("p")).first().p
    assert (one.system, one.user) == ("a", "b")
    bad = spark.createDataFrame([("a",)], "t string").select(files.prompt_parts(F.col("t")).alias("p"))
    try:
        bad.collect()
    except Exception as e:
        assert "exactly two parts" in str(e)
    else:
        raise AssertionError("no error")


def test_tables_of_a_block_are_deleted_with_it(spark):
    rows = spark.range(3)
    outside = scratch.saved(rows, "outside")
    with pytest.raises(RuntimeError), scratch.temporary(spark):
        scratch.saved(rows, "one")
        with scratch.temporary(spark):
            scratch.saved(rows, "inner")
        kept = scratch.new_path(spark, "two")
        rows.write.parquet(kept)
        assert scratch.exists(spark, kept)
        raise RuntimeError
    assert not scratch.exists(spark, kept) and outside.count() == 3
    left = os.listdir(scratch.shared_dir(spark).removeprefix("file://"))
    assert not [x for x in left if x.startswith(("one-", "inner-", "two-"))]


def test_a_key_with_much_content_has_several_archives(spark):
    rows = [(k, f"{i:03}.txt", "x" * (i % 7 * 100)) for k, n in (("a", 200), ("b", 3), (None, 60)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, name string, content string").repartition(3)
    made = archives.archives(df, "k", volume=2000)
    n = {k: sum(r.k == k for r in made.select("k").collect()) for k in ("a", "b", None)}
    assert n["b"] == 1 and n["a"] > n[None] > 5 and max(len(bytes(r.archive)) for r in made.collect()) < 20_000
    found = archives.unpacked(made.select(F.coalesce("k", F.lit("-")).alias("path"), F.col("archive").alias("content")))
    assert sorted((r.path, r.name, bytes(r.content).decode()) for r in found.collect()) == sorted((k or "-", *x) for k, *x in rows)
