"""Script operators against plain Python written from their definitions, on seeded random inputs."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from storyloom.functions import jsonfix
from storyloom.functions import text as T
from storyloom.operators import chunks, dataset, render, script, timeline, voices
from storyloom.operators.models import answered, synthesised

ENTRY = "book_id long, pos long, speaker string, text string, instruct string"


def structural(t):
    t = t.strip()
    return not t or (len(t) < 80 and t[-1] not in ".!?")


def section(t):
    t = t.strip()
    return bool(re.match(r"(?i)chapter\b", t)) or (t == t.upper() and len(t) < 80 and t.isascii())


def packed(entries, joins, cap):
    out = []
    for e in entries:
        if out and joins(out[-1][-1], e) and len(" ".join(x[3] for x in out[-1])) + 1 + len(e[3]) <= cap:
            out[-1].append(e)
        else:
            out.append([e])
    return [(g[0][1], g[0][2], " ".join(x[3] for x in g)) for g in out]


def random_entries(seed):
    rng = random.Random(seed)
    texts = ["Chapter two", "THE END", "", "123", "A title", "It ended.", "é" * 79, "x" * 80, "y" * 81 + ".", "w " * 120 + "done.", "z" * 499 + ".", "q" * 600, " pad. ", "s" * 240 + "!", "s" * 258 + "?"]
    return [(1, i, rng.choice(["NARRATOR", "NARRATOR", "Ann"]), rng.choice(texts), rng.choice(["calm", "calm", ""])) for i in range(150)]


@pytest.mark.parametrize("seed", range(4))
def test_packing(spark, seed):
    rows = random_entries(seed)
    df = spark.createDataFrame(rows, ENTRY)
    want = packed(rows, lambda a, b: a[2] == b[2] and a[4] == b[4] and not structural(a[3]) and not structural(b[3]), 500)
    got = script.render_chunks(df).orderBy("id").collect()
    assert [(r.pos, r.speaker, r.text) for r in got] == want and [r.id for r in got] == list(range(len(got)))
    want = packed(rows, lambda a, b: a[2] == b[2] == "NARRATOR" and a[4] == b[4] and not section(a[3]) and not section(b[3]), 800)
    assert [(r.pos, r.speaker, r.text) for r in script.merged_narration(df).orderBy("pos").collect()] == want


def prompt_chunks(text, cap):
    out, cur = [], ""
    for p in (x.strip() for x in re.split(r"\n\s*\n", text)):
        if not p:
            continue
        if len(p) <= cap:
            pieces = [(p, "\n\n", len(cur) + len(p) + 2 > cap)]
        else:
            pieces = [(s, " ", k == 0) for k, s in enumerate(re.split(r"(?<=[.!?])\s+", p))]
        for s, joint, fresh in pieces:
            if cur and (fresh or len(cur) + len(s) + 1 > cap):
                out.append(cur.strip())
                cur = s
            else:
                cur = cur + joint + s if cur else s
    return out + [cur.strip()] if cur else out


def test_prompt_chunks(spark):
    rng = random.Random(2)
    sentence = lambda: "a" * rng.choice([1, 10, 48, 49, 50, 97, 98, 99, 100, 101, 150]) + rng.choice([".", "!", ""])
    books = [(i, rng.choice(["\n\n", "\n \n"]).join(" ".join(sentence() for _ in range(rng.randint(0, 4))) for _ in range(8))) for i in range(150)] + [(900, ""), (901, " \n\n ")]
    got = {}
    for r in script.prompt_chunks(spark.createDataFrame(books, "book_id long, text string"), 100).orderBy("book_id", "chunk_no").collect():
        got.setdefault(r.book_id, []).append(r.text)
    assert got == {i: c for i, t in books if (c := prompt_chunks(t, 100))}


def sub_batches(sizes, max_items):
    out = []
    for n in sorted(sizes):
        g = out[-1] if out else None
        if g is None or (max_items and len(g) >= max_items) or sum(g) + n > 3000 or (len(g) >= 4 and n > 5.0 * max(g[0], 1)):
            out.append([n])
        else:
            g.append(n)
    return out


@pytest.mark.parametrize("max_items", [None, 3])
def test_sub_batches(spark, max_items):
    rng = random.Random(4)
    sizes = {r: [rng.choice([0, 1, 5, 20, 300, 900, 3100]) for _ in range(rng.randint(1, 30))] for r in range(20)}
    df = spark.createDataFrame([(r, i, "x" * n) for r, ns in sizes.items() for i, n in enumerate(ns)], "req long, id long, text string")
    got = {}
    for x in render.sub_batches(df, "req", max_items=max_items).orderBy("req", "sub_no", "idx").collect():
        got.setdefault(x.req, {}).setdefault(x.sub_no, []).append(x.n_chars)
    assert {r: list(g.values()) for r, g in got.items()} == {r: sub_batches(ns, max_items) for r, ns in sizes.items()}
    assert render.sub_batches(df, "req", enabled=False).filter("sub_no > 0").count() == 0


OBJ = '{"speaker": "A", "text": "hi [there] \\"you\\"", "instruct": "calm"}'


@pytest.mark.parametrize(
    ("text", "how", "n"),
    [
        (f"[{OBJ}, {OBJ}]", "as_is", 2), (f"x <think>[1]</think> [{OBJ}]", "as_is", 1), (f"```json\n[{OBJ}]\n``` tail", "as_is", 1), (f"[{OBJ} {OBJ}]", "commas", 2),
        (f"[{OBJ}, {OBJ} ,\n]", "trailing", 2), (f"[{OBJ}, bad {OBJ}]", "objects", 2), (f"[{OBJ}, {OBJ[:-9]}", "as_is", 1), ("[]", "as_is", 0), ("{}", "none", 0), ("", "none", 0),
        (None, "none", 0), (f"[{OBJ.replace('hi', 'a' + chr(10) + 'b')}]", "as_is", 1), ("<thinking> never ends [1]", "none", 0),
        ('[{"speaker": "A", "text": "a\\q", "instruct": ""}, x]', "lenient", 1), (f"[{OBJ.replace('hi', 'long ' * 6000)}]", "as_is", 1), ('[{"text": "b", "speaker": "A"}, {"text": ]', "truncated", 1),
    ],
)
def test_json_repair(spark, text, how, n):
    row = spark.createDataFrame([(text,)], "t string").select(jsonfix.entries_of(F.col("t")).alias("r")).first().r
    assert (row.how, len(row.entries)) == (how, n)


def test_answers_take_the_first_good_attempt(spark):
    rows = [(1, 0, 0, "no"), (1, 0, 1, f"[{OBJ}]"), (1, 0, 2, f"[{OBJ},{OBJ}]"), (1, 1, 0, "no"), (1, 1, 3, f"[{OBJ}]")]
    got = {r.chunk_no: r for r in answered(spark.createDataFrame(rows, "book_id long, chunk_no long, attempt long, response string")).collect()}
    assert got[0].attempt == 1 and len(got[0].entries) == 1 and got[1].entries is None


def test_names_and_strip(spark):
    rows = [("É-a b!",), ("  A  B/c ",), ("",), ("\x1c x\x85\x1f",)]
    got = spark.createDataFrame(rows, "s string").select(T.file_stem(F.col("s")).alias("f"), T.project_name(F.col("s")).alias("p"), T.strip(F.col("s")).alias("t")).collect()
    assert [(r.f, r.p) for r in got][:3] == [("é-a_b_", "é-a_b"), ("__a__b_c_", "a_bc"), ("", "")]
    assert got[3].t == "x"


def test_filled_templates_are_not_filled_again(spark):
    df = spark.createDataFrame([("{chunk}", "c")], "a string, b string")
    assert df.select(T.filled("x {context} y {chunk}", context=F.col("a"), chunk=F.col("b")).alias("r")).first().r == "x {chunk} y c"


def test_timeline(spark):
    rows = [(1, 0, "A", "t", 100), (1, 1, "A", "t", None), (1, 2, "A", "t", 50), (1, 3, "B", "t", 0), (2, 0, "B", "t", 10)]
    line = timeline.timeline(spark.createDataFrame(rows, "book_id long, id long, speaker string, text string, dur_ms long"))
    assert [(r.book_id, r.id, r.start_ms, r.end_ms) for r in line.orderBy("book_id", "id").collect()] == [(1, 0, 0, 100), (1, 2, 350, 400), (1, 3, 900, 900), (2, 0, 0, 10)]
    assert [r.gap_ms for r in timeline.tracks(line).orderBy("book_id", "id").collect()] == [0, 250, 900, 0]
    assert timeline.label_lines(line).orderBy("book_id", "id").first().label == "0.000000\t0.100000\t[A] t"
    assert timeline.track_list(line).orderBy("book_id").first().content == 'file "a.wav"\nfile "b.wav"\n'


CHUNK = "book_id long, id long, speaker string, text string, instruct string, status string, audio_path string"


def test_edits(spark):
    rows = [(1, i, f"S{i}", f"t{i}", "", "done", f"p{i}") for i in range(3)] + [(2, 0, "only", "x", "", "done", None)]
    df = spark.createDataFrame(rows, CHUNK)
    at = lambda *p: spark.createDataFrame(list(p), "book_id long, at long")
    texts = lambda d, b=1: [r.text for r in d.filter(F.col("book_id") == b).orderBy("id").collect()]
    assert texts(chunks.insert_after(df, at((1, 1)))) == ["t0", "t1", "", "t2"]
    assert texts(chunks.insert_after(df, at((1, 3)))) == texts(chunks.delete_at(df, at((1, -1)))) == ["t0", "t1", "t2"]
    assert texts(chunks.delete_at(df, at((1, 0), (2, 0)))) == ["t1", "t2"] and texts(chunks.delete_at(df, at((2, 0))), 2) == ["x"]
    for place, want in ((-5, ["back", "t0", "t1", "t2"]), (99, ["t0", "t1", "t2", "back"])):
        back = spark.createDataFrame([(1, place, "B", "back", "", "done", None)], "book_id long, at long, speaker string, text string, instruct string, status string, audio_path string")
        got = chunks.restore_at(df, back)
        assert texts(got) == want and [r.id for r in got.filter("book_id = 1").orderBy("id").collect()] == [0, 1, 2, 3]
    new = spark.createDataFrame([(1, 0, {"text": None}), (1, 1, {})], "book_id long, id long, fields map<string,string>")
    got = {r.id: r for r in chunks.update_fields(df, new).filter("book_id = 1").collect()}
    assert got[0].text is None and got[0].status == "pending" and got[0].audio_path == "p0" and got[1].status == "done"


def test_seeds_and_descriptions(spark):
    df = spark.createDataFrame([([5, -1], 0, 9), ([5, -1], 1, 9), ([5, -1], 7, -1), (None, 0, None)], "s array<int>, i int, g int")
    assert [r.x for r in df.select(voices.resolved_seed(F.col("s"), F.col("i"), F.col("g")).alias("x")).collect()] == [5, 9, -1, -1]
    df = spark.createDataFrame([(" a ", "b"), (None, "b"), ("", None)], "b string, i string")
    assert [r.x for r in df.select(voices.design_description(F.col("b"), F.col("i")).alias("x")).collect()] == ["a, b", "b", voices.PLAIN_VOICE]


def test_samples_merge_and_losses(spark):
    req = spark.createDataFrame([("n", [("e", " a "), ("e", " ")], None), ("m", None, ["x", ""])], "name string, samples array<struct<emotion:string,text:string>>, texts array<string>")
    assert sorted(tuple(r) for r in dataset.requested_samples(req).collect()) == [("m", 0, "", "x"), ("n", 0, "e", "a")]
    steps = spark.createDataFrame([(0, 3.0), (0, None), (1, 2.0), (2, 2.5), (3, 2.0)], "epoch long, loss double")
    got = dataset.epoch_losses(steps.withColumn("run", F.lit(1)), "run").orderBy("epoch").collect()
    assert [(r.avg_loss, r.is_best, r.best_loss) for r in got] == [(3.0, True, 3.0), (2.0, True, 2.0), (2.5, False, 2.0), (2.0, False, 2.0)]


def test_failing_model_marks_its_rows(spark):
    df = spark.createDataFrame([(1, 0, "abc", "v")], "book_id long, id long, text string, voice string")
    assert synthesised(df).first().dur_ms == 180

    def broken(text, voice):
        raise RuntimeError("no device")

    row = synthesised(df, broken).first()
    assert (row.ok, row.error, row.dur_ms) == (False, "no device", None)


def test_sources(spark, tmp_path):
    from storyloom.sources import files

    (tmp_path / "s.json").write_text(json.dumps([{"speaker": "A", "text": "é"}, {"type": "B", "text": "x"}], ensure_ascii=False))
    (tmp_path / "s.voice_config.json").write_text("{}")
    (tmp_path / "m.jsonl").write_text('{"audio": "a.wav", "text": "t"}\n\n{"audio_filepath": "b.wav"}\n')
    base = f"file://{tmp_path}"
    assert [(r.pos, r.speaker, r.type, r.text) for r in files.read_scripts(spark, f"{base}/s.json").orderBy("pos").collect()] == [(0, "A", None, "é"), (1, None, "B", "x")]
    assert files.read_manifest(spark, f"{base}/none.json", "id string").count() == 0
    rows = files.read_jsonl(spark, f"{base}/m.jsonl", "audio string, audio_filepath string, text string").collect()
    assert sorted(r.audio_filepath for r in rows) == ["a.wav", "b.wav"]
    assert files.count_jsonl(spark, f"{base}/m.jsonl").first().n == 2
    got = files.saved_scripts(files.list_files(spark, base)).collect()
    assert [(r.script, r.has_voice_config) for r in got] == [("s", True)]
    prompts = spark.createDataFrame([(" a \n---SEPARATOR---\n b ",)], "v string").select(files.prompt_parts(F.col("v")).alias("p")).first().p
    assert (prompts.system, prompts.user) == ("a", "b")
    assert files.read_books(spark, f"{base}/m.jsonl").count() == 1


def test_streamed_counts_equal_the_table(spark, tmp_path):
    from storyloom.streaming import progress

    log = spark.createDataFrame([("a", i, f"l{i}") for i in range(30)] + [("b", 1, "x")], progress.LOG)
    log.repartition(3).write.json(f"file://{tmp_path}/log")
    query = progress.run_counts(spark, f"file://{tmp_path}/log", f"file://{tmp_path}/cp", "counted")
    query.awaitTermination()
    want = sorted(tuple(r) for r in progress.counts(log).collect())
    assert sorted(tuple(r) for r in spark.table("counted").collect()) == want
    progress.write_counts(spark, f"file://{tmp_path}/log", f"file://{tmp_path}/cp2", f"file://{tmp_path}/out").awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == want
    assert sorted(r.seq for r in progress.tail(log, 2).filter("task = 'a'").collect()) == [28, 29]
