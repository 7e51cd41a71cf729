"""The loops of a language model against plain sequential ones, over ranges of any size, and after a broken-off run."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from storyloom.functions import jsonfix
from storyloom.operators import loops
from storyloom.plans.tables import digest_model, digest_reviewer

TEMPLATE, REVIEW = "{context}\n\nTEXT:\n{chunk}\n", "{context}\n---\n{batch}"
CHUNKS = [(b, k, f"book {b} chunk {k} " + "{context}" * (k % 2)) for b in (1, 2, None) for k in range(9)] + [(4, 0, None), (5, 0, ""), (5, 1, "x")]


def line(e):
    return json.dumps(e, ensure_ascii=False)


def tried(model, prompt):
    for attempt in range(3):
        try:
            got = jsonfix.entries_in(model(prompt, attempt))
        except Exception:
            continue
        if got:
            return attempt, got
    return None, []


def generated(chunks, model):
    """One book after the other, one chunk after the other, with all that came before at hand."""
    out = {}
    for book in {b for b, _, _ in chunks}:
        mine = sorted((k, t or "") for b, k, t in chunks if b == book)
        before = []
        for k, text in mine:
            told = ["(Beginning of text)" if k == 0 else "(End of text)" if k + 1 == len(mine) else f"(Part {k + 1} of {len(mine)})"]
            if names := sorted({e["speaker"] for e in before} - {"", None, "NARRATOR"}):
                told.append("Characters in this book: " + ", ".join(names))
            if before:
                told += ["\nPrevious section ended with:", *map(line, before[-3:])]
            prompt = "\n".join(told) + f"\n\nTEXT:\n{text}\n"
            attempt, entries = tried(model, prompt)
            out[book, k] = prompt, attempt, entries
            before = before + entries
    return out


def rows(made):
    return {(r.book_id, r.no): (r.prompt, r.attempt, [e.asDict() for e in r.entries]) for r in made.collect()}


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "book_id long, chunk_no long, text string").repartition(3)


@pytest.mark.parametrize("every", [1, 2, 64])
def test_generation_is_a_sequential_loop(chunks, every):
    want = generated(CHUNKS, digest_model)
    assert any(a for _, a, _ in want.values())
    assert rows(loops.generated(chunks, digest_model, TEMPLATE, every=every)) == want


def silent(prompt, attempt):
    return "nothing here" if "chunk 3" in prompt or "chunk 4" in prompt else digest_model(prompt, attempt)


def test_chunks_that_give_nothing_leave_the_state(chunks):
    want = generated(CHUNKS, silent)
    made = loops.generated(chunks, silent, TEMPLATE, every=2)
    assert rows(made) == want and not any(want[1, k][2] for k in (3, 4))
    assert {r.book_id for r in loops.empty_books(made).collect()} == {b for b in {b for b, _, _ in CHUNKS} if not any(e for (x, _), (_, _, e) in want.items() if x == b)}
    script = [(r.pos, r.speaker, r.text) for r in loops.script_of(made).filter("book_id = 1").orderBy("pos").collect()]
    flat = [e for k in range(9) for e in want[1, k][2]]
    assert script == [(i, e["speaker"], e["text"]) for i, e in enumerate(flat)]


def test_a_broken_run_goes_on(chunks, tmp_path):
    folder, calls = f"file://{tmp_path}/run", tmp_path / "calls"

    class Stop(BaseException):
        pass

    def watched(prompt, attempt, stop):
        if stop and "chunk 5" in prompt:
            raise Stop
        with open(calls, "a") as f:
            f.write(f"{'chunk 0' in prompt}\n")
        return digest_model(prompt, attempt)

    with pytest.raises(Exception):
        loops.generated(chunks, lambda p, a: watched(p, a, True), TEMPLATE, folder, every=2).count()
    before = calls.read_text().count("True")
    made = loops.generated(chunks, lambda p, a: watched(p, a, False), TEMPLATE, folder, every=2)
    assert rows(made) == generated(CHUNKS, digest_model)
    assert calls.read_text().count("True") == before > 0
    size = len(calls.read_text())
    assert rows(loops.generated(chunks, lambda p, a: watched(p, a, False), TEMPLATE, folder, every=2)) == generated(CHUNKS, digest_model)
    assert len(calls.read_text()) == size


ENTRIES = [(b, i, f"S{i % 3}", f"words of entry {i}, all of them" if i % 4 else "", "calm" if i % 2 else None) for b in (1, None) for i in range(23)]


def reviewed(entries, model, size):
    out = {}
    for book in {b for b, *_ in entries}:
        mine = [dict(zip(("speaker", "text", "instruct"), e[2:], strict=True)) for e in sorted((x for x in entries if x[0] == book), key=lambda e: e[1])]
        batches, tail = [mine[i : i + size] for i in range(0, len(mine), size)], []
        for k, batch in enumerate(batches):
            told = [f"Batch {k + 1} of {len(batches)}.", *(["\nPrevious batch ended with:", *map(line, tail)] if tail else [])]
            prompt = "\n".join(told) + "\n---\n" + json.dumps(batch, indent=2, ensure_ascii=False)
            attempt, got = tried(model, prompt)
            words = lambda es: sum(len("".join(c for c in (e["text"] or "").lower() if c.isalnum() or c.isspace()).split()) for e in es)
            passed = bool(got) and (not words(batch) or words(got) / words(batch) >= 0.95)
            final = got if passed else batch
            tail = final[-2:]
            out[book, k] = prompt, attempt, final
    return out


@pytest.mark.parametrize(("size", "every"), [(4, 1), (4, 2), (1, 64), (50, 3)])
def test_review_is_a_sequential_loop(spark, size, every):
    df = spark.createDataFrame(ENTRIES, "book_id long, pos long, speaker string, text string, instruct string").repartition(3)
    made = loops.reviewed(df, digest_reviewer, REVIEW, size=size, every=every)
    assert rows(made) == reviewed(ENTRIES, digest_reviewer, size)
    if size == 4:
        assert {r.outcome for r in made.collect()} >= {"passed", "lost"}


def test_empty_tables(spark, chunks):
    made = loops.generated(chunks.limit(0), digest_model, TEMPLATE)
    assert made.count() == 0 and loops.script_of(made).count() == 0
    none = spark.createDataFrame([], "book_id long, pos long, speaker string, text string, instruct string")
    assert loops.reviewed(none, digest_reviewer, REVIEW).count() == 0


def test_responses_are_read_alike_in_a_task_and_as_columns(spark):
    texts = ['[{"speaker": "A", "text": "x"}]', "<think>[</think>```json\n[{\"speaker\": 1}]```", "<thinking>open [", None, "", "no", '[{"text": "a"} {"text": "b"}', "```\n[]\n```", ' \x1c[{"speaker": null, "extra": 2}]']
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", jsonfix.entries_of(F.col("t"))["entries"].alias("e")).collect()
    assert {r.i: [e.asDict() for e in r.e] for r in got} == {i: jsonfix.entries_in(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("review", [False, True])
def test_a_task_gives_on_what_it_made_before_it_goes_on(review):
    calls, n = [], 5 * loops.ROWS + 3
    model = lambda prompt, attempt: calls.append(1) or '[{"speaker": "A", "text": "x"}]'
    plan = loops.Review(model, REVIEW) if review else loops.Generation(model, TEMPLATE)
    payload = {"n": pa.array([n] * n), "batch": pa.array([[{"speaker": "A", "text": "x", "instruct": ""}]] * n)} if review else {"label": pa.array(["l"] * n), "text": pa.array(["t"] * n)}
    batch = pa.RecordBatch.from_pydict({"book_id": pa.array([1] * n), "no": pa.array(range(n)), "state": pa.nulls(n), **payload})
    seen = 0
    for made in loops.stepped(iter([batch]), plan):
        seen += made.num_rows
        assert made.num_rows <= loops.ROWS and len(calls) == seen
    assert seen == n
