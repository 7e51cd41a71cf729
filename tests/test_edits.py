"""Logs of edits against the same edits one by one."""

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import types as T

from storyloom.operators import chunks, edits

CHUNK = "book_id long, id long, speaker string, text string, instruct string, status string, audio_path string"
LOG = "book_id long, seq long, op string, at long, speaker string, text string, instruct string, status string, audio_path string, fields map<string,string>"
OPS = ["insert", "delete", "restore", "update", "undo", "paint", None]


def one_by_one(rows, log):
    """Whole lists, copied before every edit; undo goes back to the copy."""
    out = []
    for book in {r[0] for r in (*rows, *log)}:
        now = [list(r[2:]) for r in sorted((r for r in rows if r[0] == book), key=lambda r: r[1])]
        before = []
        for _, _, op, at, *chunk, fields in sorted((e for e in log if e[0] == book), key=lambda e: e[1]):
            copy, inside = [list(x) for x in now], at is not None and 0 <= at < len(now)
            if op == "insert" and inside:
                now.insert(at + 1, [now[at][0], "", "", "pending", None])
            elif op == "delete" and inside and len(now) > 1:
                del now[at]
            elif op == "restore" and at is not None:
                now.insert(max(0, min(at, len(now))), list(chunk))
            elif op == "update" and inside and any(f in (fields or {}) for f in chunks.FIELDS):
                now[at] = [fields.get(f, v) for f, v in zip(chunks.FIELDS, now[at][:3], strict=True)] + ["pending", now[at][4]]
            elif op == "undo":
                now = before.pop() if before else now
                continue
            if now != copy:
                before.append(copy)
            elif op == "update" and inside and any(f in (fields or {}) for f in chunks.FIELDS):
                before.append(copy)
        out += [(book, i, *x) for i, x in enumerate(now)]
    return sorted(out, key=repr)


def random_log(rng, book, n, length):
    maybe = lambda v: v if rng.random() < 0.8 else None
    for seq in range(n):
        fields = {f: maybe(f"{f} {seq}") for f in (*chunks.FIELDS, "colour") if rng.random() < 0.3}
        yield (book, seq, rng.choice(OPS), maybe(rng.randint(-2, length + 3)), maybe("R"), maybe(f"back {seq}"), "", maybe("done"), maybe(f"a/{seq}"), maybe(fields))


@pytest.mark.parametrize("seed", range(3))
def test_a_log_equals_its_edits(spark, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(edits, "BLOCK", 4)
    rows = [(b, i, f"S{i % 3}" if i else None, f"text {i}" if i % 4 else None, "", "done", f"a/{i}") for b, n in ((1, 12), (2, 1), (3, 5), (None, 6)) for i in range(n)]
    log = [e for b, n, length in ((1, 300, 12), (2, 40, 2), (None, 60, 6), (9, 30, 4)) for e in random_log(rng, b, n, length)]
    got = edits.replayed(spark.createDataFrame(rows, CHUNK).repartition(3), spark.createDataFrame(log, LOG).repartition(3))
    assert got.schema.names == T.StructType.fromDDL(CHUNK).names
    assert sorted(map(tuple, got.collect()), key=repr) == one_by_one(rows, log)


def test_one_edit_equals_the_single_operators(spark):
    rows = spark.createDataFrame([(1, i, "A", f"t{i}", "", "done", None) for i in range(4)], CHUNK)
    for op, single in (("insert", chunks.insert_after), ("delete", chunks.delete_at)):
        log = spark.createDataFrame([(1, 0, op, 2, None, None, None, None, None, None)], LOG)
        want = single(rows, spark.createDataFrame([(1, 2)], "book_id long, at long"))
        assert sorted(map(tuple, edits.replayed(rows, log).collect())) == sorted(map(tuple, want.collect()))


def test_ten_thousand_edits_of_a_book():
    rng = random.Random(4)
    plain = dict.fromkeys(("speaker", "text", "instruct", "status", "audio_path", "new_speaker", "new_text", "new_instruct"))
    log = [{**plain, "op": rng.choice(OPS), "at": rng.randrange(60_000), "sets_speaker": True, "sets_text": False, "sets_instruct": False} for _ in range(10_000)]
    spent = []
    for n in (30_000, 60_000):
        began = time.perf_counter()
        assert len(edits.replay([edits.Element(i, "S") for i in range(n)], log)) > 0
        spent.append(time.perf_counter() - began)
    assert spent[1] < 20 and spent[1] < 4 * spent[0] + 1


def test_empty(spark):
    none, log = spark.createDataFrame([], CHUNK), spark.createDataFrame([], LOG)
    rows = spark.createDataFrame([(1, 0, "A", "t", "", "done", None)], CHUNK)
    assert edits.replayed(none, log).count() == 0 and list(map(tuple, edits.replayed(rows, log).collect())) == list(map(tuple, rows.collect()))


def test_books_are_a_stream_of_rows(spark, monkeypatch):
    rows, log = spark.createDataFrame([(1, 0, "A", "t", "", "done", None)], CHUNK), spark.createDataFrame([], LOG)
    assert "CoGroups" not in edits.replayed(rows, log)._jdf.queryExecution().toString()
    monkeypatch.setattr(edits, "ROWS", 3)
    kinds = pa.schema([("book_id", pa.int64()), ("kind", pa.int32()), ("id", pa.int64()), ("speaker", pa.string()), ("op", pa.string()), ("at", pa.int64())])
    there = [(b, 0, i, f"S{i}", None, None) for b, n in ((None, 4), (1, 1), (2, 7)) for i in range(n)]
    told = sorted([*there, (2, 1, None, None, "delete", 5), (2, 1, None, None, "insert", 0)], key=lambda r: (r[0] or 0, r[1]))
    made = lambda part: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), kinds, strict=True)], schema=kinds)
    got = list(edits.replays(iter([made(told[:6]), made(told[6:9]), made(told[9:])])))
    assert [len(b) for b in got] == [3, 3, 3, 3]
    flat = [(r["book_id"], r["id"], r["origin"], r["speaker"]) for b in got for r in b.to_pylist()]
    left = [(0, "S0"), (None, "S0"), *[(i, f"S{i}") for i in (1, 2, 3, 4, 6)]]
    assert flat == [(None, i, i, f"S{i}") for i in range(4)] + [(1, 0, 0, "S0")] + [(2, i, *x) for i, x in enumerate(left)]
