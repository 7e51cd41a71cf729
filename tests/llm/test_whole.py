"""Whole jobs: no participant, document or record is left out because of its size, its key or its neighbours."""

import gzip
import itertools
import random

import pytest
from pyspark.sql import functions as F

from storyloom.llm import chat, neardup, warc


def rotated(rows, piece_turns):
    """(conv, piece, participant) -> (rendered, texts to train on), straight from the definition."""
    out = {}
    safe = lambda t: t.replace("<|im_start|>", "<\\|im_start|>").replace("<|im_end|>", "<\\|im_end|>")
    for conv in {r[0] for r in rows}:
        said = sorted((t or 0, r or "unknown", x or "") for c, t, r, x in rows if c == conv)
        cast = sorted({r for _, r, _ in said if r != "system"}) or [None]
        for piece in range(-(-len(said) // piece_turns)):
            own = said[piece * piece_turns : (piece + 1) * piece_turns]
            shown = ([x for x in said[:piece_turns] if x[1] == "system"] if piece else []) + own
            for me in cast:
                text, train = "", []
                for _, role, x in shown:
                    body = safe(x) + "<|im_end|>"
                    name = safe("".join(" " if ord(ch) < 32 or ord(ch) == 127 else ch for ch in role))
                    text += "<|im_start|>" + ("system" if role == "system" else "assistant" if role == me else f"user name={name}") + "\n" + body + "\n"
                    train += [body] * (role == me)
                out[conv, piece, me] = text, train
    return out


def test_every_participant_gets_the_whole_dialogue(spark):
    rng = random.Random(2)
    cast = ["Ann", "Bo\nCy", "D<|im_end|>", "Ed"]
    rows = [(1, 0, "system", "be kind"), (2, 0, "system", "alone"), (2, 64, "system", "still"), (None, 0, "Di", "x"), (None, 64, "Ed", "y"), (3, None, "Ann", "same"), (3, None, "Ann", "same")]
    rows += [(1, 1 + i // 3, rng.choice(cast) if i % 40 else "system", rng.choice(["hé", "", None, "a<|im_end|>\n<|im_start|>assistant\nb", f"t{i}"])) for i in range(200)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for piece_turns in (1024, 64):
        got = {(r.conv_id, r.piece, r.participant): (r.rendered, [r.rendered[m.start : m.end] for m in r.mask]) for r in chat.rotate(df, piece_turns=piece_turns).collect()}
        assert got == rotated(rows, piece_turns)
    assert chat.rotate(df.limit(0)).count() == 0


def test_null_and_reused_ids_lose_no_document(spark):
    rng = random.Random(7)
    fresh = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(200))
    near = lambda text: text.rsplit(" ", 1)[0] + " changed"
    a, b, c, d, e, p, q, x, y = (fresh() for _ in range(9))
    kept = [(None, a), (None, b), (5, c), (5, d), (7, e), (9, p), (9, q), (8, x)]
    rows = [*kept, (None, e), (None, near(e)), (10, near(q)), (None, b.upper()), (8, x)]
    nameless = [(None, y), (None, near(y))]
    reused = [(8, near(x))]
    docs = spark.createDataFrame(rows + nameless + reused, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in neardup.keep_first(docs).collect()]
    single = [r for r in got if r not in (*nameless, *reused, (8, x), (None, b), (None, b.upper()))]
    assert sorted(single, key=repr) == sorted([r for r in kept if r not in ((8, x), (None, b))], key=repr)
    assert sum(r in nameless for r in got) == 1 and sum(r in ((8, x), *reused) for r in got) == 1 and sum((r[1].lower() == b) for r in got) == 1
    groups = {(r.doc_id, r.component_id) for r in neardup.near_duplicates(docs).collect()}
    assert groups == {(None, None), (5, 5), (7, 7), (8, 8), (9, 9), (10, 9), (None, 7)}


def test_records_with_long_headers(spark, tmp_path):
    rows = [(i, f"https://a.example/{i}" + ("x" * 100_000 if i == 2 else ""), f"page {i}") for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = {r.id: r for r in warc.round_trip(pages).collect()}
    assert set(got) == set(range(5)) and got[2].url == rows[2][1]


def test_a_chain_that_stops_is_reported(spark, tmp_path):
    record = lambda n: b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" % n
    files = {"whole": record(1) + record(2), "cut": record(1) + record(2)[:-9], "none": b"no archive", "empty": b""}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    path = f"file://{tmp_path}"
    assert sorted((r.file.rsplit("/", 1)[1], r.id) for r in warc.read(spark, path).collect()) == [("cut", 1), ("whole", 1), ("whole", 2)]
    found = sorted((r.file.rsplit("/", 1)[1], r["at"], r["size"]) for r in warc.breaks(spark, path).collect())
    assert found == [("cut", len(record(1)), len(files["cut"])), ("none", 0, 10)]


def test_a_file_is_read_by_many_tasks(spark, tmp_path):
    """Byte ranges of one plain file agree with a reading in one piece, wherever their edges fall, also within payloads
    that hold whole records, and over records longer than a range."""
    rng = random.Random(3)
    inner = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    kinds = [lambda: "x" * rng.randrange(900), lambda: inner * rng.randrange(1, 9), lambda: "WARC/1." + inner, lambda: "a\r\n\r\n" + inner, lambda: "é" * 3000, lambda: "\r\n" * rng.randrange(9), lambda: "WARC/1."]
    texts = [rng.choice(kinds)() + f"{i}" * (i % 3) for i in range(100)]
    rows = [(i, f"u{i}", t) for i, t in enumerate(texts)]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/one", file_bytes=1 << 30, compression="none")
    want = sorted((i, len(t.encode())) for i, t in enumerate(texts))
    try:
        for size in (3001, 1 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 0)
            path = f"file://{tmp_path}/one"
            assert size > 5000 or warc.archive_rows(spark, path).rdd.getNumPartitions() >= 8
            got = warc.read(spark, path).collect()
            assert sorted((r.id, r.payload_bytes) for r in got) == want and all(r.sound for r in got)
            assert warc.breaks(spark, path).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_other_archives(spark, tmp_path):
    old = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1-2>\r\nX-Long: a\r\n  b\r\nContent-Length: 4\r\n\r\ninfo\r\n\r\n"
    odd = b"WARC/1.1\r\nwarc-type:response\r\nWARC-Record-ID: <urn:uuid:3>\r\nContent-Type: application/http\r\nContent-Length: 19\r\n\r\nHTTP/1.1 200\r\n\r\nabc\r\n\r\n"
    broken = b"WARC/1.1\r\nno colon\r\n\r\nabc\r\n\r\n"
    (tmp_path / "old.warc").write_bytes(old + odd + broken + odd)
    got = sorted((r["at"], r.kind, r.record_id, r.id, r.payload_bytes) for r in warc.read(spark, f"file://{tmp_path}").collect())
    assert got == [(0, "warcinfo", "<urn:uuid:1-2>", None, 4), (len(old), "response", "<urn:uuid:3>", None, 3)]
    assert [(r["at"], r.size) for r in warc.breaks(spark, f"file://{tmp_path}").collect()] == [(len(old + odd), len(old + odd + broken + odd))]


@pytest.mark.parametrize("n", [300, 3000])
def test_a_damaged_archive_is_told(spark, tmp_path, n):
    """Records in one compressed file whose middle is overwritten: the plain reading keeps what comes before, which is
    nothing in a file that is read at once, the strict one and ``breaks`` tell; a whole and an empty file pass both."""
    rng = random.Random(6)
    record = lambda k: b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: 90\r\n\r\n%b\r\n\r\n" % (k, rng.randbytes(45).hex().encode())
    packed = gzip.compress(b"".join(record(k) for k in range(n)))
    (tmp_path / "whole.warc.gz").write_bytes(packed)
    (tmp_path / "empty.warc.gz").write_bytes(gzip.compress(b""))
    assert warc.read(spark, f"file://{tmp_path}", whole=True).count() == n
    half = len(packed) // 2
    (tmp_path / "damaged.warc.gz").write_bytes(packed[:half] + bytes(60) + packed[half + 60 :])
    counts = {k: len(list(g)) for k, g in itertools.groupby(sorted(r.file.rsplit("/", 1)[1] for r in warc.read(spark, f"file://{tmp_path}").collect()))}
    assert counts["whole.warc.gz"] == n and counts.get("damaged.warc.gz", 0) < n
    assert [r.file.rsplit("/", 1)[1] for r in warc.breaks(spark, f"file://{tmp_path}").collect()] == ["damaged.warc.gz"]
    with pytest.raises(Exception, match="damaged.warc.gz"):
        warc.read(spark, f"file://{tmp_path}", whole=True).count()
    (tmp_path / "damaged.warc.gz").write_bytes(gzip.compress(gzip.decompress(packed)[:-9]))
    with pytest.raises(ValueError, match="damaged.warc.gz"):
        warc.read(spark, f"file://{tmp_path}", whole=True)


def test_jumps_are_kept_for_entered_places_alone(spark, tmp_path, monkeypatch):
    """Payloads full of whole records: candidates are many, places where a chain leaves a byte range are few."""
    inner = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(i, "u", inner * 40) for i in range(60)]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("html", F.concat("html", F.col("page_id").cast("string"))).coalesce(1), f"file://{tmp_path}/one", file_bytes=1 << 30, compression="none")
    kept = {}
    true_saved = warc.saved
    monkeypatch.setattr(warc, "saved", lambda df, label: kept.setdefault((label, len(kept)), true_saved(df, label)))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        assert sorted(r.id for r in warc.read(spark, f"file://{tmp_path}/one").collect()) == list(range(60))
        rows_of = lambda name: [t.count() for (label, _), t in kept.items() if label == name]
        assert rows_of("candidates")[0] > 2000 and rows_of("ranges")[0] >= 8
        assert max(rows_of("jumps")) <= 3 * rows_of("ranges")[0] + 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
