"""Every operator on nulls, empty and very long texts, ties, repeated rows, clashing columns and empty tables."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from storyloom.llm import chat, decontam, hilbert, langid, lines, mixing, neardup, quality, substring, tokens, warc
from storyloom.llm.graph import components
from tests.llm import brute

CLASH = ("id", "t", "row", "words", "lines", "keys", "pairs", "m", "n", "n_words", "kept", "shard", "rank", "size", "copies", "key", "block", "grp", "digest", "tokens", "component")


def corpus():
    rng = random.Random(5)
    vocab = ["the", "of", "and", "Ä", "日本", "x|y", "A-b", "zz"] + [f"w{i}" for i in range(200)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base = text(120)
    near = base.split()
    near[60] = "changed"
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one two three"), (6, "one two three"), (7, base), (8, base), (9, " ".join(near)), (9, " ".join(near)), (10, base.upper())]
    rows += [(11, text(30) + " " + base[:400] + " " + text(30)), (None, base), (None, None), (12, "a b c a b c\na b c\na b c\n\nd"), (13, text(20000)), (14, "x" * 300000), (15, "\x0b".join(["é"] * 40))]
    rows += [(20 + i, text(rng.randint(1, 60))) for i in range(40)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    df = df.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "en").when(F.col("doc_id") % 3 == 1, "fr")).withColumn("source", F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("s"), F.col("doc_id") % 4)))
    return df.select("*", F.length("text").cast("long").alias("n_chars"), *[F.lit(1).alias(c) for c in CLASH]).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def bench(spark):
    base = next(t for d, t in corpus() if d == 7)
    return spark.createDataFrame([(100, " ".join(base.split()[10:40])), (101, "ONE two"), (None, "w1"), (102, None), (103, ""), (9, base[:200])], "item_id long, text string")


def ordered(rows):
    return sorted(rows, key=repr)


def test_words_do_not_depend_on_pieces(monkeypatch):
    column = pa.array(["a bb  ccc", None, "", "dd\n\x0bee " * 50, "f"])
    whole = tokens.words(*tokens.text_buffer(column), lower=True)
    monkeypatch.setattr(tokens, "PIECE", 7)
    data, offs = tokens.text_buffer(column)
    pieces = list(tokens.pieces(data, offs, 7))
    assert pieces[0][0] == 0 and pieces[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(pieces, pieces[1:], strict=False))
    assert whole.counts.tolist() == [3, 0, 0, 100, 1]


def test_quality(docs, empty):
    got = ordered(tuple(r)[:6] for r in quality.quality_report(docs).collect())
    assert got == ordered((d, *brute.quality(t)) for d, t in corpus())
    assert quality.quality_report(empty).count() == 0
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert kept.count() == quality.quality_report(docs).filter("kept").count() > 0
    assert quality.keep_good(empty).count() == 0


def test_repeat_words_by_text_agrees(docs):
    w = F.col("w")
    rows = docs.select(quality.split_words(F.col("text")).alias("w")).filter(F.size("w") >= 3)
    rows = rows.withColumn("k", quality.window_keys(w)).select("w", quality.equal_neighbours(F.col("k")).alias("p"))
    assert all(r.a == r.b for r in rows.select(quality.repeat_words(w, F.col("p")).alias("a"), quality.repeat_words_by_text(w).alias("b")).collect())


def test_contamination(docs, bench, empty):
    items = [(r.item_id, r.text) for r in bench.collect()]
    want = [(d, n, h, [x for x in i if x != "None"], c) for d, n, h, i, c in brute.contamination(corpus(), items)]
    whole = decontam.contamination(docs, bench).collect()
    assert ordered((r.doc_id, r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in whole) == ordered(want)
    assert ordered(decontam.contamination(docs, bench, block_bytes=100).collect()) == ordered(whole)
    assert decontam.contamination(empty, bench).count() == 0
    assert decontam.contamination(docs, bench.limit(0)).filter("contaminated or n_hit > 0").count() == 0


def test_spans_map_to_the_original(spark):
    items = spark.createDataFrame([(1, "Alpha beta, GAMMA"), (2, " ".join(f"w{i}" for i in range(22)))], "item_id long, text string")
    texts = ["é — zz ALPHA  beta; gamma!", " ".join(f"w{i}" for i in range(22)) + " é " + "alpha beta gamma"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block_bytes in (100, 1 << 20):
        rows = sorted(decontam.contamination(df, items, block_bytes=block_bytes).collect())
        assert [texts[0][s.start : s.end] for s in rows[0].spans] == ["ALPHA  beta; gamma"]
        assert [texts[1][s.start : s.end] for s in rows[1].spans] == [" ".join(f"w{i}" for i in range(22)), "alpha beta gamma"]


@pytest.mark.parametrize("block_bytes", [1 << 20, 100])
def test_drop_contaminated(docs, bench, block_bytes):
    kept = decontam.drop_contaminated(docs, bench, block_bytes=block_bytes)
    assert kept.columns == docs.columns
    want = [d for d, *_, bad in brute.contamination(corpus(), [(r.item_id, r.text) for r in bench.collect()]) if not bad]
    assert ordered(r.doc_id for r in kept.select("doc_id").collect()) == ordered(want)


def test_near_duplicates(docs, empty):
    got = ordered((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect())
    want = ordered(x for x in brute.near_duplicates(corpus()))
    assert got == want
    assert neardup.near_duplicates(empty).count() == 0
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and 8 not in ids and 7 in ids and 9 not in ids


def test_groups_that_hang_together_by_chains(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows, words = [], list(base)
    for i in range(60):
        rows.append((i, " ".join(words)))
        words = list(words)
        for _ in range(2):
            words[rng.randrange(200)] = f"n{rng.randrange(10**6)}"
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert ordered((r.doc_id, r.n_shingles, r.component_id) for r in got) == ordered(brute.near_duplicates(rows))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and {got[100], got[101], got[103]} == {100}


@pytest.mark.parametrize("shares", [(), (0.05, 0.1), (0.2, 0.4, 0.6, 0.8)])
def test_substrings(docs, empty, shares):
    got = substring.remove_repeats(docs, shares=shares)
    rows = ordered((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got.collect())
    assert rows == ordered(brute.substrings(corpus()))
    assert substring.remove_repeats(empty, shares=shares).count() == 0


def test_ids_at_the_ends_of_their_range(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(-(2**63), text), (2**63 - 1, text), (2**63 - 1, text + " x"), (None, text), (None, "y " + text), (0, None)]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert ordered((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == ordered(brute.substrings(rows))


def test_index_is_reopened_and_compacts_without_change(spark, docs):
    slim = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("t")).filter("id is not null")
    made = substring.FingerprintIndex.create(spark, 3)
    made.add(slim.filter("id < 8"))
    assert [r[1] for r in made.runs] == [0]
    index = substring.FingerprintIndex.open(spark, made.path)
    index.add(slim.filter("id between 8 and 20"))
    assert [r[1] for r in index.runs] == [1]
    index.add(slim.filter("id between 21 and 30"))
    assert sorted(r[1] for r in index.runs) == [0, 1]
    last = slim.filter("id > 30 or id = 11")
    before = ordered(tuple(r) for r in index.dedup(last, 2).collect())
    index.compact()
    again = substring.FingerprintIndex.open(spark.newSession(), made.path)
    assert len(again.runs) == 1 and again.runs == index.runs
    assert ordered(tuple(r) for r in again.dedup(last, 2).collect()) == before


def test_run_round_trip():
    rng = np.random.default_rng(0)
    keys = np.sort(rng.integers(0, 1 << 48, 1000).astype(np.uint64))
    run = substring.Run(keys, rng.integers(0, 1 << 24, 1000).astype(np.uint64), rng.integers(-5, 1 << 40, 1000))
    back = substring.Run.of_row(*run.row())
    assert all((getattr(run, f) == getattr(back, f)).all() for f in ("keys", "checks", "docs"))


def test_hilbert_curve_is_continuous(spark):
    cells = spark.range(512).selectExpr("int(id div 64) a", "int(id div 8 % 8) b", "int(id % 8) c")
    rows = cells.withColumn("h", hilbert.hilbert_index([F.col("a"), F.col("b"), F.col("c")], 3)).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(512))
    assert all(sum(abs(p - q) for p, q in zip(x[:3], y[:3], strict=True)) == 1 for x, y in zip(rows, rows[1:], strict=False))


def test_shards(docs, empty):
    got = hilbert.hilbert_shards(docs).toPandas()
    assert len(got) == len(corpus())
    per = got.groupby("shard").slot.agg(["min", "max", "count"])
    assert per["count"].max() - per["count"].min() <= 1 and (per["max"] + 1 == per["count"]).all() and (per["min"] == 0).all()
    assert hilbert.hilbert_shards(empty).count() == 0
    assert hilbert.hilbert_shards(docs.limit(3)).count() == 3
    whole = hilbert.hilbert_shards(docs, whole_rows=True).select("row.*")
    assert whole.columns == docs.columns and whole.count() == len(corpus())


def test_shard_files(spark, docs, tmp_path):
    placed = hilbert.hilbert_shards(docs)
    hilbert.write_shards(placed, f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == len(corpus())
    assert hilbert.shard_ranges(placed, "size").count() == 8


def test_mixing(docs, empty):
    got = mixing.mixed(docs).toPandas()
    assert len(got) == len(corpus())
    spread = got.fillna("").groupby("source").copies.agg(["min", "max"])
    assert (spread["max"] - spread["min"] <= 1).all()
    assert mixing.mixed(empty).count() == 0
    all_of = mixing.mixed(docs, entropy=0.9, keep_all=True).filter("tokens > 0 and copies = 0")
    assert all_of.count() == 0
    out = mixing.realised(docs, keep_all=True)
    assert out.columns == docs.columns and out.count() >= docs.filter("length(text) > 0").count()


def test_mixing_weights(spark):
    rows = [(i, "x" * 400, "big" if i < 900 else f"s{i % 5}") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    used = mixing.mixed(df, repetition=3.0, block_tokens=4000).groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("u"), F.max("copies").alias("c")).collect()
    total = sum(r.u for r in used)
    shares = [r.u / total for r in used]
    assert max(r.c for r in used) <= 3 and len(used) == 6
    assert abs(total - 1000 * 100) <= 6 * 100
    assert max(shares) < 0.9
    flat = mixing.mixed(df, repetition=100.0, entropy=1.0, block_tokens=4000).groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("u")).collect()
    assert max(r.u for r in flat) - min(r.u for r in flat) <= 200


def test_language(docs, empty):
    got = langid.identify(docs, docs).toPandas()
    assert len(got) == len(corpus()) and got.score.between(0, 1).all()
    assert set(got.lang_pred) <= {"en", "fr", "und"}
    assert (got[got.doc_id.isin([1, 2, 3])].lang_pred == "und").all()
    assert langid.identify(empty, docs).count() == 0
    assert set(langid.identify(docs, empty).toPandas().lang_pred) == {"und"}


def test_mixture_finds_both_languages(spark):
    rng = random.Random(3)
    vocab = {"aa": ["koto", "mika", "sora", "tani"], "bb": ["gruft", "schlick", "brent", "wald"], "cc": ["luegos", "ciones", "mientes", "quedo"]}
    text = lambda lang, n: " ".join(rng.choice(vocab[lang]) for _ in range(n))
    train = spark.createDataFrame([(text(k, 200), k) for k in vocab for _ in range(5)], "text string, lang string")
    docs = spark.createDataFrame([(1, text("aa", 60)), (2, text("aa", 90) + " " + text("bb", 30)), (3, "1234 !!")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(docs, train).collect()}
    assert got[1].lang_pred == "aa" and got[1].score > 0.95 and len(got[1].languages) == 1
    assert [x.lang for x in got[2].languages] == ["aa", "bb"] and 0.6 < got[2].score < 0.9
    assert got[3].lang_pred == "und" and got[3].score == 0


def pages(spark):
    one = "<html><body><p>menu</p><p>text {}</p><script>var t='</p>';</script><p>foot</p></body></html>"
    rows = [(i, f"https://A.example/{i}", one.format(i)) for i in range(6)] + [(6, "https://b.example:80/x", one.format(0)), (7, None, None), (8, "", ""), (None, "https://A.example/n", "WARC/1.1\r\nfake"), (9, "u\r\nv", "é" * 100000), (5, "https://A.example/5", one.format(5))]
    return spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *[F.lit(1).alias(c) for c in ("id", "host", "n", "first", "digest", "lines", "drop", "payload", "record")])


def test_lines(spark):
    p = pages(spark)
    got = lines.drop_boilerplate(p, lines.host_of(F.col("url")), lines.html_lines(F.col("html"))).collect()
    by = {r.page_id: r for r in got if r.page_id is not None}
    assert len(got) == 12 and by[0].host == "a.example" and by[0].host_pages == 8
    assert by[0].kept_text == "text 0" and by[0].n_dropped == 2
    assert by[6].host == "b.example" and by[6].n_dropped == 0 and by[7].n_lines == 0
    assert lines.drop_boilerplate(p.limit(0), lines.host_of(F.col("url")), F.col("html")).count() == 0


def test_warc(spark, tmp_path):
    import base64
    import hashlib

    p = pages(spark)
    nested = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    extra = spark.createDataFrame([(50, "z", nested * 3), (51, "z", "tail\r\n\r\n")], "page_id long, url string, html string")
    p = p.select("page_id", "url", "html").unionByName(extra)
    rows = [(r.page_id, r.html or "") for r in p.collect()]
    first = {}
    for i, h in rows:
        if i is not None:
            first[h] = min(i, first.get(h, i))
    want = []
    for i, h in rows:
        raw, lead = h.encode(), first.get(h)
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == lead else "revisit", None if i == lead else lead))
    got = warc.round_trip(p)
    assert ordered((r.id, r.payload_bytes, r.digest, r.kind, r.refers_to) for r in got.collect()) == ordered(want)
    assert got.filter("not sound").count() == 0
    assert warc.round_trip(p.limit(0)).count() == 0


def test_archives_by_compression(spark, tmp_path):
    import gzip

    p = pages(spark)
    facts = lambda df: ordered(tuple(r)[1:] for r in df.collect())
    whole = facts(warc.round_trip(p))
    warc.write(p, f"file://{tmp_path}/plain", compression="none")
    assert facts(warc.read(spark, f"file://{tmp_path}/plain")) == whole
    record = lambda n: b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" % n
    (tmp_path / "each.warc.gz").write_bytes(b"".join(gzip.compress(record(i)) for i in range(5)))
    assert sorted(r.id for r in warc.read(spark, f"file://{tmp_path}/each.warc.gz").collect()) == list(range(5))


def test_exits_are_the_ends_of_chains():
    at = np.array([0, 10, 15, 30, 99])
    assert warc.exits(at, np.array([10, 30, 30, 50, 120])).tolist() == [50, 50, 50, 50, 120]
    assert warc.exits(np.array([5]), np.array([9])).tolist() == [9] and warc.exits(np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []
    long = np.arange(0, 5000, 5)
    assert (warc.exits(long, long + 5) == 5000).all()


def test_chat(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "Ann", "hé"), (1, 2, "Bo", None), (1, 2, "Bo", None), (1, 70, "Ann", "late"), (2, None, None, "x"), (None, 0, "Ann", ""), (3, 0, "system", "alone")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", *[F.lit(1).alias(c) for c in ("conv", "piece", "said", "me", "parts", "k", "at", "cast", "rank")])
    got = {(r.conv_id, r.piece, r.participant): r for r in chat.rotate(df).collect()}
    assert set(got) == {(1, 0, "Ann"), (1, 0, "Bo"), (2, 0, "unknown"), (None, 0, "Ann"), (3, 0, None)}
    ann = got[1, 0, "Ann"]
    bo = "<|im_start|>user name=Bo\n<|im_end|>\n"
    assert ann.rendered == f"<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhé<|im_end|>\n{bo}{bo}<|im_start|>assistant\nlate<|im_end|>\n"
    assert [ann.rendered[m.start : m.end] for m in ann.mask] == ["hé<|im_end|>", "late<|im_end|>"] and ann.n_turns == 5
    assert [got[1, 0, "Bo"].rendered[m.start : m.end] for m in got[1, 0, "Bo"].mask] == ["<|im_end|>"] * 2
    assert got[3, 0, None].mask == [] and chat.rotate(df.limit(0)).count() == 0


def test_pipeline_stages(spark, docs, empty, bench, tmp_path):
    import corpus_pipeline

    folder = f"{tmp_path}"
    bench.write.parquet(f"file://{folder}/benchmark.parquet")
    for start in (docs, empty):
        rows = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, f"file://{folder}")
            assert rows.columns == docs.columns
            rows.write.mode("overwrite").parquet(f"file://{folder}/stage")
            rows = spark.createDataFrame(spark.read.parquet(f"file://{folder}/stage").collect(), rows.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, rows, folder).count() == rows.count()
