"""Operators against plain Python from their definitions, held-out accuracy, and work that must not grow with a square."""

import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from storyloom.llm import hilbert, langid, lines, mixing, neardup, quality, queries, shared
from tests.llm import brute

SF = "/root/testdata/sf0.01"


def test_language_mixtures(spark):
    rng = random.Random(3)
    vocab = {"aa": ["koto", "mika", "sora", "tani", "é"], "bb": ["gruft", "schlick", "brent", "wald"], "cc": ["luegos", "ciones", "mientes", "quedo"]}
    text = lambda lang, n: " ".join(rng.choice(vocab[lang]) for _ in range(n))
    train = [(text(k, 40), k) for k in vocab for _ in range(3)]
    texts = ["ab", "A.", "é", "x", "1 2", "", None, "²", "A 1 2", "日本", *[text(k, 20) for k in vocab], text("aa", 30) + " " + text("bb", 15), text("cc", 10) + text("aa", 9) + text("bb", 8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labelled = spark.createDataFrame(train, "text string, lang string")
    got = sorted(langid.identify(docs, labelled).collect())
    want = brute.languages(train, texts)
    assert [r.lang_pred for r in got] == [k for k, _ in want]
    assert all(abs(r.score - s) < 2e-3 for r, (_, s) in zip(got, want, strict=True))
    with pytest.raises(ValueError, match="max_languages"):
        langid.identify(docs, labelled, max_languages=2)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_held_out_accuracy(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = queries.op10_language_id(spark, SF).filter("held_out").join(truth, "doc_id").filter("lang is not null")
    per = got.groupBy("lang").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.count("*").alias("n")).collect()
    assert len(per) > 1 and sum(r.n for r in per) > 200 and min(r.right for r in per) >= 0.95


def test_boilerplate_lines(spark):
    rng = random.Random(4)
    pages = [(i, rng.choice(["a", "b", "c", "", "d"]) if i else "alone", [rng.choice("uvwxyz") * rng.randint(1, 3) for _ in range(rng.randint(0, 6))]) for i in range(60)]
    df = spark.createDataFrame([(i, h or None, "\n".join(f" {x}\t" for x in ls)) for i, h, ls in pages], "page_id long, host string, text string")
    for ratio in (0.1, 0.3):
        got = sorted((r.page_id, r.kept_text) for r in lines.drop_boilerplate(df, F.col("host"), F.col("text"), ratio=ratio).collect())
        assert got == [(i, "\n".join(ls)) for i, ls in brute.boilerplate(pages, ratio)]


def test_order_and_cut_of_shards(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["", None, "é", "x" * rng.randint(1, 99)]), rng.choice(["en", None]), "s") for i in range(101)]
    got = hilbert.hilbert_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    for r in got:
        raw = (rows[r.doc_id][1] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    order = sorted(got, key=lambda r: (r.hilbert, r.text_crc32, r.size, r.doc_id))
    assert [(r.shard, r.slot) for r in order] == [(k * 8 // 101, k - -(-(k * 8 // 101) * 101 // 8)) for k in range(101)]


def test_mixing(spark):
    rng = random.Random(6)
    docs = [(i, "big" if rng.random() < 0.7 else f"s{rng.randrange(5)}", "y" * rng.randint(1, 400)) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    for entropy, repetition in ((0.95, 4.0), (1.0, 1.5)):
        got = {r.doc_id: r.copies for r in mixing.mixed(df, entropy=entropy, repetition=repetition, block_tokens=2000).collect()}
        assert got == brute.mixture(docs, entropy, repetition, 2000)


def test_words_beyond_the_numbers_of_a_key(spark):
    words = "a b c d " * ((1 << 18) + 2)
    row = quality.quality_report(spark.createDataFrame([(1, words)], "doc_id long, text string")).first()
    assert (row.n_words, row.n_repeat_words) == (4 * ((1 << 18) + 2),) * 2


def compared(spark, monkeypatch, rows):
    """Pairs that are verified for these rows."""
    pairs, real = [], neardup.verified
    monkeypatch.setattr(neardup, "verified", lambda p, s, n: pairs.append(p.count()) or real(p, s, n))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.filter("kept").count() == len(rows)
    return sum(pairs)


def test_pages_of_one_template_are_not_compared_in_pairs(spark, monkeypatch):
    page = lambda i: " ".join([f"c{k}" for k in range(140)] + [f"u{i}_{k}" for k in range(30)])
    few, many = (compared(spark, monkeypatch, [(i, page(i)) for i in range(n)]) for n in (200, 400))
    assert many <= 2.2 * few and many < 400 * 5


@pytest.mark.parametrize("own", [10, 15, 20, 25, 30])
def test_pages_of_one_template_are_not_joined_in_pairs(spark, monkeypatch, own):
    """Rows that the joins make, not those that are left of them; pages differ in length, and only their middle is theirs."""
    joined, real = [], neardup.size_sides

    def sides(spots, percent):
        out = real(spots, percent)
        joined.append(sum(a.join(b, ["token", "size"]).count() for a, b in out))
        return out

    monkeypatch.setattr(neardup, "size_sides", sides)
    page = lambda i: " ".join([f"c{k}" for k in range(70)] + [f"u{i}_{k}" for k in range(own + i % 3)] + [f"c{k}" for k in range(70, 140)])
    sizes = []
    for n in (150, 300):
        joined.clear()
        got = neardup.near_duplicates(spark.createDataFrame([(i, page(i)) for i in range(n)], "doc_id long, text string"))
        assert got.filter("kept").count() == n
        sizes.append(sum(joined))
    assert sizes[1] <= 2.2 * sizes[0] + 300


@pytest.mark.parametrize("percent", [60, 70, 80, 85, 95])
def test_near_duplicates_at_other_similarities(spark, percent):
    rng = random.Random(percent)
    rows = []
    for _ in range(40):
        base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        for _ in range(3):
            words = list(base)
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect())
    want = sorted(brute.near_duplicates(rows, percent))
    assert sum(a == b for a, b in zip(got, want, strict=True)) >= 0.99 * len(want)
    with pytest.raises(ValueError, match="percent"):
        neardup.bands_for(10)


def test_spread_join_equals_a_join(spark):
    rng = random.Random(8)
    rows = spark.createDataFrame([(rng.choice([1] * 5000 + list(range(3000))), i) for i in range(4000)], "k long, v long")
    keys = rows.groupBy("k").agg(F.count("*").alias("n")).filter("k % 7 < 5")
    want = sorted(tuple(r) for r in rows.join(keys, "k").collect())
    assert sorted(tuple(r) for r in shared.spread_join(rows, keys, ["k"], "n", 4000).collect()) == want


def test_what_was_written_can_be_removed(spark):
    df = shared.saved(spark.range(3), "numbers")
    path = re.sub(r"/part-[^/]*$", "", df.inputFiles()[0]).removeprefix("file://")
    assert df.count() == 3 and os.path.isdir(path)
    assert shared.remove_written(spark) >= 1 and not os.path.exists(path)
