"""Exact duplicates, ranked search and vector codes against plain versions."""

import hashlib
import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from storyloom.llm import codes, exact, neardup, search, shared
from tests.llm.test_operators import CLASH, corpus

MORE = ("first_id", "first_k", "__text_key", "i", "j", "k", "h", "bits", "may", "place", "best", "item", "term", "tf", "bucket", "score", "v", "x", "label", "code", "other")
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def with_clashes(df):
    names = [c for c in (*CLASH, *MORE) if c not in df.columns]
    return df.select("*", *[F.lit(7).alias(c) for c in names])


def ordered(rows):
    return sorted(rows, key=repr)


# exact duplicates


def exact_rows(rows):
    groups = {}
    for n, (d, t) in enumerate(rows):
        key = re.sub("[\x20\x09-\x0d]", "", t or "")
        groups.setdefault(key, []).append((-len(t or ""), d is None, d or 0, n, d))
    out = []
    for key, members in groups.items():
        best = min(members)
        out += [(m[4], best[4], len(members), m == best, hashlib.sha256(key.encode()).hexdigest()) for m in members]
    return out


def exact_corpus():
    rng = random.Random(3)
    rows = corpus() + [(100 + i, "copied text") for i in range(300)] + [(500, "copied\ttext "), (501, "copied  text"), (None, "copied   text"), (None, "copiedtext"), (600, "a b"), (601, "ab"), (602, "日 本"), (602, "日本"), (602, "日本")]
    rows += [(1000 + i, f"t{rng.randrange(400)}") for i in range(500)]
    return rows


@pytest.mark.parametrize("blocks", [1, 1 << 13])
def test_exact_duplicates(spark, blocks):
    rows = exact_corpus()
    df = with_clashes(spark.createDataFrame(rows, "doc_id long, text string")).repartition(5)
    assert ordered(tuple(r) for r in exact.exact_duplicates(df, blocks=blocks).collect()) == ordered(exact_rows(rows))
    kept = exact.drop_exact(df, blocks=blocks)
    assert kept.columns == df.columns and kept.count() == sum(r[3] for r in exact_rows(rows))
    assert exact.exact_duplicates(df.limit(0)).count() == 0 and exact.drop_exact(df.limit(0)).count() == 0


def test_rows_that_are_alone_do_not_shuffle(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(3000)] + [(5000, "text 7")], "doc_id long, text string")
    hashes = docs.select(F.xxhash64(exact.normalised(F.col("text"))).alias("h"))
    few = exact.repeated_filter(hashes).collect()
    assert len(few) == 1 and sum(bin(b).count("1") for b in few[0].bits) == 2
    assert exact.exact_duplicates(docs).filter("group_size = 2").count() == 2


# ranked search


def ranking(docs, items, k):
    words = lambda t: TERM.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    tf = [(d, Counter(words(t))) for d, t in docs]
    filled = [c for _, c in tf if c]
    n_docs, n_terms = len(filled), sum(c.total() for c in filled)
    df = Counter(w for c in filled for w in c)
    out = []
    for item, text in items:
        scores = []
        for place, (d, c) in enumerate(tf):
            m = 75 + (25 * c.total() * n_docs) // n_terms if n_terms else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 12 * m)) for w in words(text) if w in c)
            if score > 0:
                scores.append((-score, d is None, d or 0, place, d))
        out += [(item, r, s[4], -s[0]) for r, s in enumerate(sorted(scores)[:k], 1)]
    return out


def search_tables():
    base = next(t for d, t in corpus() if d == 7)
    items = [(1, base[:300]), (2, "THE of x|y zz zz ÄÖ Ä"), (2, "w1 w2 W3"), (None, "日本 one"), (3, None), (4, ""), (5, "|"), (6, "unknownword"), (7, "the " * 50)]
    return corpus() + [(700 + i, "tie word") for i in range(30)], items


@pytest.mark.parametrize("round_terms", [1 << 20, 8])
def test_ranked_search(spark, round_terms):
    rows, items = search_tables()
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string")).repartition(4)
    bench = with_clashes(spark.createDataFrame(items, "item_id long, text string"))
    want = ordered(ranking(rows, items, 20))
    found = search.postings(docs)
    assert found.docs == sum(bool(TERM.search(t or "")) for _, t in rows)
    assert ordered(tuple(r) for r in search.search(bench, found, round_terms=round_terms).collect()) == want
    if round_terms > 8:
        assert ordered(tuple(r) for r in search.ranked_search(docs, bench).collect()) == want
        assert search.ranked_search(docs.limit(0), bench).count() == 0 and search.ranked_search(docs, bench.limit(0)).count() == 0
        ties = spark.createDataFrame([(1, "tie")], "item_id long, text string")
        assert [r.doc_id for r in search.ranked_search(docs, ties, k=3).orderBy("rank").collect()] == [700, 701, 702]


def test_terms_of_pieces():
    text = ("Añ1 B-c 日本 " * 50 + "x" * 99).encode()
    assert all(search.term_counts(text, piece) == search.term_counts(text) for piece in (1, 7, 64))
    assert search.term_counts("ÀÉ".encode()) == {"ÀÉ".encode(): 1}


def test_a_large_vocabulary_is_not_held(spark):
    wanted = search.item_terms(spark.createDataFrame([(1, "a b c")], "item_id long, text string"), "item_id", "text")
    assert search.vocabulary_of(wanted) == {b"a", b"b", b"c"} and search.vocabulary_of(wanted, 10) is None


# vector codes


def compressed(rows, rounds=6):
    kept = [(i, lab, [math.floor(4096 * float(np.float32(x))) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    d = len(kept[0][2]) // 8
    part = lambda v, p: v[p * d : (p + 1) * d]
    books = [[part(v, p) for _, _, v in kept[:16]] for p in range(8)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(8):
            got = {}
            for _, _, v in kept:
                got.setdefault(nearest(part(v, p), books[p])[1], []).append(part(v, p))
            books[p] = [[sum(c) // len(got[i]) for c in zip(*got[i], strict=True)] if i in got else e for i, e in enumerate(books[p])]
    out = []
    for i, lab, v in kept:
        found = [nearest(part(v, p), books[p]) for p in range(8)]
        out.append((i, "".join(f"{c:02x}" for _, c in found), sum(e for e, _ in found), lab))
    labels = Counter()
    for r in out:
        labels[r[3]] += r[2]
    text = ",".join(str(c) for b in books for e in b for c in e)
    return [(i, c, e, labels[lab]) for i, c, e, lab in out], hashlib.sha256(text.encode()).hexdigest()


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("n", [300, 5])
def test_vector_codes(spark, n):
    rng = random.Random(n)
    centre = [[rng.uniform(-1, 1) for _ in range(16)] for _ in range(6)]
    rows = [(n - i, [x + rng.gauss(0, 0.1) for x in centre[i % 6]], rng.choice([None, 0, 0, 1])) for i in range(n)]
    rows += [(n, [0.5] * 16, 0)] * 3 + [(None, [-0.25] * 16, None)]
    bad = [(0, None, 1), (-1, [0.1] * 15 + [None], 1), (-2, [float("nan")] * 16, 1), (-3, [float("inf")] + [0.0] * 15, None)]
    odd = [(9000, [], 1), (9001, [0.1] * 15, 1), (9002, [0.1] * 8, 1), (9003, [5000.0] + [0.0] * 15, 1)]
    df = spark.createDataFrame(rows + bad + odd, SCHEMA)
    found = codes.compress(df.select("*", *[F.lit(7).alias(c) for c in ("id", "v", "x", "key", "code", "error", "n", "row", "label_error")]).repartition(3))
    want, digest = compressed(rows)
    assert ordered((r.id, r.code, r.error, r.label_error) for r in found.rows.collect()) == ordered(want)
    assert found.books_sha256 == digest


def test_vector_codes_of_nothing(spark):
    found = codes.compress(spark.createDataFrame([(1, None, 1)], SCHEMA))
    assert found.rows.count() == 0 and found.books is None and found.rows.columns == ["id", "label", "code", "error", "label_error"]


def test_screening_never_loses_the_nearest():
    rng = np.random.default_rng(1)
    for scale in (3, 1000, 1 << 24):
        book = rng.integers(-scale, scale, (16, 8))
        book[5] = book[3]
        x = np.concatenate([rng.integers(-scale, scale, (2000, 8)), book, book + 1, (book[:8] + book[8:]) // 2])
        code, error, n = codes.nearest(x, book)
        exact_ = ((x[:, None, :] - book[None]) ** 2).sum(2)
        assert (code == exact_.argmin(1)).all() and (error == exact_.min(1)).all() and 5 not in code
        assert n < 3 * len(x)


# names of the caller's columns


def test_columns_of_any_name_go_through_the_pipeline(spark, tmp_path):
    rng = random.Random(9)
    words = ["the", "and", "of", "with", "that", "have", "to", "be"] + [f"word{i}" for i in range(900)]
    rows = [(i, " ".join(rng.choice(words[:8] if k % 3 == 0 else words) for k in range(80)) + ".", "en", f"s{i % 2}") for i in range(12)]
    rows += [(20, rows[0][1], "en", "s0"), (None, rows[1][1], "en", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs = with_clashes(docs)
    spark.createDataFrame([(1, "nothing that any page has")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    first = neardup.keep_first(docs)
    assert first.columns == docs.columns and first.count() == 12 and {r.doc_id for r in first.collect()} == set(range(12))
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, str(tmp_path)).cache()
        assert docs.count() >= 10, name
        if name != "sharding":
            assert docs.columns == before.columns
    extra = [c for c in before.columns if c not in corpus_pipeline.COLUMNS]
    assert docs.select("other.*").columns == extra and set(docs.select("other.first_id").distinct().collect()) == {(7,)}


def test_a_pipeline_goes_on_after_its_last_finished_stage(spark, tmp_path, monkeypatch):
    """Broken off in the third stage: finished stages are not made again, the rows are those of a whole run, and nothing
    but the stages' rows is left."""
    rng = random.Random(8)
    words = "the of and a to in is that it was for on are as with river stone lamp winter paper".split()
    text = lambda: " ".join(rng.choice(words) + str(rng.randrange(60)) * (k % 3 == 0) for k in range(120)) + "."
    rows = [(i, text(), "en", f"s{i % 3}", 1) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("q", rows[3][1])], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    shared_folder = shared.shared_dir(spark).removeprefix("file://")
    want = sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    calls, stages = [], list(corpus_pipeline.STAGES)

    def counting(name, stage, fails):
        def call(*args):
            calls.append(name)
            if fails:
                raise RuntimeError(name)
            return stage(*args)

        return name, call

    folder = f"file://{tmp_path}/stages"
    monkeypatch.setattr(corpus_pipeline, "STAGES", [counting(n, f, n == "decontamination") for n, f in stages])
    before = set(os.listdir(shared_folder))
    with pytest.raises(RuntimeError, match="decontamination"):
        corpus_pipeline.run(spark, str(tmp_path), folder)
    assert set(os.listdir(shared_folder)) == before
    monkeypatch.setattr(corpus_pipeline, "STAGES", [counting(n, f, False) for n, f in stages])
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path), folder).collect())) == want
    assert len(want) > 20
    assert calls == ["quality_rules", "near_duplicates", "decontamination", "decontamination", "source_mixing", "sharding"]
