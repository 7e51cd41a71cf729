"""Benchmark decontamination: one Aho-Corasick automaton over benchmark windows, scanned once over every text.

The automaton is built on the driver from one bounded block of windows and broadcast; a Python worker loads it once. A
benchmark of more windows than a block is scanned block after block, each block's hits being written to the shared
folder before the next one is loaded, so that neither the driver nor a worker ever holds two.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.shared import saved

WINDOW = 13

#: Bytes of windows in one automaton. It takes up to 50 times as much memory, 200 MB, on the driver and in every worker.
BLOCK_BYTES = 4 << 20

#: Lower-cases A-Z and turns every ASCII character outside 0-9 A-Z a-z into a space, byte for byte; others are letters.
NORMALISE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
WORD = re.compile(rb"[^ ]+")

RANGES = "array<struct<first:long,last:long>>"
FACTS = "struct<n_words:long,n_hit:long,item_ids:array<string>,spans:array<struct<start:long,end:long>>>"
_RANGES = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_FACTS = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def item_windows(benchmark: DataFrame, item_col: str, text_col: str, size: int = WINDOW) -> DataFrame:
    """(words, items): the distinct windows of all items, as words between single spaces, with the ids that have them.

    An item of fewer words is one window; an item without words has none. Runs as built-in functions: the benchmark may
    have any number of rows.
    """
    plain = F.regexp_replace(F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[\\x00-/:-`{-\\x7f]+", " ")
    words = F.filter(F.split(plain, " "), lambda w: w != "")
    spots = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    return (
        benchmark.select(F.col(item_col).cast("string").alias("item"), words.alias("words"))
        .filter(F.size("words") > 0)
        .select("item", F.explode(F.transform(spots, lambda i: F.array_join(F.slice("words", i, size), " "))).alias("words"))
        .groupBy("words")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )


def in_blocks(windows: DataFrame, limit: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """The windows with a number ``block``, and how many blocks there are; a block has about ``limit`` bytes."""
    windows = windows.withColumn("bytes", F.octet_length("words") + F.aggregate("items", F.lit(0), lambda a, x: a + F.coalesce(F.octet_length(x), F.lit(0))))
    windows = saved(windows, "windows")
    total = windows.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // limit))
    return windows.withColumn("block", F.pmod(F.xxhash64("words"), F.lit(n))), n


def automaton(patterns: list[tuple[str, list[str]]]) -> ahocorasick.Automaton | None:
    """Over the windows' UTF-8 bytes, each between spaces, so that matches begin and end at words."""
    if not patterns:
        return None
    out = ahocorasick.Automaton()
    for words, items in patterns:
        out.add_word(f" {words} ".encode().decode("latin-1"), (words.count(" ") + 1, items))
    out.make_automaton()
    return out


def block_automaton(windows: DataFrame, block: int):
    """Broadcast of the automaton of one block."""
    rows = windows.filter(F.col("block") == block).select("words", "items").collect()
    return windows.sparkSession.sparkContext.broadcast(automaton([(r.words, list(r["items"])) for r in rows]))


def union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of words in order, those that touch or overlap as one."""
    out: list[list[int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(a, b) for a, b in out]


def scan(text: bytes, machine) -> tuple[list[tuple[int, int]], list[str]]:
    """Ranges of words of one text that windows cover, and the items that have these windows."""
    words = text.translate(NORMALISE).split()
    if not words or machine is None:
        return [], []
    line = b" " + b" ".join(words) + b" "
    found = list(machine.iter(line.decode("latin-1")))
    if not found:
        return [], []
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    items, ranges = set(), []
    for end, (size, of) in found:
        last = int(np.searchsorted(gaps, end)) - 1
        ranges.append((last - size + 1, last))
        items.update(of)
    return union(ranges), sorted(items)


def facts(text: bytes, hits: list[tuple[int, int]], items: list[str]) -> dict:
    """Words, hit words, items, and the hit ranges as code points of the text."""
    plain = text.translate(NORMALISE)
    if not hits:
        return {"n_words": len(plain.split()), "n_hit": 0, "item_ids": items, "spans": []}
    at = [m.span() for m in WORD.finditer(plain)]
    # Every byte that does not continue a character begins one.
    before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    spans = [{"start": int(before[at[a][0]]), "end": int(before[at[b][1]])} for a, b in hits]
    return {"n_words": len(at), "n_hit": sum(b - a + 1 for a, b in hits), "item_ids": items, "spans": spans}


def binary(column: pa.Array) -> pa.Array:
    return column if pa.types.is_binary(column.type) else column.cast(pa.binary())


def with_facts(rows: DataFrame, run) -> DataFrame:
    """Columns ``row`` and ``found`` from the columns row, text and whatever else ``run`` reads."""
    return rows.mapInArrow(run, T.StructType([rows.schema["row"], *T.StructType.fromDDL(f"found {FACTS}").fields]))


def scanned(docs: DataFrame, text: Column, windows: DataFrame, n: int) -> DataFrame:
    """``docs`` as the struct ``row`` beside the struct ``found``; a null text has no words."""
    rows = docs.select(F.struct("*").alias("row"), text.alias("text"))
    if n == 1:
        shared = block_automaton(windows, 0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = shared.value
            for batch in batches:
                texts = (t.as_py() or b"" for t in binary(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([facts(t, *scan(t, machine)) for t in texts], _FACTS)], ["row", "found"])

        return with_facts(rows, run)
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    hits = block_hits(rows.select("digest", "text"), windows, n)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (t.as_py() or b"" for t in binary(batch.column(1)))
            known = zip(texts, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            out = [facts(t, union([(r["first"], r["last"]) for r in ranges or []]), items or []) for t, ranges, items in known]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _FACTS)], ["row", "found"])

    return with_facts(rows.join(hits, "digest", "left").select("row", "text", "hits", "items"), finish)


def block_hits(texts: DataFrame, windows: DataFrame, n: int) -> DataFrame:
    """(digest, hits, items) of the texts that any block hits; hits are ranges of words and may overlap."""
    found = None
    for k in range(n):
        shared = block_automaton(windows, k)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            machine = shared.value
            for batch in batches:
                got = [(d, *scan(t.as_py() or b"", machine)) for d, t in zip(batch.column(0), binary(batch.column(1)), strict=True)]
                got = [(d.as_py(), [{"first": a, "last": b} for a, b in hits], items) for d, hits, items in got if hits]
                columns = zip(*got, strict=True) if got else [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), _RANGES, pa.list_(pa.string())), strict=True)], ["digest", "hits", "items"])

        # Equal texts have equal hits, of which one row is kept, so a text of many copies makes no long list.
        here = saved(texts.mapInArrow(run, f"digest binary, hits {RANGES}, items array<string>").groupBy("digest").agg(F.first("hits").alias("hits"), F.first("items").alias("items")), "hits")
        shared.destroy()
        found = here if found is None else found.unionByName(here)
    together = found.groupBy("digest").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return saved(together, "hits")


def judged(found: DataFrame, percent: float) -> DataFrame:
    """Columns row and those of ``found``, with the verdict."""
    n, hit = F.col("found.n_words"), F.col("found.n_hit")
    return found.select("row", "found.*", ((hit > 0) & (hit * 100.0 >= n * F.lit(percent))).alias("contaminated"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = WINDOW, percent: float = 5.0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: the id, n_words, n_hit, item_ids (sorted strings), hit spans and contaminated.

    A word inside any occurrence of an item's window is hit; a document is contaminated when at least ``percent`` of its
    words are hit and at least one is. Spans are half-open code-point ranges of the original text, apart by at least one
    word that is not hit. Null or empty texts have no words and are clean; null ids stay null; repeated rows give
    repeated results; other columns are not read. Items with null ids count in n_hit but not among item_ids. The scan
    needs no shuffle. A benchmark whose windows have more than ``block_bytes`` is scanned in blocks, whose hits are put
    together by the text's digest; the results are the same.
    """
    windows, n = in_blocks(item_windows(benchmark, item_col, item_text, size), block_bytes)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    found = scanned(slim, F.col("t"), windows, n)
    return judged(found, percent).select(F.col("row.id").alias(id_col), "n_words", "n_hit", "item_ids", "spans", "contaminated")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", percent: float = 5.0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, that are not contaminated; each row is judged by itself."""
    windows, n = in_blocks(item_windows(benchmark, "item_id", "text"), block_bytes)
    return judged(scanned(docs, F.col(text_col), windows, n), percent).filter(~F.col("contaminated")).select("row.*")


def items_digest(item_ids: Column) -> Column:
    return F.sha2(F.array_join(item_ids, ","), 256)
