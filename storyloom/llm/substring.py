"""Substring dedup: a log-structured index of window fingerprints, merge-joined with each new batch of documents.

A batch is cut into groups of documents. Each group's task turns its texts into one sorted run of window fingerprints
(one entry per distinct window, with the smallest document that has it) and cuts the run by fingerprint range. A second
task gets one range of the runs of all groups and of the history, merges them in order, and answers every entry with one
bit: does a smaller document, or the history, have this window? The bits go back to the groups, whose texts are marked.
Only sorted, delta-coded and compressed runs are shuffled, and one copy of the texts.

The index is a folder of immutable tables of such runs and a manifest, to which every change appends the list of runs
that are valid from then on; so any later session can open it, and a change that breaks off leaves the index as it was.
Runs have levels: a batch adds one of level 0, and ``FAN`` runs of one level are merged into one of the next.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm import tokens
from storyloom.llm.shared import new_path

WINDOW = 13

#: A fingerprint has 48 bits of one hash, by which runs are sorted, and 24 bits of another, by which matches are verified.
KEY_BITS, CHECK_BITS = 48, 24

#: Group number of runs of the history, and the least one of groups of documents without an id. Documents of the history
#: come before those of any batch, those without an id after all others and before none of each other.
HISTORY, NAMELESS = -1, 1 << 40

#: Runs of one level that are merged into one of the next.
FAN = 2

#: Windows for which one task is planned.
TASK_WINDOWS = 1_000_000

#: Bytes of text of one run of history.
TASK_BYTES = 6 * TASK_WINDOWS

RUN = "grp long, part long, size long, keys binary, checks binary, docs binary, ids binary"


def pack(values: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of unsigned numbers, compressed byte plane by byte plane."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, size: int, width: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=size * width), np.uint8)
    out = np.zeros((size, 8), np.uint8)
    out[:, :width] = planes.reshape(width, size).T
    return out.view("<u8").reshape(-1)


@dataclass
class Run:
    """Distinct windows in order of (key, check), with the smallest document id of each."""

    keys: np.ndarray
    checks: np.ndarray
    docs: np.ndarray

    def row(self) -> tuple:
        ids, place = np.unique(self.docs, return_inverse=True)
        width = max(1, (len(ids).bit_length() + 7) // 8)
        return (
            len(self.keys), pack(np.diff(self.keys, prepend=np.uint64(0)), KEY_BITS // 8),
            pack(self.checks, CHECK_BITS // 8), pack(place.reshape(-1), width), zstandard.compress(ids.astype("<i8").tobytes(), 1),
        )

    @staticmethod
    def of_row(size: int, keys: bytes, checks: bytes, docs: bytes, ids: bytes) -> Run:
        names = np.frombuffer(zstandard.decompress(ids), "<i8")
        width = max(1, (len(names).bit_length() + 7) // 8)
        return Run(np.cumsum(unpack(keys, size, KEY_BITS // 8), dtype=np.uint64), unpack(checks, size, CHECK_BITS // 8), names[unpack(docs, size, width).astype(np.int64)])


def in_order(keys: np.ndarray, checks: np.ndarray, *by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (key, check) and then ``by``, and which entries of that order begin a new window."""
    order = np.lexsort((*by[::-1], checks, keys)) if len(keys) else np.zeros(0, np.int64)
    k, c = keys[order], checks[order]
    new = np.ones(len(order), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    return order, new


@dataclass
class GroupWindows:
    """The windows of one group's texts."""

    found: tokens.Words
    at: np.ndarray
    order: np.ndarray
    run_of: np.ndarray
    doc_of: np.ndarray
    run: Run
    data: np.ndarray = field(repr=False)

    @staticmethod
    def of(ids: np.ndarray, texts: pa.Array) -> GroupWindows:
        data, offs = tokens.text_buffer(texts)
        found = tokens.words(data, offs, hashes=2)
        first, at = tokens.windows(found, WINDOW, 0)
        second, _ = tokens.windows(found, WINDOW, 1)
        doc_of = ids[np.repeat(np.arange(len(ids)), found.counts)[at]] if len(at) else np.zeros(0, np.int64)
        keys, checks = first >> np.uint64(64 - KEY_BITS), second >> np.uint64(64 - CHECK_BITS)
        order, new = in_order(keys, checks, doc_of)
        lead = order[new]
        return GroupWindows(found, at, order, np.cumsum(new) - 1, doc_of, Run(keys[lead], checks[lead], doc_of[lead]), data)


def column(table: pa.Table, name: str) -> pa.Array:
    got = table.column(name).combine_chunks()
    return pa.concat_arrays(got.chunks) if isinstance(got, pa.ChunkedArray) else got


def doc_ids(table: pa.Table) -> np.ndarray:
    """Ids of a group's documents; those of a group without ids are all equal."""
    return pc.fill_null(column(table, "id"), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def cuts(run: Run, parts: int) -> np.ndarray:
    """Where each range of fingerprints begins in a run; one entry more than ranges."""
    edges = (np.arange(1, parts, dtype=object) * (1 << KEY_BITS)) // parts
    return np.concatenate([[0], np.searchsorted(run.keys, np.array(edges, np.uint64)), [len(run.keys)]]).astype(np.int64)


def emit(parts: int):
    """One group's run, cut by range."""

    def run(table: pa.Table) -> pa.Table:
        return cut_run(table.column("grp")[0].as_py(), GroupWindows.of(doc_ids(table), column(table, "t")).run, parts)

    return run


def emit_history(parts: int):
    """Runs of the texts as they lie in the input, of windows only: history needs no documents and no answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in tokens.row_slices(batch.column(0), TASK_BYTES):
                made = GroupWindows.of(np.zeros(len(texts), np.int64), texts).run
                yield from cut_run(HISTORY, made, parts).combine_chunks().to_batches()

    return run


def cut_run(group: int, made: Run, parts: int) -> pa.Table:
    edges, rows = cuts(made, parts), []
    for k in range(parts):
        a, b = edges[k], edges[k + 1]
        if b > a:
            rows.append((group, k, *Run(made.keys[a:b], made.checks[a:b], made.docs[a:b]).row()))
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, RUN_TYPES, strict=True)], names=RUN_NAMES)


RUN_NAMES = [x.split()[0] for x in RUN.split(", ")]
RUN_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


def runs_of(table: pa.Table) -> list[tuple[int, Run]]:
    cols = [table.column(n).to_pylist() for n in RUN_NAMES]
    return [(g, Run.of_row(*rest)) for g, _, *rest in zip(*cols, strict=True)]


def gathered(runs: list[tuple[int, Run]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, checks, documents and whether these are history (0), have an id (1) or none (2), of all runs in a row."""
    cat = lambda name, kind: np.concatenate([getattr(r, name) for _, r in runs]).astype(kind) if runs else np.zeros(0, kind)
    rank = [np.full(len(r.keys), 0 if g == HISTORY else 2 if g >= NAMELESS else 1, np.int8) for g, r in runs]
    return cat("keys", np.uint64), cat("checks", np.uint64), cat("docs", np.int64), np.concatenate(rank) if rank else np.zeros(0, np.int8)


def answer(table: pa.Table) -> pa.Table:
    """For one range: per group, a bit for each entry of its run in order, set if a smaller document has the window."""
    part = table.column("part")[0].as_py()
    runs = runs_of(table)
    keys, checks, docs, rank = gathered(runs)
    order, new = in_order(keys, checks, rank, docs)
    beaten = np.zeros(len(keys), bool)
    if len(order):
        lead = order[new][np.cumsum(new) - 1]
        beaten[order] = (rank[lead] < rank[order]) | ((rank[lead] == rank[order]) & (docs[lead] < docs[order]))
    out, at = [], 0
    for group, r in runs:
        n = len(r.keys)
        if group != HISTORY:
            out.append((group, part, n, zstandard.compress(np.packbits(beaten[at : at + n]).tobytes(), 1)))
        at += n
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 4, kinds, strict=True)], names=["grp", "part", "size", "bits"])


def merge(table: pa.Table) -> pa.Table:
    """For one range: one run of the distinct windows of all runs."""
    part = table.column("part")[0].as_py()
    keys, checks, docs, _ = gathered(runs_of(table))
    order, new = in_order(keys, checks)
    lead = order[new]
    row = (HISTORY, part, *Run(keys[lead], checks[lead], docs[lead]).row())
    return pa.Table.from_arrays([pa.array([x], t) for x, t in zip(row, RUN_TYPES, strict=True)], names=RUN_NAMES)


def mark(texts: pa.Table, answers: pa.Table) -> pa.Table:
    """Per document of a group: its words, those to remove, and the rest joined by one space."""
    names = ["id", "n_words", "n_removed", "removed", "kept_text"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])), pa.string()]
    if not len(texts):
        return pa.Table.from_arrays([pa.array([], k) for k in kinds], names=names)
    ids = doc_ids(texts)
    group = GroupWindows.of(ids, column(texts, "t"))
    beaten = np.zeros(len(group.run.keys), bool)
    rows = sorted(zip(*[answers.column(n).to_pylist() for n in ("part", "size", "bits")], strict=True))
    if rows:
        beaten = np.concatenate([np.unpackbits(np.frombuffer(zstandard.decompress(b), np.uint8), count=n) for _, n, b in rows]).astype(bool)
    remove = np.zeros(len(group.at), bool)
    if len(group.order):
        of = group.run_of
        remove[group.order] = beaten[of] | (group.run.docs[of] < group.doc_of[group.order])
    edge = np.zeros(len(group.found.starts) + 1, np.int64)
    np.add.at(edge, group.at[remove], 1)
    np.add.at(edge, group.at[remove] + WINDOW, -1)
    gone = np.cumsum(edge)[:-1] > 0
    counts, first = group.found.counts, group.found.first
    texts_out, n_removed, spans = [], [], []
    raw = group.data.tobytes()
    for row in range(len(ids)):
        a, b = first[row], first[row + 1]
        cut = gone[a:b]
        stay = np.flatnonzero(~cut) + a
        texts_out.append(b" ".join([raw[s:e] for s, e in zip(group.found.starts[stay].tolist(), group.found.ends[stay].tolist(), strict=True)]).decode())
        n_removed.append(int(cut.sum()))
        change = np.flatnonzero(np.diff(cut.astype(np.int8), prepend=0, append=0))
        spans.append([{"first": int(x), "last": int(y) - 1} for x, y in zip(change[::2], change[1::2], strict=True)])
    return pa.Table.from_arrays([column(texts, "id"), pa.array(counts, pa.int64()), pa.array(n_removed, kinds[2]), pa.array(spans, kinds[3]), pa.array(texts_out, kinds[4])], names=names)


class FingerprintIndex:
    """Windows of all documents added so far, as a folder of immutable sorted runs and a manifest.

    ``parts`` is the number of fingerprint ranges; it stays the same for the life of an index and bounds what one task
    merges: about (windows in the index + windows in a batch) / parts. One writer at a time may change an index.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int, runs: list[tuple[str, int]], version: int):
        self.spark, self.path, self.parts, self.runs, self.version = spark, path, parts, runs, version

    @classmethod
    def create(cls, spark: SparkSession, parts: int, path: str | None = None) -> FingerprintIndex:
        """An empty index in a folder of the shared ones, or in ``path``."""
        index = cls(spark, path or new_path(spark, "fingerprints"), parts, [], -1)
        index.commit([])
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        """The index that this or another session made at ``path``, as its last change left it."""
        last = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").orderBy(F.desc("version")).first()
        return cls(spark, path, last.parts, [(r["name"], r["level"]) for r in last.runs], last.version)

    def commit(self, runs: list[tuple[str, int]]) -> None:
        """Makes ``runs`` the valid ones."""
        self.runs, self.version = runs, self.version + 1
        self.spark.createDataFrame([(self.version, self.parts, runs)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def history(self, runs: list[tuple[str, int]] | None = None) -> DataFrame | None:
        names = [name for name, _ in (self.runs if runs is None else runs)]
        return self.spark.read.schema(RUN).parquet(*[f"{self.path}/{name}" for name in names]) if names else None

    def grouped(self, docs: DataFrame, groups: int) -> DataFrame:
        """The batch with a group number per document, dealt by it. Texts of a reused id or of none are spread; documents
        without an id have groups of their own."""
        group = F.pmod(F.xxhash64("id", "t"), F.lit(groups))
        return docs.select("id", "t").withColumn("grp", F.when(F.col("id").isNull(), group + NAMELESS).otherwise(group)).repartition(groups, "grp")

    def dedup(self, docs: DataFrame, groups: int) -> DataFrame:
        """(id, n_words, n_removed, removed, kept_text) of each (id, t) of the batch, judged against history and batch."""
        texts = self.grouped(docs, groups)
        runs = texts.groupBy("grp").applyInArrow(emit(self.parts), RUN)
        past = self.history()
        if past is not None:
            runs = runs.unionByName(past)
        answers = runs.repartition(self.parts, "part").groupBy("part").applyInArrow(answer, "grp long, part long, size long, bits binary")
        answers = answers.repartition(groups, "grp")
        out = "id long, n_words long, n_removed long, removed array<struct<first:long,last:long>>, kept_text string"
        return texts.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(mark, out)

    def add(self, docs: DataFrame) -> None:
        """Appends the windows of the batch's (id, t) as one more run, which is history for all later batches, and merges
        runs of one level where there are FAN of them."""
        self.commit([*self.runs, (self.written(docs.select("t").mapInArrow(emit_history(self.parts), RUN)), 0)])
        level = 0
        while len(same := [r for r in self.runs if r[1] == level]) >= FAN:
            self.compact(same, level + 1)
            level += 1

    def compact(self, runs: list[tuple[str, int]] | None = None, level: int | None = None) -> None:
        """Merges the given runs, or all, into one. The old ones are no longer valid, but stay for whoever reads them."""
        old = self.runs if runs is None else runs
        if len(old) > 1:
            made = self.written(self.history(old)), 1 + max(r[1] for r in old) if level is None else level
            self.commit([*[r for r in self.runs if r not in old], made])

    def written(self, runs: DataFrame) -> str:
        name = f"run-{uuid.uuid4().hex}"
        runs.repartition(self.parts, "part").groupBy("part").applyInArrow(merge, RUN).write.parquet(f"{self.path}/{name}")
        return name


MANIFEST = "version long, parts long, runs array<struct<name:string,level:long>>"


def plan_tasks(n_windows: int) -> int:
    """Groups, and ranges, for so many windows: tasks of about TASK_WINDOWS windows, and larger ones where the number of
    runs per task would otherwise exceed the windows per run."""
    return max(1, math.ceil(n_windows / max(TASK_WINDOWS, math.sqrt(n_windows * 512))))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shares: tuple[float, ...] = (0.05, 0.1)) -> DataFrame:
    """One row per row of ``docs``: the id, n_words, n_removed, removed word ranges and kept_text.

    A word is removed when a 13-word window that covers it also starts in a document with a smaller id. Documents go
    through a ``FingerprintIndex`` in batches of ascending ids that end at about these ``shares`` of them: each batch is
    judged against the index, then added to it, and its run is merged with those of its level. Null texts have no words.
    A null id counts as larger than any other; documents with equal ids or none don't remove each other's words. Other
    columns are not read; an empty table gives an empty result. kept_text is the kept words joined by one space.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    size, lo, hi = slim.agg(F.sum(F.octet_length("t")), F.min("id"), F.max("id")).first()
    groups = plan_tasks(max(1, int(size or 0) // 6))
    index = FingerprintIndex.create(spark, groups)
    edges = slim.stat.approxQuantile("id", list(shares), 0.01) if shares and lo is not None else []
    bounds, out = [None, *sorted({int(e) for e in edges if lo <= e < hi}), None], None
    ends = [0.0, *shares, 1.0] if len(bounds) == len(shares) + 2 else [0.0] + [1.0] * (len(bounds) - 1)
    for k, (above, upto) in enumerate(zip(bounds, bounds[1:], strict=False)):
        keep = F.lit(True)
        if above is not None:
            keep = keep & ((F.col("id") > above) | F.col("id").isNull())
        if upto is not None:
            keep = keep & (F.col("id") <= upto)
        batch = slim.filter(keep)
        done = index.dedup(batch, max(1, math.ceil(groups * (ends[k + 1] - ends[k]))))
        if k < len(bounds) - 2:
            index.add(batch)
        out = done if out is None else out.unionByName(done)
    return out.withColumnRenamed("id", id_col)
