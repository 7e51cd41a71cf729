"""Logs of many edits of chunk lists, applied at once.

Within a book edits follow one another, as each counts places in the list that the ones before left. So a book's edits
are replayed in one task, over the places, speakers and edited fields only; texts of the chunks stay where they are and
are joined to the final places. A task goes through the sorted rows of its books as a stream and holds one book. The list
is held in blocks, so an edit costs about the square root of its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.operators.chunks import COLUMNS, FIELDS

#: Edits of a log: book_id, seq (their order), op, at, the columns of a chunk for ``restore``, and ``fields`` for ``update``.
OPS = ("insert", "delete", "restore", "update", "undo")
BLOCK = 1024

#: Rows that are given on at once.
ROWS = 4096

FINAL = "id long, origin long, speaker string, has_text boolean, text string, has_instruct boolean, instruct string, has_status boolean, has_audio boolean, status string, audio_path string"
ARROW = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


class Places:
    """A list of elements by place, in blocks of bounded length."""

    def __init__(self, items: list):
        self.blocks = [items[i : i + BLOCK] for i in range(0, len(items), BLOCK)] or [[]]

    def __len__(self) -> int:
        return sum(map(len, self.blocks))

    def _spot(self, at: int) -> tuple[int, int]:
        for b, block in enumerate(self.blocks):
            if at < len(block) or b == len(self.blocks) - 1:
                return b, at
            at -= len(block)
        raise IndexError(at)

    def __getitem__(self, at: int):
        b, i = self._spot(at)
        return self.blocks[b][i]

    def insert(self, at: int, item) -> None:
        b, i = self._spot(at)
        block = self.blocks[b]
        block.insert(i, item)
        if len(block) > 2 * BLOCK:
            self.blocks[b : b + 1] = [block[:BLOCK], block[BLOCK:]]

    def pop(self, at: int):
        b, i = self._spot(at)
        item = self.blocks[b].pop(i)
        if not self.blocks[b] and len(self.blocks) > 1:
            del self.blocks[b]
        return item

    def remove(self, item) -> None:
        for block in self.blocks:
            if item in block:
                block.remove(item)
                return

    def __iter__(self):
        return (x for block in self.blocks for x in block)


class Element:
    """A chunk that was there (``origin``) or is new, and what edits made of it."""

    __slots__ = ("origin", "values")

    def __init__(self, origin: int | None, speaker: str | None, **values):
        self.origin, self.values = origin, {"speaker": speaker, **values}


def replay(elements: list[Element], edits: list[dict]) -> list[Element]:
    """The list after all edits. What changes nothing is no edit that could be undone."""
    places, undo = Places(elements), []
    for e in edits:
        op, at, n = e["op"], e["at"], len(places)
        inside = at is not None and 0 <= at < n
        if op == "insert" and inside:
            new = Element(None, places[at].values["speaker"], text="", instruct="", status="pending", audio_path=None)
            places.insert(at + 1, new)
            undo.append((places.remove, new))
        elif op == "delete" and inside and n > 1:
            undo.append((places.insert, at, places.pop(at)))
        elif op == "restore" and at is not None:
            new = Element(None, e["speaker"], text=e["text"], instruct=e["instruct"], status=e["status"], audio_path=e["audio_path"])
            places.insert(max(0, min(at, n)), new)
            undo.append((places.remove, new))
        elif op == "update" and inside and any(e[f"sets_{f}"] for f in FIELDS):
            old = places[at]
            undo.append((old.__setattr__, "values", dict(old.values)))
            old.values = old.values | {f: e[f"new_{f}"] for f in FIELDS if e[f"sets_{f}"]} | {"status": "pending"}
        elif op == "undo" and undo:
            undone, *args = undo.pop()
            undone(*args)
    return list(places)


def final_row(book, place: int, x: Element) -> tuple:
    v = x.values
    return book, place, x.origin, v["speaker"], "text" in v, v.get("text"), "instruct" in v, v.get("instruct"), "status" in v, "audio_path" in v, v.get("status"), v.get("audio_path")


def replays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The final places of books, of rows that are sorted by book: first its chunks (kind 0), then its edits (kind 1)."""
    kinds, begun, book, start, steps, out = None, False, None, [], [], []

    def given(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    def finished() -> Iterator[pa.RecordBatch]:
        for i, x in enumerate(replay(start, steps) if begun else ()):
            out.append(final_row(book, i, x))
            if len(out) == ROWS:
                yield given(out)
                out.clear()

    for batch in batches:
        if kinds is None:
            kinds = pa.schema([batch.schema.field("book_id"), *[(name, ARROW[kind]) for name, kind in map(str.split, FINAL.split(","))]])
        names = batch.schema.names
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            e = dict(zip(names, row, strict=True))
            if not begun or e["book_id"] != book:
                yield from finished()
                begun, book, start, steps = True, e["book_id"], [], []
            if e["kind"]:
                steps.append(e)
            else:
                start.append(Element(e["id"], e["speaker"]))
    yield from finished()
    if out:
        yield given(out)


def replayed(chunks: DataFrame, log: DataFrame) -> DataFrame:
    """The chunk lists after all edits of a ``log``, in the order of ``seq`` within each book.

    insert: a blank pending chunk after place ``at`` with the speaker of that place; delete: the chunk at ``at``, unless it
    is the only one; restore: the log's own chunk at ``at``, held within the list; update: ``fields`` (a map; a null value
    is a value) of the chunk at ``at``, which is pending again and keeps its audio; undo: takes back the last edit that
    changed something and is not yet taken back. Edits at places that do not exist, and unknown ones, change nothing.
    Edits of books without chunks only count where they restore. Null books are one book; books without edits are as
    they were. Edits of one ``seq`` go by place.
    """
    same = F.col("book_id").eqNullSafe(F.col("b"))
    given = lambda f: F.coalesce(F.map_contains_key("fields", F.lit(f)), F.lit(False)).alias(f"sets_{f}")
    value = lambda f: F.element_at("fields", F.lit(f)).alias(f"new_{f}")
    told = log.select("book_id", "seq", "op", F.col("at").cast("long").alias("at"), *COLUMNS[2:], *[c(f) for f in FIELDS for c in (given, value)])
    books = log.select(F.col("book_id").alias("b")).distinct()
    edited = chunks.join(books, same, "left_semi")
    slim = edited.select("book_id", F.lit(0).alias("kind"), F.col("id").cast("long").alias("id"), "speaker")
    both = slim.unionByName(told.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    dealt = both.repartition("book_id").sortWithinPartitions("book_id", "kind", "id", F.asc_nulls_last("seq"), F.asc_nulls_last("at")).drop("seq")
    fields = T.StructType([dealt.schema["book_id"], *T.StructType.fromDDL(FINAL).fields])
    final = dealt.mapInArrow(replays, fields)
    old = edited.select(F.col("book_id").alias("b"), F.col("id").alias("i"), F.struct(*COLUMNS[2:]).alias("old"))
    t = final.join(old, same & (F.col("origin") == F.col("i")), "left")
    pick = lambda flag, c: F.when(F.col(flag), F.col(c)).otherwise(F.col(f"old.{c}")).alias(c)
    done = t.select("book_id", "id", "speaker", pick("has_text", "text"), pick("has_instruct", "instruct"), pick("has_status", "status"), pick("has_audio", "audio_path"))
    return chunks.join(books, same, "left_anti").select(*COLUMNS).unionByName(done)
