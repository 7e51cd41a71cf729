"""Calls of a language model part after part, where each prompt tells what the model made of the parts before.

Within a book the calls follow one another; books go side by side. A job takes a range of part numbers of all books: rows
are dealt by book and sorted, and a task goes through them as a stream with the state of one book, who has spoken and the
last entries. What a range gave is written under a folder, so a run that was broken off goes on after the last range that
was finished, and reads its state from there.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from storyloom.functions import jsonfix
from storyloom.functions.text import NARRATOR
from storyloom.operators import script
from storyloom.operators.models import ATTEMPTS
from storyloom.operators.prompts import SHOWN, SHOWN_IN_REVIEW
from storyloom.sources.scratch import exists, new_path

#: (prompt, attempt) -> response; may raise.
LanguageModel = Callable[[str, int], str]

#: Part numbers of one job. Fewer lose less when a run is broken off, more need fewer jobs.
EVERY = 64

#: Parts that a task turns into Python's own values, and gives on, at once. An Arrow batch has up to thousands.
ROWS = 32

ENTRIES = "array<struct<speaker:string,text:string,instruct:string>>"
STATE = f"struct<names:array<string>,tail:{ENTRIES}>"
MADE = f"prompt string, attempt int, outcome string, entries {ENTRIES}"

ENTRY_TYPE = pa.list_(pa.struct([(f, pa.string()) for f in jsonfix.FIELDS]))

WORD_EDGE, NOT_WORD = re.compile(r"\s+"), re.compile(r"[^\w\s]")


def entry_line(e: dict) -> str:
    return json.dumps({f: e.get(f) for f in jsonfix.FIELDS}, ensure_ascii=False)


def filled(template: str, **values: str) -> str:
    """A template with {name} places; values are not searched for places themselves."""
    return re.sub(r"\{(" + "|".join(values) + r")\}", lambda m: values[m[1]], template)


def asked(model: LanguageModel, prompt: str, attempts: int) -> tuple[int | None, list[dict]]:
    """The first attempt whose response has entries, and these; an attempt that raises is one without."""
    for attempt in range(attempts):
        try:
            response = model(prompt, attempt)
        except Exception:  # a model may fail in any way
            continue
        if found := jsonfix.entries_in(response):
            return attempt, found
    return None, []


def n_words(entries: list[dict]) -> int:
    return sum(len([w for w in WORD_EDGE.split(NOT_WORD.sub("", (e.get("text") or "").lower())) if w]) for e in entries)


def section(title: str, entries: list[dict]) -> list[str]:
    return [title, *map(entry_line, entries)] if entries else []


class Generation:
    """Parts are texts; the state is who spoke so far and the last entries of all parts before."""

    payload = ("label", "text")

    def __init__(self, model: LanguageModel, template: str, attempts: int = ATTEMPTS):
        self.model, self.template, self.attempts = model, template, attempts

    def step(self, row: dict, names: set[str], tail: list[dict]) -> tuple[str, int | None, str, list[dict], list[dict]]:
        told = [f"Characters in this book: {', '.join(sorted(names))}"] if names else []
        context = "\n".join([row["label"], *told, *section("\nPrevious section ended with:", tail)])
        prompt = filled(self.template, context=context, chunk=row["text"] or "")
        attempt, entries = asked(self.model, prompt, self.attempts)
        return prompt, attempt, "made" if entries else "nothing", entries, (tail + entries)[-SHOWN:]

    @staticmethod
    def tail_after(tail: Column, entries: Column) -> Column:
        both = F.concat(tail, F.flatten(entries))
        return F.slice(both, F.greatest(F.lit(1), F.size(both) - (SHOWN - 1)), F.lit(SHOWN))


class Review:
    """Parts are batches of entries; the state is how the batch before ended, as the gate let it through: a batch whose
    response has no entries, or fewer than LOSS_LIMIT of its words, stays as it was."""

    payload = ("n", "batch")

    def __init__(self, model: LanguageModel, template: str, attempts: int = ATTEMPTS, limit: float = script.LOSS_LIMIT):
        self.model, self.template, self.attempts, self.limit = model, template, attempts, limit

    def step(self, row: dict, names: set[str], tail: list[dict]) -> tuple[str, int | None, str, list[dict], list[dict]]:
        own = row["batch"]
        context = "\n".join([f"Batch {row['no'] + 1} of {row['n']}.", *section("\nPrevious batch ended with:", tail)])
        prompt = filled(self.template, context=context, batch=json.dumps(own, indent=2, ensure_ascii=False))
        attempt, entries = asked(self.model, prompt, self.attempts)
        words = n_words(own)
        outcome = "failed" if not entries else "lost" if words and n_words(entries) / words < self.limit else "passed"
        out = entries if outcome == "passed" else own
        return prompt, attempt, outcome, out, out[-SHOWN_IN_REVIEW:]

    @staticmethod
    def tail_after(tail: Column, entries: Column) -> Column:
        last = F.element_at(entries, -1)
        return F.slice(last, F.greatest(F.lit(1), F.size(last) - (SHOWN_IN_REVIEW - 1)), F.lit(SHOWN_IN_REVIEW))


def stepped(batches: Iterator[pa.RecordBatch], plan: Generation | Review) -> Iterator[pa.RecordBatch]:
    """What the model makes of rows that are sorted by book and part; no more than ROWS of them are held at a time."""
    started, book, names, tail = False, None, set(), []
    for batch in (whole.slice(begin, ROWS) for whole in batches for begin in range(0, whole.num_rows, ROWS)):
        kind = pa.schema([("book_id", batch.schema.field("book_id").type), ("no", pa.int64()), ("prompt", pa.string()), ("attempt", pa.int32()), ("outcome", pa.string()), ("entries", ENTRY_TYPE)])
        out = []
        for row in batch.to_pylist():
            if not started or row["book_id"] != book:
                state = row["state"] or {}
                started, book, names, tail = True, row["book_id"], set(state.get("names") or ()), list(state.get("tail") or ())
            prompt, attempt, outcome, entries, tail = plan.step(row, names, tail)
            names |= {e["speaker"] for e in entries if e["speaker"] and e["speaker"] != NARRATOR}
            out.append({"book_id": book, "no": row["no"], "prompt": prompt, "attempt": attempt, "outcome": outcome, "entries": entries})
        yield pa.RecordBatch.from_pylist(out, kind)


def walked(rows: DataFrame, plan: Generation | Review) -> DataFrame:
    """(book_id, no, prompt, attempt, outcome, entries) of rows (book_id, no, ``state`` in a book's first, payload)."""
    dealt = rows.repartition("book_id").sortWithinPartitions("book_id", "no").select("book_id", "no", "state", *plan.payload)
    fields = T.StructType([dealt.schema["book_id"], T.StructField("no", T.LongType()), *T.StructType.fromDDL(MADE).fields])
    return dealt.mapInArrow(lambda batches: stepped(batches, plan), fields)


def next_state(state: DataFrame, made: DataFrame, plan: Generation | Review) -> DataFrame:
    """(book_id, state) of every book after the parts that were ``made`` of it."""
    one = made.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("no", "entries"))).alias("parts"))
    t = one.join(state.withColumnRenamed("book_id", "b"), F.col("book_id").eqNullSafe(F.col("b")), "left")
    entries = F.transform("parts", lambda p: p["entries"])
    said = F.filter(F.transform(F.flatten(entries), lambda e: e["speaker"]), lambda s: s.isNotNull() & ~s.isin("", NARRATOR))
    names = F.array_union(F.coalesce("state.names", F.array().cast("array<string>")), said)
    tail = plan.tail_after(F.coalesce("state.tail", F.array().cast(ENTRIES)), entries)
    # Books that had no part in this range have none in later ones either.
    return t.select("book_id", F.struct(names.alias("names"), tail.alias("tail")).cast(STATE).alias("state"))


def looped(parts: DataFrame, plan: Generation | Review, folder: str | None = None, every: int = EVERY) -> DataFrame:
    """(book_id, no, prompt, attempt, outcome, entries) of ``parts`` (book_id, no from 0 without gaps, payload).

    ``folder`` keeps the ranges that are finished; a call with the same folder does not make them again. Null book ids are
    one book. A part of which nothing comes leaves the state as it is. An empty table gives an empty result.
    """
    spark = parts.sparkSession
    folder = folder or new_path(spark, "loop")
    source = f"{folder}/parts"
    if not exists(spark, f"{source}/_SUCCESS"):
        parts.select("book_id", F.col("no").cast("long").alias("no"), *plan.payload, F.expr(f"no div {every}").alias("range")).write.mode("overwrite").partitionBy("range").parquet(source)
    kept = T.StructType([parts.schema["book_id"], T.StructField("no", T.LongType()), *[parts.schema[c] for c in plan.payload], T.StructField("range", T.LongType())])
    rows = spark.read.schema(kept).parquet(source)
    made_type = T.StructType([parts.schema["book_id"], T.StructField("no", T.LongType()), *T.StructType.fromDDL(MADE).fields])
    state_type = T.StructType([parts.schema["book_id"], *T.StructType.fromDDL(f"state {STATE}").fields])
    last = rows.agg(F.max("range")).first()[0]
    state = spark.createDataFrame([], state_type)
    done = []
    for r in range(0 if last is None else last + 1):
        here = f"{folder}/made/range={r}"
        if not exists(spark, f"{here}/_SUCCESS"):
            mine = rows.filter(F.col("range") == r)
            begun = mine.join(state.withColumnRenamed("book_id", "b"), F.col("book_id").eqNullSafe(F.col("b")), "left")
            first = begun.withColumn("state", F.when(F.col("no") == r * every, F.col("state")))
            walked(first, plan).write.mode("overwrite").parquet(here)
        done.append(here)
        if r < last:
            there = f"{folder}/state/range={r}"
            if not exists(spark, f"{there}/_SUCCESS"):
                next_state(state, spark.read.schema(made_type).parquet(here), plan).write.mode("overwrite").parquet(there)
            state = spark.read.schema(state_type).parquet(there)
    return spark.read.schema(made_type).parquet(*done) if done else spark.createDataFrame([], made_type)


def generated(parts: DataFrame, model: LanguageModel, template: str, folder: str | None = None, every: int = EVERY, attempts: int = ATTEMPTS) -> DataFrame:
    """(book_id, no, prompt, attempt, outcome, entries) of chunks of text (book_id, chunk_no, text): each prompt has the
    chunk and, as context, its position, who spoke in what the model gave for all earlier chunks, and the last entries of
    these. A model that fails, or whose response has no entries, is asked again; after the last attempt the chunk has
    none (``nothing``). Null texts are empty. See ``looped``."""
    labelled = script.position_label(parts.withColumn("chunk_no", F.col("chunk_no").cast("long"))).withColumnRenamed("chunk_no", "no")
    return looped(labelled, Generation(model, template, attempts), folder, every)


def reviewed(entries: DataFrame, model: LanguageModel, template: str, folder: str | None = None, size: int = 25, every: int = EVERY, attempts: int = ATTEMPTS) -> DataFrame:
    """(book_id, no, prompt, attempt, outcome, entries) of batches of ``size`` entries (book_id, pos, speaker, text,
    instruct): each prompt tells how the batch before ended after its own review. ``outcome`` is passed, or failed or
    lost where the batch stays as it was: no entries in any response, or too few of its words. See ``looped``."""
    e = F.struct("idx", F.struct(*jsonfix.FIELDS).alias("e"))
    t = script.batches(entries, size).groupBy("book_id", F.col("batch_no").alias("no")).agg(F.transform(F.array_sort(F.collect_list(e)), lambda x: x["e"]).alias("batch"))
    return looped(t.withColumn("n", F.count("*").over(Window.partitionBy("book_id"))), Review(model, template, attempts), folder, every)


def script_of(made: DataFrame) -> DataFrame:
    """(book_id, pos, speaker, text, instruct): the entries of all parts in order; places come from counts before parts."""
    before = F.sum(F.size("entries")).over(Window.partitionBy("book_id").orderBy("no")) - F.size("entries")
    t = made.withColumn("before", before).select("book_id", "before", F.posexplode("entries").alias("i", "e"))
    return t.select("book_id", (F.col("before") + F.col("i")).cast("long").alias("pos"), "e.*")


def empty_books(made: DataFrame) -> DataFrame:
    """(book_id): books for which no part gave an entry; a script is not saved for these."""
    return made.groupBy("book_id").agg(F.sum(F.size("entries")).alias("n")).filter("n = 0").select("book_id")

