"""Places for models: deterministic stand-ins with the contracts of a language model and a speech model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.functions.jsonfix import entries_of

ATTEMPTS = 3
MS_PER_CHAR = 60

Synthesiser = Callable[[pd.Series, pd.Series], pd.Series]

#: Columns that a call gets: one row a line of a sub-batch, the shortest first.
LINE = ("text", "instruct", "speaker", "voice", "adapter")

#: Columns that a call gives, and those that tell a sub-batch from others.
MADE, SUB_BATCH = ("dur_ms", "mp3_bytes"), ("route", "key", "book_id", "batch", "sub_no")

#: A call for one sub-batch: lines to dur_ms and mp3_bytes, the size of what an encoder made of the audio, in the same order.
Call = Callable[[pd.DataFrame], pd.DataFrame]


def by_lists(call: Callable[[dict[str, list]], dict[str, list]]) -> Call:
    """Marks a call that takes and gives a dict of lists in place of a data frame, which costs a call of few lines more
    than they do."""
    call.by_lists = True
    return call


#: Loads the voice of a route and key, and gives the call for its sub-batches.
Speech = Callable[[str, str], Call]

#: Tasks that share the calls of one voice.
SPREAD = 64

#: Rows that a task turns into Python's own values, or gives on, at once.
ROWS = 1024

MP3_BYTES_PER_MS = 16


def spoken_ms(text: pd.Series, voice: pd.Series) -> pd.Series:
    """Stand-in for speech: 60 ms a character."""
    return text.fillna("").str.len() * MS_PER_CHAR


def synthesised(chunks: DataFrame, model: Synthesiser = spoken_ms) -> DataFrame:
    """Chunks (book_id, id, text, voice) with dur_ms, ok and error; blank texts should be filtered before. A failing
    batch marks its rows failed and others go on."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = frame[["book_id", "id"]].assign(dur_ms=None, ok=False, error=None)
            try:
                out["dur_ms"] = model(frame["text"], frame["voice"]).astype("Int64")
                out["ok"] = True
            except Exception as e:  # a model may fail in any way
                out["error"] = str(e)
            yield out

    return chunks.select("book_id", "id", "text", "voice").mapInPandas(run, "book_id long, id long, dur_ms long, ok boolean, error string")


def spoken(route: str, key: str) -> Call:
    """Stand-in for speech: 60 ms a character, 128 kbit/s."""

    @by_lists
    def call(lines: dict[str, list]) -> dict[str, list]:
        ms = [len(t) * MS_PER_CHAR for t in lines["text"]]
        return {"dur_ms": ms, "mp3_bytes": [x * MP3_BYTES_PER_MS for x in ms]}

    return call


class Unvoiced(Exception):
    """A voice that no call can be made for."""


def whole_sub_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each sub-batch, of batches that are sorted by SUB_BATCH and may end within one."""
    own, held = None, []
    for batch in batches:
        for begin in range(0, batch.num_rows, ROWS):
            for row in batch.slice(begin, ROWS).to_pylist():
                mine = tuple(row[c] for c in SUB_BATCH)
                if mine != own and held:
                    yield held
                    held = []
                own = mine
                held.append(row)
    if held:
        yield held


def results(call: Call, rows: list[dict]) -> dict[str, list]:
    """What a call makes of the lines of a sub-batch: dur_ms and mp3_bytes of each."""
    lines = {c: [r[c] for r in rows] for c in LINE}
    made = call(lines if getattr(call, "by_lists", False) else pd.DataFrame(lines))
    sizes = {0} if made is None else {len(made[c]) for c in MADE} if isinstance(made, dict) else {len(made)}
    if sizes != {len(rows)}:
        raise ValueError(f"{len(rows)} lines gave {min(sizes)} results")
    return {c: [x if type(x) is int else None if pd.isna(x) else int(x) for x in made[c]] for c in MADE}


def called(plan: DataFrame, speech: Speech) -> DataFrame:
    """(book_id, batch, item, id, speaker, dur_ms, mp3_bytes, call_error) of planned items; see ``render.performed``. What a task holds is one
    sub-batch, which the plan bounds, and an Arrow batch of rows."""
    dealt = plan.repartition("route", "key", F.pmod(F.xxhash64("book_id", "batch", "sub_no"), F.lit(SPREAD))).sortWithinPartitions("route", "key", "book_id", "batch", "sub_no", "idx")
    kept = ["book_id", "batch", "item", "id", "speaker"]
    fields = T.StructType([plan.schema["book_id"], *T.StructType.fromDDL("batch long, item long, id long, speaker string, dur_ms long, mp3_bytes long, call_error string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = []

        def seen() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds[:] = kinds or [batch.schema.field("book_id"), *[(c, pa.int64()) for c in kept[1:4]], ("speaker", pa.string()), *[(c, pa.int64()) for c in MADE], ("call_error", pa.string())]
                yield batch

        voice, call, out = None, None, []
        for rows in whole_sub_batches(seen()):
            first, error, found = rows[0], None, {c: [None] * len(rows) for c in MADE}
            try:
                if first["route"] == "lora" and not first["adapter"]:
                    raise Unvoiced("No adapter")
                if (mine := (first["route"], first["key"])) != voice:
                    voice, call = None, speech(*mine)
                    voice = mine
                found = results(call, rows)
            except Exception as e:  # a model may fail in any way
                error = str(e) if isinstance(e, Unvoiced) else f"Batch error: {e}"
            for i, row in enumerate(rows):
                out.append({c: row[c] for c in kept} | {c: found[c][i] for c in MADE} | {"call_error": error})
            if len(out) >= ROWS:
                yield pa.RecordBatch.from_pylist(out, pa.schema(kinds))
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, pa.schema(kinds))

    return dealt.select(*SUB_BATCH, "item", "id", *LINE).mapInArrow(run, fields)


def answered(responses: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """Per (book_id, chunk_no) the entries of the first of its responses (attempt, response) that has some; null where
    none of the first ``attempts`` has. Responses of a chunk are parsed at once, in any order."""

    parsed = responses.filter(F.col("attempt") < attempts).withColumn("entries", entries_of(F.col("response"))["entries"])
    good = F.when(F.size("entries") > 0, F.struct("attempt", "entries"))
    return parsed.groupBy("book_id", "chunk_no").agg(F.min_by(good, F.when(good.isNotNull(), F.col("attempt"))).alias("g")).select("book_id", "chunk_no", "g.attempt", "g.entries")
