"""Order-preserving edits of chunk lists (book_id, id, speaker, text, instruct, status, audio_path).

Every edit is a function from a table to the new version; ids are positions from 0 without gaps. Edits of many books
come as a table with one row per book, so that one job edits them all. An edit at a place that does not exist leaves
its book as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyloom.functions.text import strip, text_of

FIELDS = ("speaker", "text", "instruct")


def as_chunks(groups: DataFrame) -> DataFrame:
    """New chunks of grouped entries: pending and without audio."""
    return groups.select("book_id", "id", "speaker", "text", "instruct", F.lit("pending").alias("status"), F.lit(None).cast("string").alias("audio_path"))


COLUMNS = ("book_id", "id", "speaker", "text", "instruct", "status", "audio_path")


def with_edit(chunks: DataFrame, edits: DataFrame) -> DataFrame:
    """Chunks beside their book's edit (null without one) and the book's number of chunks ``n``; one shuffle by book."""
    return chunks.withColumn("n", F.count("*").over(Window.partitionBy("book_id"))).join(edits, "book_id", "left")


def insert_after(chunks: DataFrame, edits: DataFrame) -> DataFrame:
    """A blank pending chunk after place ``at``, with the speaker of that place."""
    hit = F.coalesce(F.col("at").between(F.lit(0), F.col("n") - 1), F.lit(False))
    blank = F.struct((F.col("id") + 1).alias("id"), "speaker", F.lit("").alias("text"), F.lit("").alias("instruct"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("audio_path"))
    own = F.struct((F.col("id") + (hit & (F.col("id") > F.col("at"))).cast("int")).alias("id"), *COLUMNS[2:])
    rows = F.when(hit & (F.col("id") == F.col("at")), F.array(own, blank)).otherwise(F.array(own))
    return with_edit(chunks, edits).select("book_id", F.inline(rows)).select(*COLUMNS)


def delete_at(chunks: DataFrame, edits: DataFrame) -> DataFrame:
    """Without the chunk at place ``at``, unless it is the only one of its book."""
    t = with_edit(chunks, edits).withColumn("hit", F.coalesce((F.col("n") > 1) & F.col("at").between(F.lit(0), F.col("n") - 1), F.lit(False)))
    return t.filter(~(F.col("hit") & (F.col("id") == F.col("at")))).withColumn("id", (F.col("id") - F.when(F.col("hit") & (F.col("id") > F.col("at")), 1).otherwise(0)).cast("long")).select(*COLUMNS)


def restore_at(chunks: DataFrame, removed: DataFrame) -> DataFrame:
    """With the chunk of ``removed`` (columns of a chunk and ``at``) at place ``at``, which is held within the list."""
    back = removed.withColumn("id", F.lit(None).cast("long")).select(*COLUMNS, F.col("at").cast("long").alias("at"))
    t = chunks.select(*COLUMNS, F.lit(None).cast("long").alias("at")).unionByName(back)
    book = Window.partitionBy("book_id")
    place = F.greatest(F.lit(0), F.least(F.max("at").over(book), F.count("id").over(book)))
    t = t.withColumn("place", F.when(F.max("at").over(book).isNotNull(), place))
    moved = F.col("id") + F.coalesce((F.col("id") >= F.col("place")).cast("int"), F.lit(0))
    return t.withColumn("id", F.coalesce(moved, F.col("place")).cast("long")).select(*COLUMNS)


def update_fields(chunks: DataFrame, updates: DataFrame) -> DataFrame:
    """``updates`` has book_id, id and ``fields``, a map of the provided fields only (a null value is a value); any
    provided field makes the chunk pending again and keeps its audio."""
    t = chunks.join(updates, ["book_id", "id"], "left")
    given = lambda f: F.coalesce(F.map_contains_key("fields", f), F.lit(False))
    some = given(FIELDS[0]) | given(FIELDS[1]) | given(FIELDS[2])
    new = [F.when(given(f), F.element_at("fields", F.lit(f))).otherwise(F.col(f)).alias(f) for f in FIELDS]
    return t.select("book_id", "id", *new, F.when(some, F.lit("pending")).otherwise(F.col("status")).alias("status"), "audio_path")


def latest_status(chunks: DataFrame, log: DataFrame) -> DataFrame:
    """Chunks with the last written status and audio of an append-only log (book_id, id, seq, status, audio_path)."""
    last = log.groupBy("book_id", "id").agg(F.max_by(F.struct("status", "audio_path"), "seq").alias("s"))
    t = chunks.join(last, ["book_id", "id"], "left")
    return t.select("book_id", "id", *FIELDS, F.coalesce("s.status", "status").alias("status"), F.when(F.col("s").isNotNull(), F.col("s.audio_path")).otherwise(F.col("audio_path")).alias("audio_path"))


def renderable(chunks: DataFrame, requests: DataFrame) -> DataFrame:
    """Requested chunks (book_id, req_pos, id) that exist and have text, in the order of the request."""
    return requests.join(chunks, ["book_id", "id"]).filter(strip(text_of(F.col("text"))) != "")


SAVED = "array<struct<id:long,speaker:string,text:string,instruct:string,status:string,audio_path:string>>"


def loaded(books: DataFrame, fresh: DataFrame) -> DataFrame:
    """Chunks of ``books`` (book_id, saved: JSON array text): the saved ones where they can be read, else those made
    ``fresh`` from the book's script; a book without either has none. Saved chunks keep their ids."""
    read = books.select("book_id", F.from_json("saved", SAVED).alias("cs"))
    whole = F.coalesce(F.size("cs") > 0, F.lit(False)) & ~F.exists(F.coalesce("cs", F.array().cast(SAVED)), lambda c: c["id"].isNull())
    read = read.withColumn("whole", whole)
    kept = read.filter("whole").select("book_id", F.inline("cs")).select(*COLUMNS)
    return kept.unionByName(fresh.join(read.filter("whole").select("book_id"), "book_id", "left_anti").select(*COLUMNS))


def with_audio(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks whose audio is named and there, by a table of ``path``s."""
    there = files.select(F.col("path").alias("audio_path")).distinct()
    return chunks.filter(F.coalesce("audio_path", F.lit("")) != "").join(there, "audio_path", "left_semi").select(*chunks.columns)


def reset(chunks: DataFrame, books: DataFrame) -> DataFrame:
    """Without the chunks of ``books``, so that these are made anew from their scripts."""
    return chunks.join(books.select("book_id"), "book_id", "left_anti")
