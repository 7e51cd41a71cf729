"""Timelines of rendered chunks (book_id, id, speaker, text, dur_ms) and what is exported from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyloom.functions import text as T
from storyloom.operators import scans

PAUSE_MS = 500
SAME_SPEAKER_PAUSE_MS = 250

#: Characters of a text that its label shows.
SHOWN_IN_LABEL = 80


def timeline(rendered: DataFrame) -> DataFrame:
    """start_ms and end_ms: after all earlier chunks and pauses; none before the first, 250 ms after the same speaker,
    else 500 ms. Chunks without a duration are left out first."""
    w = Window.partitionBy("book_id").orderBy("id")
    before = F.lag("speaker").over(w)
    there = rendered.filter(F.col("dur_ms").isNotNull())
    pause = F.when(F.lag("id").over(w).isNull(), 0).when(before.eqNullSafe(F.col("speaker")), SAME_SPEAKER_PAUSE_MS).otherwise(PAUSE_MS)
    paused = there.withColumn("pause_ms", pause.cast("long"))
    end = F.sum(F.col("pause_ms") + F.col("dur_ms")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return paused.withColumn("end_ms", end.cast("long")).withColumn("start_ms", F.col("end_ms") - F.col("dur_ms"))


def long_timeline(rendered: DataFrame, range_rows: int = scans.RANGE_ROWS) -> DataFrame:
    """As ``timeline``, for books of any length: sums and the last speaker are carried from range to range."""
    there = rendered.filter(F.col("dur_ms").isNotNull())
    t = scans.earlier(scans.dealt(there, "book_id", "id", range_rows=range_rows), ["book_id"], F.col("speaker"), "before")
    pause = F.when(F.col("before").isNull(), 0).when(F.col("before.v").eqNullSafe(F.col("speaker")), SAME_SPEAKER_PAUSE_MS).otherwise(PAUSE_MS)
    t = scans.running(t.withColumn("pause_ms", pause.cast("long")), ["book_id"], F.col("pause_ms") + F.col("dur_ms"), "end_ms").drop("before")
    return t.withColumn("start_ms", F.col("end_ms") - F.col("dur_ms"))


def long_tracks(line: DataFrame) -> DataFrame:
    """As ``tracks``, of a ``long_timeline``: the end of each track is carried from range to range."""
    t = scans.earlier(line, ["book_id", "speaker"], F.col("end_ms"), "before")
    return t.withColumn("gap_ms", F.col("start_ms") - F.coalesce("before.v", F.lit(0))).drop("before")


def tracks(line: DataFrame) -> DataFrame:
    """Silence before each chunk on its speaker's own track."""
    own = Window.partitionBy("book_id", "speaker").orderBy("id")
    return line.withColumn("gap_ms", F.col("start_ms") - F.coalesce(F.lag("end_ms").over(own), F.lit(0)))


def track_summary(line: DataFrame) -> DataFrame:
    """Per speaker: first chunk, spoken and silent time, and the silence that fills the track to the book's length."""
    total = line.groupBy("book_id").agg(F.max("end_ms").alias("total_ms"))
    each = line.groupBy("book_id", "speaker").agg(F.min("id").alias("first_id"), F.sum("dur_ms").cast("long").alias("spoken_ms"), F.max("end_ms").alias("end_ms"))
    return each.join(total, "book_id").select("book_id", "speaker", "first_id", "spoken_ms", (F.col("total_ms") - F.col("end_ms")).alias("pad_ms"), "total_ms")


def track_list(line: DataFrame) -> DataFrame:
    """Per book, one line per speaker's track in the order of first appearance."""
    each = line.groupBy("book_id", "speaker").agg(F.min("id").alias("first_id"))
    files = F.struct("first_id", F.concat(F.lit('file "'), T.file_stem(F.col("speaker")), F.lit('.wav"')).alias("f"))
    got = each.groupBy("book_id").agg(F.array_sort(F.collect_list(files)).alias("fs"))
    return got.select("book_id", F.concat(F.array_join(F.transform("fs", lambda x: x["f"]), "\n"), F.lit("\n")).alias("content"))


def for_labels(rendered: DataFrame) -> DataFrame:
    """Rendered chunks with no more of their texts than labels show, for timelines of which nothing else is made."""
    return rendered.withColumn("text", F.substring("text", 1, SHOWN_IN_LABEL))


def label_lines(line: DataFrame) -> DataFrame:
    """One tab-separated label per chunk: start and end in seconds, [speaker] and the first 80 characters."""
    secs = lambda c: F.format_string("%d.%06d", F.expr(f"{c} div 1000"), F.expr(f"({c} % 1000) * 1000"))
    label = F.concat(secs("start_ms"), F.lit("\t"), secs("end_ms"), F.lit("\t["), "speaker", F.lit("] "), F.substring(T.text_of(F.col("text")), 1, SHOWN_IN_LABEL))
    return line.select("book_id", "id", label.alias("label"))


def file_names(chunks: DataFrame, mp3_bytes: str = "mp3_bytes") -> DataFrame:
    """Name of each rendered file; wav where the mp3 has fewer than 1024 bytes."""
    kind = F.when(F.col(mp3_bytes) < 1024, F.lit("wav")).otherwise(F.lit("mp3"))
    return chunks.withColumn("file_name", F.concat(F.format_string("voiceline_%04d_", F.col("id") + 1), T.file_stem(F.col("speaker")), F.lit("."), kind))
