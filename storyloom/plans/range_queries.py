"""Queries by ranges, over versions and over archives and headers. Each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom.operators import script, timeline
from storyloom.plans import tables
from storyloom.sources import archives, audio, files
from storyloom.sources.scratch import new_path
from storyloom.sources.versions import Versions

ROWS = 1 << 12


def group_chunks_ranges(spark, sf):
    """Chunks of all books by ranges of entries."""
    got = script.long_render_chunks(tables.entries(spark, sf), range_rows=ROWS)
    return got.select("book_id", "id", "speaker", "instruct", "text", F.col("n_entries").cast("long").alias("n_entries"))


def merge_narrators_ranges(spark, sf):
    """Merged narration of all books by ranges of entries."""
    got = script.long_merged_narration(tables.entries(spark, sf), range_rows=ROWS)
    return got.select("book_id", "pos", "speaker", "text", F.col("n_entries").cast("long").alias("n_entries"))


def library_line(spark, sf):
    """All books as one."""
    e = tables.entries(spark, sf).withColumn("pos", F.col("book_id") * 100000 + F.col("pos")).withColumn("book_id", F.lit(0).cast("long"))
    return timeline.long_timeline(tables.rendered(e), ROWS)


def library_timeline(spark, sf):
    return library_line(spark, sf).select("id", "speaker", "start_ms", "end_ms")


def library_tracks(spark, sf):
    return timeline.long_tracks(library_line(spark, sf)).select("id", "speaker", "gap_ms")


def status_versions(spark, sf):
    """Statuses of all chunks after three commits, one of them made from an older version, and a merge."""
    t = Versions(spark, new_path(spark, "versions"), ("book_id", "id"), "book_id long, id long, status string, audio_path string")
    first = t.commit(tables.listed(spark, sf), 0)
    mark = lambda rows, status: rows.withColumn("status", F.lit(status))
    t.commit(mark(t.read().filter("id % 3 = 0"), "generating"), first)
    t.commit(mark(t.read(first).filter("id % 3 = 1"), "error"), first)
    t.merge()
    t.change(lambda now: mark(now.filter("id % 6 = 0"), "done"))
    return t.read()


def wav_durations(spark, sf):
    """Durations from the headers of waves, one for each turn: 16 bits at rates that vary, parts before the sound in some,
    and sizes that are not told in others."""
    t = tables.table(spark, sf, "conversations").withColumn("rate", F.element_at(F.array(F.lit(16000), F.lit(24000), F.lit(44100)), (F.col("turn") % 3 + 1).cast("int")))
    t = t.withColumn("bytes", F.length("text") * 2000).withColumn("kind", F.expr("(conv_id + turn) % 4"))
    digits = lambda c, n: F.concat(*[F.lpad(F.hex(F.shiftright(c.cast("long"), 8 * i).bitwiseAND(255)), 2, "0") for i in range(n)])
    fmt = F.concat(F.lit(audio.FMT), digits(F.lit(16), 4), digits(F.lit(1), 2), digits(F.lit(1), 2), digits(F.col("rate"), 4), digits(F.col("rate") * 2, 4), digits(F.lit(2), 2), digits(F.lit(16), 2))
    extra = F.when(F.col("kind") == 1, F.concat(F.hex(F.lit("LIST")), digits(F.lit(5), 4), F.lit("00" * 6))).otherwise(F.lit(""))
    size = F.when(F.col("kind") == 2, F.lit(0xFFFFFFFF)).otherwise(F.col("bytes"))
    head = F.concat(F.lit(audio.RIFF), digits(F.lit(0), 4), F.lit(audio.WAVE), extra, fmt, extra, F.lit(audio.DATA), digits(size, 4))
    content = F.unhex(F.when(F.col("kind") == 3, F.concat(F.lit("00"), head)).otherwise(head))
    return t.select("conv_id", "turn", audio.wav_ms(content, F.octet_length(content) + F.col("bytes")).alias("dur_ms"))


def archive_members(spark, sf):
    """Documents of each source as archives of texts, written as files and read again."""
    d = tables.table(spark, sf, "documents").withColumn("name", F.concat(F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    path = new_path(spark, "archives")
    # A file for each archive: Spark's text sink takes the bytes as one base64 line.
    packed = archives.archives(d.select("source", "name", F.col("text").alias("content")), "source")
    packed.select(F.replace(F.base64("archive"), F.lit("\r\n"), F.lit("")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    found = archives.unpacked(spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.unbase64("value").alias("content")))
    return found.select("name", "length", F.sha2("content", 256).alias("sha256"), "error")


def file_listing(spark, sf):
    """Written scripts and manifests of all sources, listed and read: sizes, folders, and what is broken."""
    root = new_path(spark, "library")
    rows = tables.table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
    body = F.concat(F.lit('[{"id": "'), "source", F.lit('", "n": '), F.col("n").cast("string"), F.when(F.col("n") % 2 == 0, F.lit("}]")).otherwise(F.lit("}")))
    rows.select(F.col("source").alias("folder"), body.alias("value")).repartition("folder").write.partitionBy("folder").option("maxRecordsPerFile", 1).text(root)
    seen = files.list_files(spark, root, "*.txt").withColumn("folder", files.folder_of(F.col("path"), root))
    read = files.read_manifest(spark, f"{root}/*", "id string, n long").select(files.folder_of(F.col("path"), root).alias("folder"), "n")
    return seen.join(read, "folder", "left").select("folder", "length", "n")


def folder_listing(spark, sf):
    """Folders in order of their names, with files and bytes in each."""
    root = new_path(spark, "outputs")
    d = tables.table(spark, sf, "documents").select("lang", F.concat(F.lit("line "), F.col("doc_id").cast("string")).alias("value"))
    d.repartition("lang").write.partitionBy("lang").text(root)
    found = files.list_folders(spark, root)
    return found.select("folder", "rank", F.col("n_files").cast("long").alias("n_files"), F.col("bytes").cast("long").alias("bytes"))


ALL = (file_listing, folder_listing, group_chunks_ranges, merge_narrators_ranges, library_timeline, library_tracks, status_versions, wav_durations, archive_members)
