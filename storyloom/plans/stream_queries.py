"""Queries over logs of many steps, of which some run a stream to its end. Each takes (spark, sf_dir) and reads whole
tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom.operators import edits
from storyloom.plans import project_queries, tables
from storyloom.sources.scratch import new_path, saved
from storyloom.streaming import ring
from storyloom.streaming.render_jobs import RenderJob


#: Batches of requests, and files of each: a task writes one of these.
BATCHES, FILES = 3, 16


def render_job(spark, sf):
    """Requests of all books through the stream in three batches, books whole in a file. After the first reading of the chunks, every
    fourth book has lost those from place 20 on."""
    config, want = project_queries.render_requests(spark, sf)
    requests, log = new_path(spark, "requests"), new_path(spark, "render-log")
    want.repartition(BATCHES * FILES, "book_id").write.json(requests)
    before = saved(tables.listed(spark, sf), "chunks")
    after = before.filter("NOT (book_id % 4 = 0 AND id >= 20)")
    job = RenderJob(spark, log, lambda: before, lambda: config, tables.faulty_speech, 12, True, {"max_items": 5}, reload=lambda: after)
    job.start(requests, f"{log}/checkpoint", FILES).awaitTermination()
    return job


def render_stream(spark, sf):
    """The chunks after the stream has taken all requests."""
    return render_job(spark, sf).current().select("book_id", "id", "status", "audio_path")


def render_failures(spark, sf):
    """Lines that failed, with what went wrong."""
    return render_job(spark, sf).failures()


def log_ring(spark, sf):
    """The last 1,000 lines of every task, kept as state over batches of its log."""
    source, sink = new_path(spark, "log"), new_path(spark, "tails")
    log = tables.table(spark, sf, "events").select(F.col("event_type").alias("task"), F.col("event_id").alias("seq"), F.col("props").alias("line"))
    log.repartitionByRange(4, "seq").write.json(source)
    ring.run_tails(spark, source, f"{sink}-checkpoint", sink, files=1).awaitTermination()
    return ring.latest(spark, sink)


def edits_replayed(spark, sf):
    """The chunk lists of all books after a log of edits of each."""
    return edits.replayed(tables.listed(spark, sf), tables.edit_log(spark, sf))


ALL = (edits_replayed, render_stream, render_failures, log_ring)
