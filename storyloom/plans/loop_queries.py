"""Queries over the loops of a language model. Each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom.operators import loops
from storyloom.plans import tables
from storyloom.plans.project_queries import REVIEW_TEMPLATE, SHOWN_TEMPLATE


def generating(spark, sf):
    return loops.generated(tables.prompt_parts(spark, sf), tables.digest_model, SHOWN_TEMPLATE)


def generated_parts(spark, sf):
    """Prompt, attempt and number of entries of every chunk of every book."""
    return generating(spark, sf).select("book_id", F.col("no").alias("chunk_no"), F.md5("prompt").alias("prompt_md5"), "attempt", "outcome", F.size("entries").cast("long").alias("n_entries"))


def generated_entries(spark, sf):
    """The script that the loop gives for every book."""
    return loops.script_of(generating(spark, sf))


def reviewing(spark, sf):
    return loops.reviewed(tables.entries(spark, sf), tables.digest_reviewer, REVIEW_TEMPLATE)


def reviewed_parts(spark, sf):
    """Prompt and outcome of every batch of every book."""
    return reviewing(spark, sf).select("book_id", F.col("no").alias("batch_no"), F.md5("prompt").alias("prompt_md5"), "attempt", "outcome", F.size("entries").cast("long").alias("n_entries"))


def reviewed_script(spark, sf):
    """The script after the review, places counted anew."""
    return loops.script_of(reviewing(spark, sf))


ALL = (generated_parts, generated_entries, reviewed_parts, reviewed_script)
