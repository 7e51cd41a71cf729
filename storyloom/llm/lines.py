"""Line dedup by site-relative frequency, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.shared import saved, spread_join

RATIO = 0.3
LEAST_PAGES = 3
LEAST_COPIES = 2

#: HTML elements that begin and end a line of the rendered page.
BLOCK_TAGS = "address article aside blockquote body br dd div dl dt footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table td th title tr ul".split()

HIDDEN = r"(?is)<!--.*?-->|<script[\s>].*?</script>|<style[\s>].*?</style>"
BREAK = r"(?i)</?(" + "|".join(BLOCK_TAGS) + r")(\s[^>]*)?/?>"
TAG = r"</?[A-Za-z!][^>]*>"


def html_lines(html: Column) -> Column:
    """Text of a page, one block element per line; scripts, styles and comments are left out, entities are kept."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, "")
    text = F.regexp_replace(text, r"[\r\n]+", " ")
    return F.regexp_replace(F.regexp_replace(text, BREAK, "\n"), TAG, "")


def host_of(url: Column) -> Column:
    """Lower-case host of an http or https URL; empty for null and other URLs."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]*@)?([^/?#:@]+)", 2))


def trimmed_lines(text: Column) -> Column:
    """Lines without surrounding blanks; lines of blanks only are left out."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(" \t\r\x0b\x0c")))
    return F.filter(lines, lambda x: x != "")


def line_key(line: Column) -> Column:
    return F.unhex(F.md5(line.cast("binary")))


def drop_boilerplate(pages: DataFrame, host: Column, text: Column, id_col: str = "page_id", ratio: float = RATIO, least_pages: int = LEAST_PAGES, least_copies: int = LEAST_COPIES) -> DataFrame:
    """One row per row of ``pages``: the id, host, host_pages, n_lines, n_dropped and kept_text.

    A line is dropped when more than ``ratio`` of its host's pages and at least ``least_copies`` of them have it, and the
    host has at least ``least_pages`` pages; so what one page of a host of three has alone stays. Every row is a page,
    also a repeated one; a line counts once per page. Lines are compared after trimming; kept_text is the kept lines
    joined by newlines. A null text has no lines. Null hosts form the host ''. A null id stays null. An empty table
    gives an empty result.

    Pages send each distinct line's 16-byte digest, counted before the shuffle. A host's list of frequent lines has at
    most (lines per page) / ratio entries on average, whatever the number of its pages, so it travels as one row; pages
    of hot hosts are not dealt by host to meet it.
    """
    pages = pages.withColumn("__host", F.coalesce(host, F.lit("")))
    keys = pages.select(F.col("__host").alias("host"), F.explode(F.array_distinct(F.transform(trimmed_lines(text), line_key))).alias("key"))
    often = keys.groupBy("host", "key").agg(F.count("*").alias("n")).filter(F.col("n") >= least_copies)
    hosts = pages.groupBy(F.col("__host").alias("host")).agg(F.count("*").alias("host_pages"))
    frequent = often.join(hosts.filter(F.col("host_pages") >= least_pages), "host").filter(F.col("n") > F.col("host_pages") * ratio)
    listed = hosts.join(frequent.groupBy("host").agg(F.collect_set("key").alias("drop")), "host", "left")
    listed = saved(listed.select(F.col("host").alias("__host"), F.col("host_pages").alias("__pages"), F.col("drop").alias("__drop")), "frequent_lines")
    total = listed.agg(F.coalesce(F.sum("__pages"), F.lit(0))).first()[0]
    out = spread_join(pages, listed, ["__host"], "__pages", total)
    out = out.select(F.col(id_col).alias("id"), "__host", "__pages", "__drop", trimmed_lines(text).alias("lines"))
    kept = F.when(F.col("__drop").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains(F.col("__drop"), line_key(x))))
    return out.withColumn("kept", kept).select(
        F.col("id").alias(id_col), F.col("__host").alias("host"), F.col("__pages").alias("host_pages"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("kept_text"),
    )
