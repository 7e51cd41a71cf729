"""The operators of this subpackage as queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm import chat, codes, decontam, exact, hilbert, langid, lines, mixing, neardup, quality, search, substring, warc

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality.quality_report(table(spark, sf_dir, "documents")).withColumn("broken_rules", F.array_join("broken_rules", ","))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words of every document."""
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        decontam.items_digest(F.col("item_ids")).alias("items_sha256"), "contaminated",
    )


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate group of every document."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that a window of an earlier document covers."""
    found = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those whose crc32(doc_id) mod 3 is not 1."""
    docs = table(spark, sf_dir, "documents")
    fold = lambda c: F.coalesce(F.crc32(F.encode(F.col(c).cast("string"), "UTF-8")) % 3 == 1, F.lit(False))
    found = langid.identify(docs, docs.filter(~fold("doc_id")))
    return found.select("doc_id", fold("doc_id").alias("held_out"), "lang_pred", "score", "languages")


def op2_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return hilbert.hilbert_shards(table(spark, sf_dir, "documents"))


def op6_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document in the mixture."""
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boilerplate lines of every page, by its host."""
    pages = table(spark, sf_dir, "pages")
    found = lines.drop_boilerplate(pages, lines.host_of(F.col("url")), lines.html_lines(F.col("html")))
    return found.select("page_id", "host", "host_pages", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation rendered for each of its participants."""
    found = chat.rotate(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"], m["end"])), ",")
    return found.select("conv_id", "piece", "participant", "n_turns", "rendered", spans.alias("mask_spans"))


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as it was read back from its WARC record."""
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group and fate of every document among those of equal text."""
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every vector."""
    found = codes.compress(table(spark, sf_dir, "embeddings"))
    return found.rows.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(found.books_sha256).alias("codebooks_sha256"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op3_quality_rules, op4_decontamination, op5_near_duplicates, op7_substring_dedup, op10_language_id, op2_hilbert_sharding, op6_temperature_mixing, op1_line_dedup, op9_perspective_rotation, op8_warc_round_trip, op11_exact_dedup, op12_ranked_search, op13_vector_codes)}
