"""Reading and writing of books, scripts, manifests, metadata and prompt files. All paths go to Spark's readers."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.functions.text import pretty_entries, strip
from storyloom.operators.ranks import ranked

ENTRY = "speaker string, type string, text string, instruct string"
SEPARATOR = "---SEPARATOR---"


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): each file as one UTF-8 text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_scripts(spark: SparkSession, path: str, schema: str = ENTRY) -> DataFrame:
    """(path, pos, fields...): the entries of JSON array files, in file order. A file that is no array has none."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    arrays = whole.filter(strip(F.col("value")).startswith("[")).select("path", F.from_json("value", T.ArrayType(T.StructType.fromDDL(schema))).alias("entries"))
    return arrays.select("path", F.posexplode("entries").alias("pos", "e")).select("path", "pos", "e.*")


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON array file; none if it is missing or broken."""
    try:
        found = read_scripts(spark, path, schema)
    except AnalysisException:
        return spark.createDataFrame([], T.StructType([T.StructField("path", T.StringType()), T.StructField("pos", T.IntegerType()), *T.StructType.fromDDL(schema)]))
    return found


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per non-blank line; the alias ``audio`` stands in for a missing ``audio_filepath``."""
    rows = spark.read.schema(schema).json(path)
    if {"audio", "audio_filepath"} <= set(rows.columns):
        rows = rows.withColumn("audio_filepath", F.coalesce("audio_filepath", "audio"))
    return rows


def count_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(path, n): non-blank lines per file."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    return lines.groupBy("path").agg(F.count_if(strip(F.col("value")) != "").alias("n"))


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name, length, modified) of files under a folder, newest first; contents are not read. Spark's
    reader leaves out empty files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified")).orderBy(F.desc("modified"), "path")


def folder_of(path: Column, root: str) -> Column:
    """The folder below ``root`` that a path is in, null for files of the root itself."""
    rel = F.regexp_replace(path, "^.*/" + re.escape(root.rstrip("/").rsplit("/", 1)[-1]) + "/", "")
    return F.when(rel.contains("/"), F.regexp_replace(rel, "/[^/]*$", ""))


def list_folders(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(folder, n_files, bytes, rank): folders of any depth below ``root`` that have files, ascending by name."""
    there = list_files(spark, root, pattern).withColumn("folder", folder_of(F.col("path"), root)).filter(F.col("folder").isNotNull())
    found = there.groupBy("folder").agg(F.count("*").alias("n_files"), F.sum("length").alias("bytes"))
    return ranked(found, "folder").withColumn("rank", F.col("rank") + 1).drop("total")


def saved_scripts(files: DataFrame) -> DataFrame:
    """Scripts among listed files, by name, with whether a voice configuration lies beside them."""
    config = files.filter(F.endswith("name", F.lit(".voice_config.json"))).select(F.regexp_replace("name", r"\.voice_config\.json$", "").alias("script"), F.lit(True).alias("has_voice_config"))
    scripts = files.filter(F.endswith("name", F.lit(".json")) & ~F.endswith("name", F.lit(".voice_config.json"))).withColumn("script", F.regexp_replace("name", r"\.json$", ""))
    return scripts.join(config, "script", "left").withColumn("has_voice_config", F.coalesce("has_voice_config", F.lit(False)))


def prompt_parts(value: Column) -> Column:
    """Struct (system, user) of a prompt file; anything but exactly two parts raises."""
    parts = F.split(value, SEPARATOR)
    bad = F.raise_error(F.lit("a prompt file needs exactly two parts")).cast("struct<system:string,user:string>")
    return F.when(F.size(parts) == 2, F.struct(strip(parts[0]).alias("system"), strip(F.get(parts, F.lit(1))).alias("user"))).otherwise(bad)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One object per line, non-ASCII as it is; whole files appear only when their task is committed."""
    rows.write.mode("overwrite").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def pretty_script_array(entries: DataFrame) -> DataFrame:
    """As ``script_array``, indented by two for readers."""
    e = F.struct("pos", F.struct("speaker", "text", "instruct").alias("e"))
    got = entries.groupBy("book_id").agg(F.array_sort(F.collect_list(e)).alias("es"))
    return got.select("book_id", pretty_entries(F.transform("es", lambda x: x["e"])).alias("content"))


def write_single(rows: DataFrame, path: str, content: str = "content") -> None:
    """Each row's text as a file of its own; whole files appear only when their task is committed."""
    rows.select(content).write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def script_array(entries: DataFrame) -> DataFrame:
    """(book_id, content): the entries of each book as one JSON array text."""
    e = F.struct("pos", F.struct("speaker", "text", "instruct").alias("e"))
    got = entries.groupBy("book_id").agg(F.array_sort(F.collect_list(e)).alias("es"))
    return got.select("book_id", F.to_json(F.transform("es", lambda x: x["e"])).alias("content"))
