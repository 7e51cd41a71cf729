"""Script records derived from the test tables: document lines as entries, with speakers and styles by position."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.operators import chunks, script
from storyloom.operators.models import by_lists

CONFIG = "speaker string, type string, voice string, character_style string, default_style string, seed string, adapter_id string, description string"
VOICES = [
    ("NARRATOR", "custom", "deep", "measured", "plain", "7", None, None),
    ("Alice", "clone", None, None, "bright", "-1", None, None),
    ("Bob", "builtin_lora", None, "gruff", None, None, "a1", None),
    ("Dora", "design", None, None, None, None, None, " A warm voice "),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as books; lines apart by a blank line, so that there are paragraphs."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry per line of each document."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    turn, mood = F.expr("(pos div 3) % 5"), F.expr("(pos div 6) % 2")
    who = F.when(turn == 0, "NARRATOR").when(turn == 1, "Alice").when(turn == 2, "Bob").when(turn == 3, "Élan & co").otherwise("Dora")
    return lines.select("book_id", F.col("pos").cast("long").alias("pos"), who.alias("speaker"), "text", F.when(mood == 0, "calm").otherwise("").alias("instruct"))


def voices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VOICES, CONFIG)


def rendered(rows: DataFrame, key: str = "pos") -> DataFrame:
    """Entries with a stand-in duration; those without text have none."""
    return rows.select("book_id", F.col(key).alias("id"), "speaker", "text", F.when(F.length("text") > 0, F.length("text") * 60).cast("long").alias("dur_ms"))


def corrected(rows: DataFrame) -> DataFrame:
    """A stand-in for reviewed entries (with batch_no and idx): some texts cut, some speakers changed, some places lost."""
    cut = F.when(F.expr("pos % 7 = 3"), F.substring("text", 1, 40)).otherwise(F.col("text"))
    who = F.when(F.expr("pos % 11 = 5"), F.lit("NARRATOR")).otherwise(F.col("speaker"))
    return rows.filter("NOT (book_id % 5 = 0 AND idx = 24)").withColumn("text", cut).withColumn("speaker", who)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as model responses: JSON arrays, some fenced, tagged, cut or with missing commas."""
    t = table(spark, sf_dir, "conversations")
    one = F.to_json(F.struct(F.col("role").alias("speaker"), F.col("text"), F.lit("calm").alias("instruct")))
    two = F.to_json(F.struct(F.lit("NARRATOR").alias("speaker"), F.substring("text", 1, 30).alias("text"), F.lit("").alias("instruct")))
    kind = F.expr("(conv_id + turn) % 6")
    body = F.concat(F.lit("["), one, F.lit(", "), two, F.lit("]"))
    made = (
        F.when(kind == 0, body)
        .when(kind == 1, F.concat(F.lit("<think>no [ yet</think>```json\n"), body, F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit("["), one, F.lit(" "), two, F.lit("]")))
        .when(kind == 3, F.concat(F.lit("["), one, F.lit(", "), two, F.lit(", ]")))
        .when(kind == 4, F.concat(F.lit("Sure: ["), one, F.lit(", "), two))
        .otherwise(F.lit("I cannot do that."))
    )
    return t.select("conv_id", "turn", made.alias("response"))


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk lists of all books, every other chunk done."""
    t = chunks.as_chunks(entries(spark, sf_dir).withColumn("id", F.col("pos")))
    done = F.col("id") % 2 == 0
    return t.withColumn("status", F.when(done, "done").otherwise("pending")).withColumn("audio_path", F.when(done, F.concat_ws("/", F.lit("a"), "id")))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the samples of datasets, one for each source; good ones are done."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    status = F.when(F.col("quality") == 1, "done").otherwise("pending")
    return d.join(lab, "doc_id", "left").select(F.col("source").alias("name"), F.col("doc_id").alias("idx"), "text", (F.col("n_chars") / 15.0).alias("duration"), status.alias("status"))


def prompt_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the books for prompts."""
    return script.prompt_chunks(books(spark, sf_dir), 1000)


def edit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 edits of every book: of all kinds, some at places that do not exist."""
    seq = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))).alias("seq")
    t = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), seq)
    kinds = F.array(*[F.lit(x) for x in ("insert", "delete", "restore", "update", "undo", "paint")])
    n = F.col("seq").cast("string")
    some = lambda hit, key, value: F.when(hit, F.map_from_arrays(F.array(F.lit(key)), F.array(value))).otherwise(F.create_map().cast("map<string,string>"))
    given = F.map_concat(some(F.expr("seq % 2 = 1"), "text", F.concat(F.lit("edit "), n)), some(F.expr("seq % 4 = 2"), "instruct", F.lit(None).cast("string")), some(F.expr("seq % 3 = 0"), "speaker", F.concat(F.lit("S"), n)))
    return t.select(
        "book_id", "seq", F.get(kinds, F.expr("cast((book_id + seq * seq) % 6 AS int)")).alias("op"), F.expr("(book_id * 3 + seq * 7) % 19 - 1").alias("at"),
        F.lit("R").alias("speaker"), F.concat(F.lit("restored "), n).alias("text"), F.lit(None).cast("string").alias("instruct"), F.lit("done").alias("status"),
        F.concat(F.lit("r/"), n).alias("audio_path"), given.alias("fields"),
    )


def digest_model(prompt: str, attempt: int) -> str:
    """A stand-in for a language model whose answer follows from the whole prompt: it raises, has no array, or has one or
    two entries, by the digits of a hash."""
    h = hashlib.md5(f"{attempt}{prompt}".encode()).hexdigest()
    if h[0] in "01":
        raise RuntimeError("no answer")
    if h[0] in "23":
        return "I cannot do that."
    who = lambda d: "NARRATOR" if d in "0123" else f"S{d}"
    entries = [{"speaker": who(h[2 + i]), "text": h[8 + 4 * i : 12 + 4 * i], "instruct": ""} for i in range(1 + (h[1] in "01234567"))]
    body = json.dumps(entries)
    return f"<think>no [ yet</think>```json\n{body}\n```" if h[3] in "01234567" else body


def digest_reviewer(prompt: str, attempt: int) -> str:
    """A stand-in for a reviewer: raises, keeps the first entry only, or gives the first entry to another speaker."""
    h = hashlib.md5(f"{attempt}{prompt}".encode()).hexdigest()
    if h[0] in "0123456":
        raise RuntimeError("no answer")
    batch = json.loads(prompt.split("\n---\n", 1)[1])
    batch[0]["speaker"] = f"S{h[1]}"
    return json.dumps(batch[:1] if h[0] in "78" else batch)


def faulty_speech(route: str, key: str):
    """A stand-in for a speech model: lines of some lengths break their whole call, have no sound, or are no mp3."""

    @by_lists
    def call(lines: dict[str, list]) -> dict[str, list]:
        n = [len(t) for t in lines["text"]]
        if any(x % 37 == 5 for x in n):
            raise RuntimeError("bad line")
        ms = [x * 60 if x % 17 else 0 for x in n]
        return {"dur_ms": ms, "mp3_bytes": [m * 16 if x % 7 else 428 for m, x in zip(ms, n, strict=True)]}

    return call
