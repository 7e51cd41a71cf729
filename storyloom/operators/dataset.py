"""Voice datasets: sample lists, metadata filters, reference choices and training figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyloom.functions import text as T

MAX_SECONDS = 30.0


def requested_samples(requests: DataFrame) -> DataFrame:
    """(name, idx, emotion, text) of requests with ``samples`` or else plain ``texts``; stripped, blanks left out. ``idx``
    is the place in the request's own list, blanks counted."""
    plain = F.transform("texts", lambda t: F.struct(F.lit("").alias("emotion"), t.alias("text")))
    given = F.when(F.size(F.coalesce("samples", F.array())) > 0, F.col("samples")).otherwise(plain)
    clean = F.transform(given, lambda s: F.struct(T.strip(T.text_of(s["emotion"])).alias("emotion"), T.strip(T.text_of(s["text"])).alias("text")))
    rows = requests.select("name", F.posexplode(clean).alias("idx", "s")).filter("s.text <> ''")
    return rows.select("name", F.col("idx").cast("long").alias("idx"), "s.emotion", "s.text")


def sample_description(root: Column, emotion: Column) -> Column:
    """The voice's description with the sample's emotion after it, or alone."""
    return T.joined_style(root, emotion, ", ")


def merged_rows(new: DataFrame, old: DataFrame, key: str = "book_id") -> DataFrame:
    """New rows (``key``, pos, text) that keep status and audio of the old row at their place if the stripped text is
    the same; otherwise pending. The new list decides the length."""
    was = old.select(key, "pos", F.col("text").alias("old_text"), F.col("status").alias("old_status"), F.col("audio_url").alias("old_audio"))
    same = F.coalesce(T.strip(T.text_of(F.col("text"))) == T.strip(T.text_of(F.col("old_text"))), F.lit(False)) & F.col("old_text").isNotNull()
    t = new.join(was, [key, "pos"], "left")
    return t.select(key, "pos", "text", F.when(same, F.col("old_status")).otherwise("pending").alias("status"), F.when(same, F.col("old_audio")).alias("audio_url"))


def project_summary(samples: DataFrame, key: str = "name") -> DataFrame:
    return samples.groupBy(key).agg(F.count("*").alias("sample_count"), F.count_if(F.col("status") == "done").alias("done_count"))


def usable(metadata: DataFrame, limit: float = MAX_SECONDS) -> DataFrame:
    """Samples with a file and at most ``limit`` seconds."""
    return metadata.filter(F.col("duration").isNotNull() & (F.col("duration") <= limit))


def skipped(metadata: DataFrame, *by: str, limit: float = MAX_SECONDS) -> DataFrame:
    good = F.coalesce(F.col("duration") <= limit, F.lit(False))
    return metadata.groupBy(*by).agg(F.count_if(good).alias("used"), F.count_if(~good).alias("skipped"))


def reference_sample(samples: DataFrame, wanted: int, key: str = "name") -> DataFrame:
    """Per project the requested sample if it is done, else the first done one."""
    done = samples.filter(F.col("status") == "done")
    return done.groupBy(key).agg(F.min_by(F.struct("idx", "text"), F.struct((F.col("idx") != wanted).alias("o"), "idx")).alias("s")).select(key, "s.idx", "s.text")


def reference_audio(entries: DataFrame, key: str = "name") -> DataFrame:
    """Per dataset: the first entry's own reference, else ref.wav if it is there, else the first audio."""
    first = entries.groupBy(key).agg(F.min_by(F.struct("ref_audio", "audio"), "pos").alias("s"), F.max(F.when(F.col("audio") == "ref.wav", F.col("audio"))).alias("ref"))
    return first.select(key, F.coalesce(T.non_empty(F.col("s.ref_audio")), "ref", "s.audio").alias("reference"))


def prepared(metadata: DataFrame, key: str = "name", limit: float = MAX_SECONDS) -> DataFrame:
    """Usable samples (``key``, pos, audio, text, duration) beside their dataset's reference audio, which is chosen among
    all of its samples."""
    return usable(metadata, limit).join(reference_audio(metadata, key), key).select(key, "pos", "audio", "text", "duration", F.col("reference").alias("ref_audio"))


def ingested(lines: DataFrame) -> DataFrame:
    """(dataset, accepted, n_samples) of unpacked datasets, given every line of their files (dataset, path, line): accepted
    if a metadata.jsonl with non-blank lines lies at the root or one folder below; the one at the root counts, else the
    first by path."""
    meta = lines.filter(F.col("path").rlike(r"^([^/]+/)?metadata\.jsonl$") & (T.strip(T.text_of(F.col("line"))) != ""))
    files = meta.groupBy("dataset", "path").agg(F.count("*").alias("n")).groupBy("dataset").agg(F.min_by("n", F.struct(F.size(F.split("path", "/")).alias("d"), "path")).alias("n"))
    return lines.select("dataset").distinct().join(files, "dataset", "left").select("dataset", F.col("n").isNotNull().alias("accepted"), F.coalesce("n", F.lit(0)).alias("n_samples"))


def padded(samples: Column, size: Column, blank: Column) -> Column:
    """The array with copies of ``blank`` up to ``size``."""
    return F.concat(samples, F.array_repeat(blank, F.greatest(size - F.size(samples), F.lit(0)).cast("int")))


def combined_loss(talker: Column, sub: Column) -> Column:
    return talker + sub * 0.3


def epoch_losses(steps: DataFrame, *by: str) -> DataFrame:
    """Per epoch the mean loss of the steps that have one, whether it is the best so far, and the best up to there."""
    means = steps.groupBy(*by, "epoch").agg(F.avg("loss").alias("avg_loss"), F.count("loss").alias("n_steps"))
    w = Window.partitionBy(*by).orderBy("epoch")
    before = F.min("avg_loss").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return means.withColumn("is_best", F.coalesce(F.col("avg_loss") < before, F.col("avg_loss").isNotNull())).withColumn("best_loss", F.min("avg_loss").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def optimiser_steps(steps: DataFrame, accumulate: int, *by: str) -> DataFrame:
    """Steps (``by``..., step from 0) after which gradients are applied: every ``accumulate``-th and the last."""
    last = F.max("step").over(Window.partitionBy(*by))
    return steps.withColumn("applies", ((F.col("step") + 1) % accumulate == 0) | (F.col("step") == last))
