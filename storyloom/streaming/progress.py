"""Task logs as streams and as tables (task, seq, line)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

KEPT_LINES = 1000
LOG = "task string, seq long, line string"


def tail(log: DataFrame, lines: int = KEPT_LINES) -> DataFrame:
    """The last ``lines`` lines of every task. Spark keeps at most that many per task and input partition before the
    shuffle, because the filter on the row number limits the window."""
    w = Window.partitionBy("task").orderBy(F.desc("seq"))
    return log.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= lines).drop("rn")


def stream_log(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """Log lines of JSON files as they arrive in a folder, at most so many ``files`` a batch."""
    read = spark.readStream.schema(LOG)
    return (read.option("maxFilesPerTrigger", files) if files else read).json(path)


def counts(log: DataFrame) -> DataFrame:
    """Lines and last line number per task, for a table or a stream."""
    return log.groupBy("task").agg(F.count("*").alias("n_lines"), F.max("seq").alias("last_seq"))


def run_counts(spark: SparkSession, source: str, checkpoint: str, name: str) -> StreamingQuery:
    """Reads what is there, once, into the in-memory table ``name``; a restart goes on from the checkpoint."""
    found = counts(stream_log(spark, source)).writeStream.outputMode("complete").format("memory").queryName(name)
    return found.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_counts(spark: SparkSession, source: str, checkpoint: str, sink: str) -> StreamingQuery:
    """As ``run_counts``, each batch replacing the table at ``sink``, so that a repeated batch changes nothing."""
    save = lambda batch, _: batch.write.mode("overwrite").parquet(sink)
    found = counts(stream_log(spark, source)).writeStream.outputMode("complete").foreachBatch(save)
    return found.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
