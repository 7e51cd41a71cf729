"""Rendering as a stream: a log of requests is read batch after batch, and every batch leaves statuses in another log.

A batch plans its calls, marks its chunks, calls the speech model, reads the chunks again and writes what became of them. Each step is a
table of its own in a folder that has the number of the batch, and is not made again once it is whole; so a batch that is
repeated after a failure goes on where it stopped, and no line that a finished step has rendered is rendered twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from storyloom.operators import chunks, render
from storyloom.operators.models import Speech, spoken
from storyloom.sources.scratch import exists

REQUEST = "book_id long, req_pos long, id long"
PLAN = "book_id long, batch long, route string, key string, item long, id long, speaker string, text string, instruct string, voice string, adapter string, sub_no int, idx int"
STATUS = "book_id long, id long, item long, status string, audio_path string, error string"
RESULT = "book_id long, batch long, item long, id long, speaker string, ok boolean, error string, dur_ms long, mp3_bytes long"

#: Steps of a batch that a status comes from, in their order.
MARKED, FINISHED = "marked", "finished"


@dataclass
class RenderJob:
    """``table`` and ``config`` give the chunks and voices as they are when they are called, ``reload`` (by default also
    ``table``) the chunks after the calls; ``log`` is a shared folder."""

    spark: SparkSession
    log: str
    table: Callable[[], DataFrame]
    config: Callable[[], DataFrame]
    speech: Speech = spoken
    batch_size: int = 4
    by_voice: bool = False
    limits: dict = field(default_factory=dict)
    reload: Callable[[], DataFrame] | None = None

    def after(self) -> DataFrame:
        return (self.reload or self.table)()

    def once(self, step: str, number: int, schema: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table of a step of a batch, made if it is not there as a whole."""
        path = f"{self.log}/{step}/number={number}"
        if not exists(self.spark, f"{path}/_SUCCESS"):
            made = make()
            made.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema)]).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def handle(self, requests: DataFrame, number: int) -> None:
        """All steps of one batch of requests (book_id, req_pos, id)."""
        nothing = F.lit(None).cast("string")

        def plan() -> DataFrame:
            return render.render_plan(self.table(), requests, self.config(), self.batch_size, self.by_voice, **self.limits)

        def mark() -> DataFrame:
            return planned.select("book_id", "id", "item", F.lit("generating").alias("status"), nothing.alias("audio_path"), nothing.alias("error"))

        def perform() -> DataFrame:
            return render.performed(planned, self.speech)

        def finish() -> DataFrame:
            end = render.settled(results, self.after())
            return end.select("book_id", "id", "item", F.when(F.col("ok"), "done").otherwise("error").alias("status"), "audio_path", "error")

        planned = self.once("planned", number, PLAN, plan)
        self.once(MARKED, number, STATUS, mark)
        results = self.once("results", number, RESULT, perform)
        self.once(FINISHED, number, STATUS, finish)

    def start(self, requests: str, checkpoint: str, files: int = 1) -> StreamingQuery:
        """Takes the requests that are in the folder, ``files`` JSON files a batch, and ends; a restart with the same
        checkpoint goes on with the batch that was not finished."""
        asked = self.spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", files).json(requests)
        return asked.writeStream.foreachBatch(self.handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def statuses(self) -> DataFrame:
        """All rows of the log: number of the batch, step (0 marked, 1 finished), and what was written."""
        out = None
        for step, name in enumerate((MARKED, FINISHED)):
            try:
                rows = self.spark.read.schema(f"{STATUS}, number long").parquet(f"{self.log}/{name}")
            except AnalysisException:  # no batch has come so far
                rows = self.spark.createDataFrame([], f"{STATUS}, number long")
            rows = rows.withColumn("step", F.lit(step))
            out = rows if out is None else out.unionByName(rows)
        return out

    def current(self) -> DataFrame:
        """The chunks with the last status of each; one that was marked or failed keeps the audio it had."""
        order = F.struct("number", "step", "item")
        done = F.when(F.col("status") == "done", F.col("audio_path"))
        last = self.statuses().groupBy("book_id", "id").agg(F.max_by("status", order).alias("s"), F.max_by(done, F.when(done.isNotNull(), order)).alias("a"))
        last = last.withColumnRenamed("book_id", "b").withColumnRenamed("id", "i")
        t = self.after().join(last, F.col("book_id").eqNullSafe(F.col("b")) & (F.col("id") == F.col("i")), "left")
        return t.select("book_id", "id", *chunks.FIELDS, F.coalesce("s", "status").alias("status"), F.coalesce("a", "audio_path").alias("audio_path"))

    def progress(self) -> DataFrame:
        """(completed, failed, total) of all requests that batches took."""
        t = self.statuses()
        kind = lambda s: F.count_if((F.col("step") == 1) & (F.col("status") == s))
        return t.agg(kind("done").alias("completed"), kind("error").alias("failed"), F.count_if(F.col("step") == 0).alias("total"))

    def failures(self) -> DataFrame:
        """(book_id, id, error) of all lines that failed."""
        return self.statuses().filter("status = 'error'").select("book_id", "id", "error")
