"""The last lines of every task as state of a stream: what a reader of a running task sees, whatever came before."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from storyloom.sources.scratch import exists
from storyloom.streaming.progress import KEPT_LINES, stream_log

TAIL = "task string, n_lines long, lines array<struct<seq:long,line:string>>"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Ring(StatefulProcessor):
    """Keeps the ``kept`` lines with the highest numbers and how many came; both are forgotten after ``ttl_ms`` without a
    new line. A batch's lines go through a heap, so no more than ``kept`` of them are held at once."""

    def __init__(self, kept: int = KEPT_LINES, ttl_ms: int | None = None):
        self.kept, self.ttl_ms = kept, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lines = handle.getListState("lines", "seq long, line string", self.ttl_ms)
        self.count = handle.getValueState("count", "n long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0] if self.count.exists() else 0
        best = [(r[0], r[1]) for r in self.lines.get()] if self.lines.exists() else []
        order = lambda x: (x[0], x[1] is not None, x[1] or "")
        for frame in rows:
            n += len(frame)
            fresh = zip(frame["seq"].tolist(), [None if pd.isna(x) else x for x in frame["line"]], strict=True)
            best = heapq.nlargest(self.kept, [*best, *fresh], key=order)
        best.sort(key=order)
        self.lines.put(best)
        self.count.update((n,))
        yield pd.DataFrame({"task": [key[0]], "n_lines": [n], "lines": [[{"seq": s, "line": x} for s, x in best]]})

    def close(self) -> None:
        pass


def tails(log: DataFrame, kept: int = KEPT_LINES, ttl_ms: int | None = None) -> DataFrame:
    """(task, n_lines, lines) of every task that a batch brought lines of: a stream in update mode. Lines without a number
    have none to be kept by and are left out; lines without a task are one task."""
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    numbered = log.filter(F.col("seq").isNotNull()).withColumn("task", F.coalesce("task", F.lit("")))
    return numbered.groupBy("task").transformWithStateInPandas(Ring(kept, ttl_ms), TAIL, "Update", "ProcessingTime" if ttl_ms else "None")


def run_tails(spark: SparkSession, source: str, checkpoint: str, sink: str, kept: int = KEPT_LINES, ttl_ms: int | None = None, files: int | None = None) -> StreamingQuery:
    """Reads the log files of a folder that are there, ``files`` a batch; every batch writes its tails to a folder with its
    number, once."""

    def save(batch: DataFrame, number: int) -> None:
        path = f"{sink}/number={number}"
        if not exists(spark, f"{path}/_SUCCESS"):
            batch.write.mode("overwrite").parquet(path)

    if ttl_ms:
        # A stream with a time to live would go on with empty batches and never be at its end.
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    log = stream_log(spark, source, files)
    found = tails(log, kept, ttl_ms).writeStream.outputMode("update").foreachBatch(save)
    return found.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, sink: str) -> DataFrame:
    """(task, n_lines, seq, line): the tail of each task as of the last batch that brought lines of it."""
    rows = spark.read.schema(f"{TAIL}, number long").parquet(sink)
    last = rows.groupBy("task").agg(F.max_by(F.struct("n_lines", "lines"), "number").alias("t"))
    return last.select("task", "t.n_lines", F.inline("t.lines"))

