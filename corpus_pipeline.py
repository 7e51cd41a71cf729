"""Corpus preparation in five stages, each over all rows that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the docs of
the next. All but the last return the columns of ``documents``; extra columns pass through. Null and empty texts fail
the quality rules. Empty tables give empty results at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm import decontam, hilbert, mixing, neardup, oracle, quality
from storyloom.sources.scratch import exists, new_path, temporary

#: Share of the entropy of equal source weights that the mixture has at least.
ENTROPY = 0.9

#: Columns of the table that the stages are for.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Similarity of near-duplicates, in percent of the union of their shingles.
PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base checks and every rule."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every near-duplicate group."""
    return neardup.keep_first(docs, percent=PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a notable share of benchmark words."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture needs; the budget is the least at which every document stays."""
    return mixing.realised(docs, entropy=ENTROPY, keep_all=True)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row, with the other columns of documents; columns of any other name in the struct ``other``,
    which is there only if there are any."""
    placed = hilbert.hilbert_shards(docs, whole_rows=True)
    known = [c for c in COLUMNS if c != "doc_id"]
    extra = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in COLUMNS]
    other = [F.struct(*extra).alias("other")] if extra else []
    return placed.select(*[c for c in placed.columns if c != "row"], *[f"row.{c}" for c in known], *other)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("sharding", sharding),
]

ORACLE_SQL = oracle.pipeline(ENTROPY, PERCENT)


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over the documents of ``sf_dir``.

    The rows of every stage but the last are kept in ``folder``, by default a new one in the shared folder; what a stage
    wrote besides is deleted once its rows are stored. A run that is given the folder of one that broke off takes the
    stages that were finished from there, so a folder belongs to one ``sf_dir`` and one form of the stages. The result
    reads tables in the shared folder, which ``scratch.remove_written`` deletes when it is stored.
    """
    folder = folder or new_path(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{k}-{name}"
        if not exists(spark, f"{path}/_SUCCESS"):
            with temporary(spark):
                stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
