"""Ranked search of items in documents: postings bucketed by term, integer scores of matches, sums, the best by window."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from storyloom.llm.shared import new_path, saved
from storyloom.llm.tokens import row_slices

#: Folders of postings, by hash of the term; a search reads those of its terms. Sums of slices have a folder of their own.
BUCKETS, SUMS = 16, -1

#: Terms of items that workers hold as a set while they read texts, in bytes; beyond, postings of all terms are made.
VOCABULARY_BYTES = 32 << 20

#: Terms of items in one round: these are broadcast, 32 MB at most; more items are searched in several rounds.
ROUND_TERMS = 1 << 20

#: Sums of one task, and the most tasks.
TASK_SUMS, TASKS = 1 << 20, 20_000

TERM, GAP = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")
PIECE = 1 << 20


def term_counts(text: bytes, piece: int = PIECE) -> Counter:
    """How often each term is in a text, a piece after the other; pieces end where a term does. Only A-Z are lowered."""
    text, found, at = text.lower(), Counter(), 0
    while at < len(text):
        gap = GAP.search(text, at + piece)
        end = gap.start() if gap else len(text)
        found.update(TERM.findall(text, at, end))
        at = end
    return found


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def term_rows(rows: DataFrame, vocabulary: frozenset[bytes] | None = None) -> DataFrame:
    """(row, id, n, term, tf) of ``rows`` (row, id, t): each distinct term of a text, of the ``vocabulary`` if there is one,
    with the text's number of terms. A row without a term gives the sums of a slice of texts: n of its terms, tf of texts
    with a term."""
    fields = T.StructType([T.StructField("row", T.LongType()), rows.schema["id"], *T.StructType.fromDDL("n long, term binary, tf long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in row_slices(batch.column(2)):
                whose, sizes, terms, counts, total, filled = [], [], [], [], 0, 0
                for i, text in enumerate(texts, at):
                    found = term_counts((text.as_py() or "").encode())
                    n = found.total()
                    total, filled = total + n, filled + (n > 0)
                    of = found if vocabulary is None else found.keys() & vocabulary
                    whose += [i] * len(of)
                    sizes += [n] * len(of)
                    terms += of
                    counts += [found[t] for t in of]
                at += len(texts)
                whose.append(None)
                take = pa.array(whose, pa.int64())
                numbers = [pa.array([*x, last], kind) for x, last, kind in ((sizes, total, pa.int64()), (terms, None, pa.binary()), (counts, filled, pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *numbers], ["row", "id", "n", "term", "tf"])

    return rows.select("row", "id", "t").mapInArrow(run, fields)


@dataclass
class Postings:
    """``table``: row, id, n, term, tf and bucket; ``docs`` documents have a term, and ``terms`` terms with repeats."""

    table: DataFrame
    docs: int
    terms: int


def numbered(table: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return table.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("t"))


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: frozenset[bytes] | None = None) -> Postings:
    """Postings of all documents, or those of a ``vocabulary``, written in folders by hash of the term and in order of terms
    within a file, so that a search reads few folders and of these few row groups. Spark splits large buckets, whatever
    their terms, into tasks of its advisory size. Documents are told apart by ``row``, also where ids are null or reused.
    """
    spark = docs.sparkSession
    found = term_rows(numbered(docs, id_col, text_col), vocabulary).withColumn("bucket", F.when(F.col("term").isNull(), SUMS).otherwise(bucket_of(F.col("term"))))
    path = new_path(spark, "postings")
    dealt = found.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "row")
    dealt.write.partitionBy("bucket").parquet(path)
    # Named columns come first, that of the folders last.
    table = spark.read.schema(dealt.schema).parquet(path)
    sums = table.filter(F.col("bucket") == SUMS).agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    return Postings(table.filter(F.col("bucket") != SUMS), sums.docs, sums.terms)


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, item_id, term, times), written once: ``item`` tells rows of ``items`` apart."""
    found = term_rows(numbered(items, item_col, text_col)).filter(F.col("term").isNotNull())
    return saved(found.select(F.col("row").alias("item"), F.col("id").alias("item_id"), "term", F.col("tf").alias("times")), "item-terms")


def vocabulary_of(wanted: DataFrame, limit: int = VOCABULARY_BYTES) -> frozenset[bytes] | None:
    """The distinct terms as a set, or None where they have more than ``limit`` bytes."""
    terms = wanted.select("term").distinct()
    if terms.agg(F.coalesce(F.sum(F.octet_length("term") + 64), F.lit(0))).first()[0] > limit:
        return None
    return frozenset(bytes(r.term) for r in terms.toLocalIterator())


def weighted(wanted: DataFrame, found: Postings) -> tuple[DataFrame, DataFrame]:
    """(term, t, bucket) of the wanted terms that documents have, and (item, item_id, t, gain) of the items that have
    them, where gain is how often the item has the term by its weight; both written once."""
    df = found.table.join(wanted.select("term", bucket_of(F.col("term")).alias("bucket")).distinct(), ["bucket", "term"], "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(F.log(F.lit(2.0 * found.docs + 2) / (2 * F.col("df") + 1)) * 1000).cast("long")
    terms = saved(df.select("term", weight.alias("w"), bucket_of(F.col("term")).alias("bucket"), F.monotonically_increasing_id().alias("t")), "terms")
    gains = wanted.join(terms, "term").select("item", "item_id", "t", (F.col("times") * F.col("w")).alias("gain"))
    return terms, saved(gains, "gains")


def scored(found: Postings, terms: DataFrame, gains: DataFrame, items: int) -> DataFrame:
    """(item, row, id, score) of all documents that score above 0, by one shuffle of the matched postings by document.

    Both lookups are broadcast: ``gains`` and its ``terms`` have at most ROUND_TERMS rows, or one item's terms.
    """
    buckets = [r.bucket for r in terms.select("bucket").distinct().collect()]
    matched = found.table.filter(F.col("bucket").isin(buckets)).join(F.broadcast(terms.select("term", "bucket", "t")), ["bucket", "term"])
    length = F.expr(f"75 + (25 * n * {found.docs}L) div {max(found.terms, 1)}L")
    slim = matched.withColumn("m", length).select("row", "id", "t", F.expr("(1000000000 * tf) div (1000 * tf + 12 * m)").alias("s"))
    tasks = min(TASKS, 1 + found.docs * items // TASK_SUMS)
    hits = slim.repartition(tasks, "row").join(F.broadcast(gains.select("t", "item", "gain")), "t")
    return hits.groupBy("item", "row", "id").agg(F.sum(F.col("gain") * F.col("s")).alias("score")).filter("score > 0")


def search(items: DataFrame, found: Postings, k: int = 20, item_col: str = "item_id", text_col: str = "text", wanted: DataFrame | None = None, round_terms: int = ROUND_TERMS) -> DataFrame:
    """(item_id, rank, id, score): the ``k`` best documents of each item with a score above 0, fewer where there are fewer.

    Rank is by score, then by smallest id, null ids last, then by place in the table. Null and empty texts have no terms:
    such items find nothing, such documents are not found. Rows of ``items`` that share an id are items of their own;
    repeated documents are documents of their own. Very long texts are read whole, in pieces. An empty table on either
    side gives an empty result. Other columns are not read.

    Postings of the items' terms are dealt by document, so that joins with the items multiply rows after the shuffle, not
    before, and sums need none. Of every item each task keeps its own ``k`` best before the ranks are taken. Items go in
    rounds of so many terms that these can be broadcast.
    """
    wanted = item_terms(items, item_col, text_col) if wanted is None else wanted
    terms, gains = weighted(wanted, found)
    rounds = max(1, -(-gains.count() // round_terms))
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").isNull(), "id", "row")
    out = None
    for r in range(rounds):
        mine = gains.filter(F.pmod(F.xxhash64("item"), F.lit(rounds)) == r)
        there = terms.join(mine.select("t").distinct(), "t", "left_semi") if rounds > 1 else terms
        top = scored(found, there, mine, mine.select("item").distinct().count()).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        named = top.join(mine.select("item", "item_id").distinct(), "item").select("item_id", "rank", "id", "score")
        out = named if out is None else out.unionByName(named)
    return out


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """As ``search``, over postings that are made of the items' terms only, where these fit into the workers."""
    wanted = item_terms(items, item_col, item_text)
    return search(items, postings(docs, id_col, text_col, vocabulary_of(wanted)), k, wanted=wanted).withColumnRenamed("id", id_col)
