"""Operators on script entries (book_id, pos, speaker, text, instruct) and on source texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyloom.functions import text as T
from storyloom.operators import fold, packing, scans

#: Order of the entries of a book; repeated places go by what is there.
ORDER = ("pos", "n", "text", "speaker", "instruct")

MAX_CHUNK = 500
MAX_NARRATION = 800
MAX_PROMPT = 3000
LOSS_LIMIT = 0.95


def speakers(entries: DataFrame, speaker: str = "speaker") -> DataFrame:
    """Distinct stripped speakers that are not blank, in code-point order."""
    return entries.select(T.strip(F.col(speaker)).alias("speaker")).filter("speaker <> ''").distinct().orderBy("speaker")


def packed(entries: DataFrame, hard: Column, cap: int) -> DataFrame:
    """Runs without a ``hard`` break, cut into groups of at most ``cap`` characters with single spaces between texts.

    One shuffle by book: windows find the runs, and a fold over the lengths of a run finds the groups. Gives book_id,
    pos of the first entry, n_entries, speaker, instruct and text, and ``first``, that entry, by which groups are in order.
    """
    order = Window.partitionBy("book_id").orderBy(*ORDER)
    runs = entries.withColumn("hard", F.coalesce(hard, F.lit(True)).cast("int")).withColumn("run", F.sum("hard").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    item = F.struct(*ORDER)
    arrays = runs.groupBy("book_id", "run").agg(F.array_sort(F.collect_list(item)).alias("items"))
    arrays = arrays.withColumn("starts", fold.capped_starts(F.transform("items", lambda x: x["n"]), cap))
    parts = arrays.select("book_id", F.explode(fold.groups(F.col("items"), F.col("starts"))).alias("g"))
    return parts.select(
        "book_id", F.col("g")[0]["pos"].alias("pos"), F.size("g").alias("n_entries"), F.col("g")[0]["speaker"].alias("speaker"),
        F.col("g")[0]["instruct"].alias("instruct"), F.array_join(F.transform("g", lambda x: x["text"]), " ").alias("text"), F.col("g")[0].alias("first"),
    )


def clean(entries: DataFrame) -> DataFrame:
    kind = F.col("type") if "type" in entries.columns else None
    return entries.select("book_id", "pos", T.resolved_speaker(F.col("speaker"), kind).alias("speaker"), T.text_of(F.col("text")).alias("text"), T.text_of(F.col("instruct")).alias("instruct"))


def with_kinds(entries: DataFrame) -> DataFrame:
    """Clean entries with their length ``n``, with ``st``, whether they are structural, and ``open``, whether narration may
    be joined to them."""
    e = clean(entries).withColumn("n", F.length("text")).withColumn("st", T.is_structural(F.col("text")))
    return e.withColumn("open", (F.col("speaker") == T.NARRATOR) & ~T.is_section_break(F.col("text")))


#: Whether an entry begins a group of chunks, or of narration, by a function that gives columns of the entry before.
def chunk_break(before: Callable[[str], Column]) -> Column:
    return before("pos").isNull() | (before("speaker") != F.col("speaker")) | (before("instruct") != F.col("instruct")) | before("st") | F.col("st")


def narration_break(before: Callable[[str], Column]) -> Column:
    return before("pos").isNull() | ~F.col("open") | ~before("open") | (before("instruct") != F.col("instruct"))


def in_book(c: str) -> Column:
    return F.lag(c).over(Window.partitionBy("book_id").orderBy(*ORDER))


def render_chunks(entries: DataFrame, cap: int = MAX_CHUNK) -> DataFrame:
    """Neighbouring entries of one speaker and instruct, neither structural, joined up to ``cap`` characters."""
    return numbered(packed(with_kinds(entries), chunk_break(in_book), cap))


def long_render_chunks(entries: DataFrame, cap: int = MAX_CHUNK, range_rows: int = scans.RANGE_ROWS) -> DataFrame:
    """As ``render_chunks``, for books and runs of any length: no task holds more than a range of entries or of chunks."""
    return long_packed(with_kinds(entries), chunk_break, cap, range_rows, True)


def long_packed(kinds: DataFrame, breaks: Callable[[Callable[[str], Column]], Column], cap: int, range_rows: int, numbered: bool = False, alone: Column | None = None) -> DataFrame:
    placed = scans.dealt(kinds, "book_id", *ORDER, range_rows=range_rows)

    def hard(rows: DataFrame) -> DataFrame:
        told = scans.preceding(rows, "book_id", F.struct("pos", "speaker", "instruct", "st", "open"), "before")
        return told.withColumn("hard", breaks(lambda c: F.col(f"before.v.{c}")))

    return packing.packed(placed, hard, cap, numbered, alone)


def long_merged_narration(entries: DataFrame, cap: int = MAX_NARRATION, range_rows: int = scans.RANGE_ROWS) -> DataFrame:
    """As ``merged_narration``, for books and runs of any length. Entries that are not open are never joined to others."""
    return long_packed(with_kinds(entries), narration_break, cap, range_rows, alone=~F.col("open"))


def numbered(rows: DataFrame) -> DataFrame:
    """``id`` from 0 in the order of the first entries, per book."""
    return rows.withColumn("id", (F.row_number().over(Window.partitionBy("book_id").orderBy("first")) - 1).cast("long")).drop("first")


def merged_narration(entries: DataFrame, cap: int = MAX_NARRATION) -> DataFrame:
    """Neighbouring narrator entries of one instruct, none a section break, joined up to ``cap`` characters."""
    return packed(with_kinds(entries), narration_break(in_book), cap).drop("first")


def prompt_chunks(books: DataFrame, cap: int = MAX_PROMPT, text: str = "text") -> DataFrame:
    """(book_id, chunk_no, text): paragraphs packed up to ``cap`` characters; paragraphs over it by their sentences.

    A sentence longer than ``cap`` stays whole. All in one projection of arrays; a fold over lengths finds the cuts.
    """
    unit = lambda t, kind: F.struct(t.alias("t"), F.length(t).alias("n"), kind.alias("k"))
    split = lambda p: F.transform(T.sentences(p), lambda s, i: unit(s, F.when(i == 0, F.lit("first")).otherwise(F.lit("next"))))
    units = F.flatten(F.transform(T.paragraphs(F.col(text)), lambda p: F.when(F.length(p) > cap, split(p)).otherwise(F.array(unit(p, F.lit("para"))))))
    joint = lambda x: F.when(x["k"] == "next", 1).otherwise(2)
    starts = fold.group_starts(
        F.col("units"), lambda total, first, n, x: (x["k"] == "first") | (total + joint(x) + x["n"] > cap),
        lambda total, x: total + joint(x) + x["n"], lambda x: x["n"],
    )
    body = lambda g: F.array_join(F.transform(g, lambda x, i: F.concat(F.when(i == 0, F.lit("")).when(x["k"] == "next", F.lit(" ")).otherwise(F.lit("\n\n")), x["t"])), "")
    cut = books.select("book_id", units.alias("units")).withColumn("starts", starts)
    return cut.select("book_id", F.posexplode(F.transform(fold.groups(F.col("units"), F.col("starts")), body)).alias("chunk_no", "text"))


def position_label(chunks: DataFrame) -> DataFrame:
    """Label of each chunk of a book: beginning, end, or part i of n; a single chunk is a beginning."""
    i, n = F.col("chunk_no") + 1, F.count("*").over(Window.partitionBy("book_id"))
    label = F.when(i == 1, F.lit("(Beginning of text)")).when(i == n, F.lit("(End of text)")).otherwise(F.format_string("(Part %d of %d)", i, n))
    return chunks.withColumn("label", label)


def rosters(entries: DataFrame, part: str, parts: DataFrame | None = None) -> DataFrame:
    """Per book and part: the sorted speakers other than the narrator in all earlier parts, joined by ', '.

    Each speaker counts in the part where it first speaks, so a running window over one row per part gathers a book's
    speakers once. ``parts`` lists the parts (book_id, ``part``), also such without entries; by default those of the entries.
    """
    said = entries.select("book_id", part, T.text_of(F.col("speaker")).alias("speaker"))
    first = said.filter((F.col("speaker") != "") & (F.col("speaker") != T.NARRATOR)).groupBy("book_id", "speaker").agg(F.min(part).alias(part))
    new = first.groupBy("book_id", part).agg(F.collect_list("speaker").alias("new"))
    all_parts = (said if parts is None else parts).select("book_id", part).distinct()
    before = Window.partitionBy("book_id").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return all_parts.join(new, ["book_id", part], "left").select("book_id", part, F.array_join(F.array_sort(F.flatten(F.collect_list("new").over(before))), ", ").alias("roster"))


def batches(entries: DataFrame, size: int = 25) -> DataFrame:
    """batch_no and place in the batch of each entry, by fixed-size slices of a book."""
    n = F.row_number().over(Window.partitionBy("book_id").orderBy("pos")) - 1
    return entries.withColumn("n", n).withColumn("batch_no", F.floor(F.col("n") / size).cast("long")).withColumn("idx", (F.col("n") % size).cast("long")).drop("n")


def tails(entries: DataFrame, part: str, k: int, earlier: str = "all") -> DataFrame:
    """Per book and part, the texts of the last ``k`` entries before it: of all earlier parts, or of the one before."""
    w = Window.partitionBy("book_id").orderBy("pos").rowsBetween(-k, -1)
    seen = entries.withColumn("tail", F.collect_list(F.struct(F.col(part).alias("p"), "text")).over(w))
    first = seen.withColumn("n", F.row_number().over(Window.partitionBy("book_id", part).orderBy("pos"))).filter("n = 1")
    keep = F.filter("tail", lambda x: x["p"] == F.col(part) - 1) if earlier == "last" else F.col("tail")
    return first.select("book_id", part, F.transform(keep, lambda x: x["text"]).alias("tail"))


def paired(original: DataFrame, corrected: DataFrame) -> DataFrame:
    """Entries of both sides at the same place of the same batch, nulls where one side has none."""
    cols = ("text", "speaker", "instruct")
    side = lambda d, p: d.select("book_id", "batch_no", "idx", F.lit(True).alias(f"{p}_has"), *[F.col(c).alias(f"{p}_{c}") for c in cols])
    return side(original, "o").join(side(corrected, "c"), ["book_id", "batch_no", "idx"], "full")


def review_stats(original: DataFrame, corrected: DataFrame) -> DataFrame:
    """Per batch: entries on either side, changed texts, speakers and instructs of places on both, and the word gate.

    The gate passes when the corrected side has at least LOSS_LIMIT of the original's words, or the original has none.
    """
    both = F.col("o_has") & F.col("c_has")
    changed = lambda c: F.count_if(both & ~F.col(f"o_{c}").eqNullSafe(F.col(f"c_{c}"))).alias(f"{c}_changed")
    stats = paired(original, corrected).groupBy("book_id", "batch_no").agg(
        F.count("o_has").alias("n_original"), F.count("c_has").alias("n_corrected"), changed("text"), changed("speaker"), changed("instruct"),
        F.sum(T.word_count(F.col("o_text"))).alias("words_original"), F.sum(T.word_count(F.col("c_text"))).alias("words_corrected"),
    )
    stats = stats.withColumn("ratio", F.when(F.col("words_original") == 0, 1.0).otherwise(F.col("words_corrected") / F.col("words_original")))
    return stats.withColumn("passed", F.col("ratio") >= LOSS_LIMIT)


def narrator_merges(merged: DataFrame) -> DataFrame:
    """(book_id, merges): entries that ``merged_narration`` joined to the one before them."""
    return merged.groupBy("book_id").agg(F.sum(F.col("n_entries") - 1).alias("merges"))


def total_changes(totals: DataFrame, merges: DataFrame) -> DataFrame:
    """``review_totals`` with narrator merges and the sum of all that was changed."""
    t = totals.join(merges, "book_id", "left").withColumn("merges", F.coalesce("merges", F.lit(0)))
    return t.withColumn("total", F.col("changes") + F.col("added") + F.col("removed") + F.col("merges"))


def review_totals(stats: DataFrame) -> DataFrame:
    """Sums over the batches that passed: changes, entries added and removed; and how many failed."""
    ok, diff = F.col("passed"), F.col("n_corrected") - F.col("n_original")
    total = lambda c: F.coalesce(F.sum(F.when(ok, c)), F.lit(0))
    return stats.groupBy("book_id").agg(
        total(F.col("text_changed") + F.col("speaker_changed") + F.col("instruct_changed")).alias("changes"),
        total(F.greatest(diff, F.lit(0))).alias("added"), total(F.greatest(-diff, F.lit(0))).alias("removed"), F.count_if(~ok).alias("failed"),
    )


def reviewed(original: DataFrame, corrected: DataFrame, stats: DataFrame) -> DataFrame:
    """Entries of every batch: the corrected ones if it passed the gate, else the original ones."""
    gate = stats.select("book_id", "batch_no", "passed")
    take = lambda d, ok: d.join(gate.filter(F.col("passed") == ok), ["book_id", "batch_no"], "left_semi").select("book_id", "batch_no", "idx", "speaker", "text", "instruct")
    return take(corrected, True).unionByName(take(original, False))
