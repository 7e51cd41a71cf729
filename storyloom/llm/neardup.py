"""Near-duplicate documents: MinHash with tensored banding, exact verification, and connected components.

Two collections of band hashes are taken from one MinHash signature. Every pair of a band of the first and a band of the
second collection is the key of one table, so that groups^2 tables cost 2 * groups band hashes. A pair of sets with
similarity s meets in a table unless all bands of one collection differ, which has probability
2 * (1 - s^rows)^groups; ``bands_for`` chooses rows and groups by the wanted similarity so that this stays below 2e-5.

Every table shows one of its classes to the others, which are first compared with the nearest ones that they were shown.
Where classes of several components are left in a band, their links are found by their rarest shingles (see
``rare_meetings``), never by all pairs of the band.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm import tokens
from storyloom.llm.graph import components
from storyloom.llm.shared import saved, spread_join

SHINGLE = 5

#: Bits of a sketch: one bit of each of so many MinHashes.
SKETCH = 128

#: Classes, one for each of its tables at most, with which a class is compared before rare shingles are looked at.
NEAREST = 4

MISSED = 1e-5
LEAST_PERCENT = 50


@dataclass(frozen=True)
class Bands:
    groups: int
    rows: int

    @property
    def hashes(self) -> int:
        return max(SKETCH, 2 * self.groups * self.rows)

    def factors(self) -> tuple[np.ndarray, np.ndarray]:
        """Odd multipliers and even summands of the hash functions; fewer hashes take the first of them."""
        seeds = np.random.default_rng(20240229).integers(0, 1 << 63, (self.hashes, 2), dtype=np.uint64) * np.uint64(2)
        return seeds[:, 0] + np.uint64(1), seeds[:, 1].copy()


def bands_for(percent: int) -> Bands:
    """Rows of a band and bands of a collection by which a pair of this similarity is missed with probability < 2e-5."""
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent must be from {LEAST_PERCENT} to 100")
    s = min(percent, 99) / 100
    rows = min(5, max(2, int(math.log(0.5) / math.log(s))))
    return Bands(math.ceil(math.log(MISSED) / math.log(1 - s**rows)), rows)


def sketch_limit(percent: int) -> int:
    """Bits in which the sketches of two sets of this similarity differ, with six standard deviations more."""
    p = (100 - percent) / 200
    return int(SKETCH * p + 6 * (SKETCH * p * (1 - p)) ** 0.5) + 1


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of the 5-word shingles of each text; of all its words if it has fewer."""
    for part in tokens.row_slices(column):
        yield from shingle_sets_of(part)


def shingle_sets_of(column: pa.Array) -> Iterator[np.ndarray]:
    data, offs = tokens.text_buffer(column)
    found = tokens.words(data, offs, lower=True)
    hashed, at = tokens.windows(found, SHINGLE)
    first = np.searchsorted(at, found.first)
    for row, count in enumerate(found.counts):
        if count >= SHINGLE:
            yield np.unique(hashed[first[row] : first[row + 1]])
        elif count:
            whole = np.uint64(count)
            for h in found.hashes[0][found.first[row] : found.first[row + 1]]:
                whole = tokens.mix(np.array([whole]) * np.uint64(tokens.BASES[1]) + h)[0]
            yield np.array([whole])
        else:
            yield np.zeros(0, np.uint64)


def signature(items: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    best = np.full(len(factors), np.uint64(0xFFFFFFFFFFFFFFFF))
    for k in range(0, len(items), 1024):
        best = np.minimum(best, (items[k : k + 1024, None] * factors + offsets).min(axis=0))
    return best


def digest(items: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """128 bits that name a set."""
    return tokens.mix(items).sum(dtype=np.uint64), tokens.mix(items ^ np.uint64(tokens.BASES[0])).sum(dtype=np.uint64)


def sketches(plan: Bands):
    """Per (id, text, k): size, digest, band hashes and sketch of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, (factors, offsets), width = tokens.powers(tokens.BASES[0], plan.rows), plan.factors(), 2 * plan.groups
        for batch in batches:
            n, high, low, bands, s1, s2 = [], [], [], [], [], []
            for items in shingle_sets(batch.column(1)):
                n.append(len(items))
                h, l = digest(items)  # noqa: E741
                high.append(h)
                low.append(l)
                mins = tokens.mix(signature(items, factors, offsets))
                bands.append(tokens.mix((mins[: width * plan.rows].reshape(width, plan.rows) * fold).sum(axis=1, dtype=np.uint64)))
                bits = np.packbits((mins[:SKETCH] & np.uint64(1)).astype(np.uint8)).view(np.uint64)
                s1.append(bits[0])
                s2.append(bits[1])
            u64 = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            flat = np.concatenate(bands).view(np.int64) if bands else np.zeros(0, np.int64)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(flat), width).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), u64(high), u64(low), lists, u64(s1), u64(s2)],
                ["id", "k", "n", "high", "low", "bands", "s1", "s2"],
            )

    return run


def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, sets = [], []
        for items in shingle_sets(batch.column("t")):
            names.append(digest(items))
            sets.append(pa.array(items.view(np.int64)))
        high, low = (pa.array(np.array([x[j] for x in names], np.uint64).view(np.int64)) for j in (0, 1))
        yield pa.RecordBatch.from_arrays([batch.column("k"), high, low, pa.array(sets, pa.list_(pa.int64()))], ["k", "high", "low", "items"])


def linked(percent: int):
    """Keeps the pairs whose sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (v.values.to_numpy().view(np.uint64) for v in (x, y))
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                spot = np.searchsorted(large, small)
                both = int((large[np.minimum(spot, len(large) - 1)] == small).sum()) if len(large) else 0
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
    both = both.join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(linked(percent), "a long, b long")


def sketch_bits() -> Column:
    """Bits in which the sketches of the structs p and q differ."""
    p, q = F.col("p"), F.col("q")
    return F.bit_count(p["s1"].bitwiseXOR(q["s1"])) + F.bit_count(p["s2"].bitwiseXOR(q["s2"]))


def alike(percent: int) -> Column:
    """The sizes and sketches of the structs p and q allow a similarity of ``percent`` or more."""
    p, q = F.col("p"), F.col("q")
    return (sketch_bits() <= sketch_limit(percent)) & (F.least(p["n"], q["n"]) * 100 >= F.greatest(p["n"], q["n"]) * percent)


def meetings(classes: DataFrame, groups: int) -> DataFrame:
    """(key, q): the tables' rows whose key at least two classes share; q is the class with its size and sketch.

    A class can only meet others in table (i, j) if it meets others in band i and in band j, so bands that nobody
    shares are dropped before pairs of bands are formed.
    """
    who = F.struct("id", "n", "s1", "s2").alias("q")

    def shared(lo: int) -> DataFrame:
        spread = classes.select("id", F.posexplode(F.slice("bands", lo + 1, groups)).alias("i", "h"))
        often = spread.groupBy("i", "h").agg(F.count("*").alias("c")).filter("c > 1").select("i", "h")
        return spread.join(often, ["i", "h"]).groupBy("id").agg(F.collect_list(F.struct("i", "h")).alias(f"b{lo}"))

    pairs = shared(0).join(shared(groups), "id").join(classes.select("id", who), "id")
    pairs = pairs.select("q", F.explode("b0").alias("u"), f"b{groups}").select("q", "u", F.explode(f"b{groups}").alias("v"))
    return pairs.select(F.xxhash64("u.i", "u.h", "v.i", "v.h").alias("key"), "q")


def rare_meetings(open_: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of classes of different components that may be linked; none that is linked is left out.

    ``open_`` has id, n, s1, s2, component and items. Shingles are ranked by how many of these classes have them, those
    that one class has alone first. By the prefix principle of set joins, two linked sets share one of the first
    n - ceil(percent n / 100) + 1 shingles of each, and from the first shared one on, both have as many left as they must
    share; the joins take this as a condition on sizes (see ``size_sides``), so what all pages of a template have in common
    makes no pair unless the pages are near the limit. Only shingles of several components make pairs, and members of the
    largest of these are not paired with each other. Both sides of the joins are plain tables, so that Spark can split a
    shingle that very many classes have.
    """
    rows = open_.select("id", F.explode("items").alias("token"))
    often = saved(rows.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"), "shingles")
    ranked = rows.join(often, "token").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("shared"))
    ranked = ranked.join(open_.select("id", "n", "s1", "s2", "component"), "id").withColumn("alone", F.col("n") - F.size("shared"))
    first = F.expr(f"n - ({percent} * n + 99) div 100 + 1 - alone")
    ranked = ranked.withColumn("prefix", F.slice("shared", 1, F.greatest(first, F.lit(0)).cast("int")))
    spots = ranked.select(F.struct("id", "n", "s1", "s2", "component").alias("q"), "alone", F.posexplode("prefix").alias("at", "x"))
    spots = saved(spots.select(F.col("x.token").alias("token"), "q", (F.col("q.n") - F.col("alone") - F.col("at")).alias("left")), "prefixes")
    sizes = spots.groupBy("token", F.col("q.component").alias("component")).agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("token").agg(F.max(F.struct("c", "component")).getField("component").alias("largest"), F.count("*").alias("k"))
    mixed = saved(mixed.filter("k > 1").drop("k"), "mixed")
    spots = saved(spots.join(mixed, "token").withColumn("top", F.expr(f"left * {100 + percent} div {percent} - q.n")), "mixed_prefixes")
    found = None
    for wide, narrow in size_sides(spots, percent):
        pairs = wide.join(narrow, ["token", "size"]).filter(
            (F.col("p.component") != F.col("q.component"))
            & (F.least("p_left", "left") * (100 + percent) >= (F.col("p.n") + F.col("q.n")) * percent)
            & alike(percent)
        )
        found = pairs if found is None else found.unionByName(pairs)
    return found.select(F.least("p.id", "q.id").alias("a"), F.greatest("p.id", "q.id").alias("b")).distinct()


def size_step(n: str) -> str:
    """SQL of how many low bits sizes are rounded by: nine significant ones stay."""
    return f"greatest(length(bin({n})) - 9, 0)"


def size_sides(spots: DataFrame, percent: int) -> list[tuple[DataFrame, DataFrame]]:
    """Both sides of the joins of ``rare_meetings``, by token and size: of two linked sets that first share the token, the
    larger has room for a partner of the smaller one's size, and the smaller for one at least as large as itself.

    ``top`` is the largest partner that what is left from the token on allows. So pages that have a template in common
    and are too far apart meet at no size, however many there are. Rounded sizes only add candidates. Members of a token's
    largest component are not on both sides of one join.
    """
    low = f"(q.n * {percent} + 99) div 100"
    rounded = lambda n: f"shiftleft(shiftright({n}, {size_step(n)}), {size_step(n)})"
    room = spots.withColumn("low", F.expr(low)).withColumn("high", F.least("q.n", "top")).filter("low <= high")
    step = f"shiftleft(1L, {size_step('low')})"
    sizes = F.expr(f"array_distinct(transform(concat(sequence(low, high, {step}), array(high)), m -> {rounded('m')}))")
    wide = room.select("token", F.col("q").alias("p"), F.col("left").alias("p_left"), (F.col("q.component") == F.col("largest")).alias("in_largest"), F.explode(sizes).alias("size"))
    narrow = spots.filter("top >= q.n").select("token", "q", "left", (F.col("q.component") == F.col("largest")).alias("largest_too"), F.expr(rounded("q.n")).alias("size"))
    return [
        (wide.filter("NOT in_largest").drop("in_largest"), narrow.drop("largest_too")),
        (wide.filter("in_largest").drop("in_largest"), narrow.filter("NOT largest_too").drop("largest_too")),
    ]


def nearest(keys: DataFrame, percent: int) -> DataFrame:
    """(id, near): every class that meets others in a table, with those classes shown to it that are nearest by sketch and
    may be linked. A table shows one of its classes, chosen by a hash of its own, to all of them."""
    shown = keys.groupBy("key").agg(F.count("*").alias("c"), F.min_by("q", F.xxhash64("key", "q.id")).alias("p")).filter("c > 1").drop("c")
    fit = F.when((F.col("p.id") != F.col("q.id")) & alike(percent), F.struct(sketch_bits().alias("bits"), F.col("p.id").alias("id")))
    met = keys.join(shown, "key").select(F.col("q.id").alias("id"), fit.alias("x"))
    return met.groupBy("id").agg(F.slice(F.array_sort(F.collect_set("x")), 1, NEAREST).alias("near"))


def links_of(docs: DataFrame, sk: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Verified links that connect whatever is connected between classes of different shingle sets, and these classes.

    A class is named by a number of its own, so that it does not matter whether its documents' ids are null or reused.

    First every class is compared with the nearest of those that its tables show, so that most of a large group of copies
    hangs together soon. Then, where classes of several components
    still share a band, these classes are compared by their rare shingles. So no link between classes that meet is lost,
    and the number of comparisons does not grow with the square of a group of pages that have much in common.
    """
    plan = bands_for(percent)
    least = -(-percent // (100 - percent)) if percent < 100 else 1 << 62
    classes = sk.filter(F.col("n") >= least).groupBy("high", "low")
    classes = classes.agg(F.min("k").alias("k"), F.min("n").alias("n"), F.min("s1").alias("s1"), F.min("s2").alias("s2"), F.first("bands").alias("bands"))
    classes = saved(classes.select(F.monotonically_increasing_id().alias("id"), "k", "high", "low", "n", "s1", "s2", "bands"), "classes")
    met = saved(nearest(meetings(classes, plan.groups), percent), "met")
    named = saved(classes.join(met.select("id"), "id"), "named")
    texts = docs.join(named.select("k").distinct(), "k", "left_semi").select("k", "t")
    found = texts.mapInArrow(sets_of, "k long, high long, low long, items array<long>").dropDuplicates(["k", "high", "low"])
    sets = saved(found.join(named.select("id", "k", "high", "low"), ["k", "high", "low"]).select("id", "items"), "sets")

    first = met.select("id", F.explode("near.id").alias("p")).select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).distinct()
    links = saved(verified(first, sets, percent), "links")
    known = named.select("id", "n", "s1", "s2", "bands")
    if links.isEmpty():
        known = known.withColumn("component", F.col("id"))
    else:
        known = known.join(components(links).withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    known = saved(known, "known")
    spread = known.select("id", "component", F.posexplode(F.slice("bands", 1, plan.groups)).alias("i", "h"))
    mixed = spread.groupBy("i", "h").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("i", "h")
    open_ids = spread.join(mixed, ["i", "h"], "left_semi").select("id").distinct()
    open_ = saved(known.drop("bands").join(open_ids, "id").join(sets, "id"), "open")
    more = saved(verified(rare_meetings(open_, percent), sets, percent), "links")
    return links.unionByName(more), classes


def text_key(id_: Column, text: Column) -> Column:
    """64 bits that tell the texts of one id apart."""
    return F.xxhash64(id_.cast("long"), text)


def judged(docs: DataFrame, id_col: str, text_col: str, percent: int) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows; and of each class of equal sets that are not empty, by (high, low), the first document
    of its group as the struct ``lead``: the smallest id, nulls last, then the smallest key and digest."""
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"), text_key(F.col(id_col), F.col(text_col)).alias("k"))
    sk = saved(slim.mapInArrow(sketches(bands_for(percent)), "id long, k long, n long, high long, low long, bands array<long>, s1 long, s2 long"), "sketches")
    links, classes = links_of(slim, sk, percent)
    leaders = sk.filter("n > 0").groupBy("high", "low").agg(F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "k")).alias("m"), F.count("*").alias("copies"))
    leaders = saved(leaders.select("high", "low", F.struct("m.nameless", "m.id", "m.k", "high", "low").alias("lead"), "copies"), "leaders")
    if not links.isEmpty():
        labels = components(links).withColumnRenamed("node", "id").join(classes.select("id", "high", "low"), "id")
        joined = saved(leaders.join(labels.select("high", "low", "component"), ["high", "low"]), "joined")
        best = joined.groupBy("component").agg(F.min("lead").alias("best"), F.count("*").alias("members"))
        moved = spread_join(joined, best, ["component"], "members", joined.count()).select("high", "low", "best")
        leaders = leaders.join(moved, ["high", "low"], "left").select("high", "low", F.coalesce("best", "lead").alias("lead"), "copies")
        leaders = saved(leaders, "leaders")
    return sk, leaders


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """One row per row of ``docs``: the id, n_shingles, component_id (smallest id of its group) and kept.

    Documents are linked when 100 * intersection >= percent * union of their sets of lower-cased 5-word shingles (of all
    words as one, if there are fewer than five). Null or empty texts have empty sets and are linked with nothing. Equal
    sets are one class from the start. Rows with a null id are linked like others but never lead a group and are not
    kept, unless the group has null ids only; then its component is null and the rows of one of its classes are kept. Of
    a reused id, each text is judged by itself. Repeated rows get equal results. Other columns are not read; an empty
    table gives an empty result.
    """
    sk, leaders = judged(docs, id_col, text_col, percent)
    kept = F.col("id").eqNullSafe(F.col("lead.id")) & (F.col("high") == F.col("lead.high")) & (F.col("low") == F.col("lead.low"))
    some = sk.filter("n > 0").select("id", "n", "high", "low")
    some = spread_join(some, leaders, ["high", "low"], "copies", sk.count()).select("id", "n", F.col("lead.id").alias("leader"), kept.alias("kept"))
    none = sk.filter("n = 0").select("id", "n", F.col("id").alias("leader"), F.lit(True).alias("kept"))
    return some.unionByName(none).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("leader").alias("component_id"), "kept")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, that lead their group by ``near_duplicates``, one for each group.

    Rows with equal ids (or none) and equal texts count as one, also where texts are empty. Texts of one id, and texts
    without an id, are told apart by 64 bits.
    """
    sk, leaders = judged(docs, id_col, text_col, percent)
    first = leaders.select("lead.id", "lead.k").unionByName(sk.filter("n = 0").select("id", "k")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("i"), text_key(F.col(id_col), F.col(text_col)).alias("j"))
    kept = rows.join(first, F.col("i").eqNullSafe(F.col("id")) & (F.col("j") == F.col("k")), "left_semi")
    return kept.dropDuplicates(["i", "j"]).select("row.*")
