"""Product codes of vectors: codebooks learned in integers, distances screened in float32 and settled in int64."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.shared import saved, spread_join

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096

#: Components are below this in size, so that int64 holds the error of vectors of up to 8,192 components.
LIMIT = 4096.0

#: Components that a step of the work takes at once.
STEP = 1 << 20

#: Unit roundoff of float32.
U = 2.0**-24


def usable(vector: Column) -> Column:
    """Whether all components are there, finite and within the limit, and eight equal parts can be cut."""
    whole = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(LIMIT)))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & (F.size(vector) % PARTS == 0) & whole, F.lit(False))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of ``x`` (int64, n by d) the first of the nearest rows of ``book``, its squared distance, and how many
    distances were computed in int64.

    A float32 product is off by at most gamma |x| |c|, gamma = (d + 2) u / (1 - (d + 2) u), whatever the order of its
    sums: d - 1 additions, one multiplication and two conversions. So every score |c|^2 - 2 xc lies in an interval; entries
    whose interval begins beyond the end of the lowest end are not the nearest, all others are computed exactly.
    """
    d = x.shape[1]
    product = (x.astype(np.float32) @ book.astype(np.float32).T).astype(np.float64)
    own = (book * book).sum(1).astype(np.float64)
    norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
    gamma = (d + 2) * U / (1 - (d + 2) * U)
    # The last term is for the roundings of the double-precision steps.
    off = 2 * gamma * 1.0001 * np.outer(norm, np.sqrt(own)) + 2.0**-48 * (own + 2 * np.abs(product) + 1)
    score = own - 2 * product
    rows, entries = np.nonzero(score - off <= (score + off).min(1)[:, None])
    gap = x[rows] - book[entries]
    exact = np.full(score.shape, np.iinfo(np.int64).max)
    exact[rows, entries] = (gap * gap).sum(1)
    code = exact.argmin(1)
    return code, exact[np.arange(len(x)), code], len(rows)


def part_slices(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, rows by parts by components) of a list column of ``width`` integers a row, in bounded steps."""
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, PARTS, width // PARTS)
    step = max(1, STEP // width)
    for at in range(0, len(values), step):
        yield at, values[at : at + step].astype(np.int64)


def totals(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """Sums (last column: counts) of the parts that each entry is nearest to, by part, entry and place; a task adds up its
    own before anything is shuffled, and what the driver gets has the size of the codebooks."""
    parts, k, d = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, k, d + 1), np.int64)
        for batch in batches:
            for _, x in part_slices(batch.column(0), parts * d):
                for p in range(parts):
                    code, _, _ = nearest(x[:, p], books[p])
                    np.add.at(sums[p, :, :d], code, x[:, p])
                    sums[p, :, d] += np.bincount(code, minlength=k)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums.ravel()[at])], ["at", "v"])

    out = np.zeros(parts * k * (d + 1), np.int64)
    for r in vectors.select("v").mapInArrow(run, "at long, v long").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r.at] = r.v
    return out.reshape(parts, k, d + 1)


def learned(vectors: DataFrame, order: list[Column], rounds: int) -> np.ndarray | None:
    """Codebooks (parts, entries, components) of ``vectors`` (id, v), which begin as the first in the order; None without
    vectors."""
    first = vectors.orderBy(*order).limit(ENTRIES).select("v").collect()
    if not first:
        return None
    width = len(first[0].v)
    books = np.array([r.v for r in first], np.int64).reshape(len(first), PARTS, width // PARTS).transpose(1, 0, 2)
    for _ in range(rounds):
        found = totals(vectors, books)
        n = found[:, :, -1:]
        new = np.where(n > 0, found[:, :, :-1] // np.maximum(n, 1), books)
        if (new == books).all():
            break
        books = new
    return books


@dataclass
class Compressed:
    """``rows`` (id, label, code, error, label_error) and the codebooks by part, entry and place (None without rows)."""

    rows: DataFrame
    books: np.ndarray | None

    @property
    def books_sha256(self) -> str:
        flat = [] if self.books is None else self.books.ravel().tolist()
        return hashlib.sha256(",".join(map(str, flat)).encode()).hexdigest()


def encoded(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, label, code, error) of ``vectors``: indexes of the nearest entries in order of the parts, two hex digits each,
    and the sum of their squared distances."""
    parts, _, d = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = [], []
            for _, x in part_slices(batch.column(2), parts * d):
                found = [nearest(x[:, p], books[p])[:2] for p in range(parts)]
                digits = np.stack([c for c, _ in found], 1).astype(np.uint8).tobytes().hex()
                codes += [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
                errors.append(sum(e for _, e in found))
            error = np.concatenate(errors) if errors else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(error)], ["id", "label", "code", "error"])

    types = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return vectors.select("id", "label", "v").mapInArrow(run, f"id {types['id']}, label {types['label']}, code string, error long")


def compress(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> Compressed:
    """Product codes of all vectors, with codebooks that all of them teach.

    Components become floor(4096 x). Rows without a vector or with a null, NaN or infinite component are left out; so are
    vectors that eight equal parts cannot be cut from, that have a component of 4,096 or more in size (their errors could
    leave int64), or that are of another length than that of the smallest id. Entries begin as the parts of the 16
    smallest ids; equal ids are taken in order of their components, null ids last. With fewer vectors there are fewer
    entries. Repeated rows count as often as they are there. ``label_error`` adds up errors by label, null labels
    together; labels of more than a thousandth of the rows stay where they are. Other columns are not read. An empty
    table gives no rows and no codebooks.
    """
    v = F.col("x")
    rows = table.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("x")).filter(usable(v))
    vectors = saved(rows.select("id", "label", F.transform(v, lambda c: F.floor(c.cast("double") * SCALE).cast("int")).alias("v")), "vectors")
    order = [F.col("id").isNull(), F.col("id"), F.col("v")]
    first = vectors.orderBy(*order).limit(1).select(F.size("v").alias("n")).first()
    vectors = vectors.filter(F.size("v") == (first.n if first else 0))
    books = learned(vectors, order, rounds)
    if books is None:
        return Compressed(vectors.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")), None)
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    out = saved(encoded(vectors, books), "codes").withColumn("key", key)
    labels = out.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    return Compressed(spread_join(out, labels, ["key"], "n", out.count()).select("id", "label", "code", "error", "label_error"), books)
