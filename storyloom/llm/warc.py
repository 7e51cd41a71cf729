"""WARC archives: written as text records, read back by boundary-chain verification.

Writing uses the text sink with CRLF CRLF as its line separator, which is the end of a WARC record, so files are whole
only once their task is committed. Reading uses the text source with the magic after CRLF CRLF as its separator, so that
Spark cuts plain files into byte ranges and streams compressed ones, and a row is all that lies between two places where
a record could begin. Tasks parse a header at every such place and emit (offset, successor) candidates. Pointer jumping
from offset 0, first within a byte range and then over the ranges of a file by joins, keeps the candidates that the
chain of records reaches; a magic inside a payload is never a successor on the chain.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyloom.llm.shared import new_path, saved, spread_join

#: Fixed value: what every version 1 record begins with.
MAGIC = b"WARC/1."
CRLF = "\r\n"
GAP = b"\r\n\r\n"

#: Separates two rows of an archive. It does not overlap itself, so byte ranges agree on where rows begin.
BREAK = GAP + MAGIC

#: Bytes of payload planned for one file; a record is never split.
FILE_BYTES = 8 << 20

#: Broken archives that an error names.
NAMED = 5

#: Bytes of the cells by which the rows of a record with several rows are found.
CELL = 1 << 16

#: The RFC 4648 base32 alphabet.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

ID = re.compile(rb"<urn:page:(-?\d{1,19})>")


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a binary column: eight groups of 20 bits, four letters each."""
    digits = F.sha1(data)
    letters = []
    for g in range(8):
        value = F.conv(F.substring(digits, 5 * g + 1, 5), 16, 10).cast("long")
        for k in (15, 10, 5, 0):
            letters.append(F.substring(F.lit(ALPHABET), F.shiftright(value, k).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)))
    return F.concat(*letters)


def header_safe(value: Column) -> Column:
    """A header value without control characters; null is empty."""
    return F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[\x00-\x1f\x7f]", "%")


def revisits(rows: DataFrame) -> DataFrame:
    """(id, n, digest, first): the distinct rows whose payload a row with the smaller id ``first`` has too.

    Works on ids and digests alone; payloads are dealt later, by id and digest, so that pages with one payload spread.
    """
    rows = saved(rows, "digests")
    repeated = saved(rows.groupBy("digest", "n").agg(F.min("id").alias("first"), F.count("*").alias("copies")).filter("copies > 1"), "payloads")
    both = spread_join(rows, repeated, ["digest", "n"], "copies", rows.count())
    return saved(both.filter(~F.col("id").eqNullSafe(F.col("first"))).select("id", "n", "digest", "first").distinct(), "revisits")


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(id, size, record): one record per row of ``pages``, without its final CRLF CRLF.

    Of rows with equal payloads (null: empty) the one with the smallest id is a response, the others are revisits that
    refer to it. Rows with equal ids share their fate. A null id is larger than all others and written as empty.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("n", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    moved = revisits(rows.select("id", "n", "digest")).select(F.col("id").alias("i"), F.col("n").alias("m"), F.col("digest").alias("d"), "first", F.lit(True).alias("again"))
    rows = rows.join(moved, F.col("id").eqNullSafe(F.col("i")) & (F.col("n") == F.col("m")) & (F.col("digest") == F.col("d")), "left")
    response = F.col("again").isNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF * 2))
    block = F.when(response, F.concat(http, F.col("payload"))).otherwise(http)
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    head = F.concat_ws(
        CRLF,
        F.lit("WARC/1.1"),
        F.when(response, F.lit("WARC-Type: response")).otherwise(F.lit("WARC-Type: revisit")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("id"))),
        F.concat(F.lit("WARC-Target-URI: "), header_safe(F.col("url"))),
        F.lit("WARC-Date: 2020-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_sha1(F.col("payload").cast("binary"))),
        F.when(~response, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(~response, F.concat(F.lit("WARC-Refers-To: "), name(F.col("first")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return rows.select("id", F.octet_length(block).alias("size"), F.concat(head, F.lit(CRLF * 2), block).alias("record"))


def write(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES, compression: str = "gzip", **columns) -> None:
    """Archives of about ``file_bytes`` each or less before compression, written by Spark's text sink to any file system.

    ``compression`` is gzip or none. Records are written where the join with the revisits left them; a file is closed
    after as many records as make ``file_bytes`` on average, so payloads are shuffled once at most.
    """
    rows = records(pages, **columns)
    size = F.coalesce(F.octet_length(columns.get("payload_col", "html")), F.lit(0)) + 600
    total, n = pages.agg(F.coalesce(F.sum(size), F.lit(0)), F.count("*")).first()
    most = max(1, int(n) * file_bytes // max(1, int(total)))
    rows.select("record").write.option("lineSep", CRLF * 2).option("compression", compression).option("maxRecordsPerFile", most).text(path)


def fields_of(head: bytes) -> dict[bytes, bytes] | None:
    """Header fields after the magic, names in lower case; a line that begins with a blank continues the one before.
    None if the header is unsound."""
    version, *lines = head.split(b"\r\n")
    if not version.isdigit():
        return None
    fields, name = {}, None
    for line in lines:
        if line[:1] in (b" ", b"\t") and name is not None:
            fields[name] += b" " + line.strip()
            continue
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        name = name.strip().lower()
        fields[name] = value.strip()
    return fields


def payload_facts(fields: dict[bytes, bytes], block: bytes) -> dict:
    """What is known of a record's payload from its whole block."""
    kind, media = fields.get(b"warc-type", b""), fields.get(b"content-type")
    http = media.startswith(b"application/http") if media is not None else kind in (b"response", b"revisit")
    body = block.find(GAP) + 4 if http and GAP in block else 0
    payload = block[body:]
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    claimed = fields.get(b"warc-payload-digest", b"").decode("utf-8", "replace").removeprefix("sha1:")
    if kind == b"revisit":
        said = re.search(rb"(?i)\r\ncontent-length: *(\d{1,18})", block[:body])
        return {"payload_bytes": int(said[1]) if said else 0, "digest": claimed, "sound": True, "body": body}
    return {"payload_bytes": len(payload), "digest": digest, "sound": claimed in ("", digest), "body": body}


def candidate(row: bytes, first: bool) -> dict | None:
    """The record that could begin with a row, with places counted from the row's own begin; None if there is none.

    The first row of a file has its magic, others lost theirs as a separator. ``closed`` tells whether the row shows the
    record's end; a record that goes on in other rows has no facts about its payload yet.
    """
    skip = len(MAGIC) if first else 0
    if first and not row.startswith(MAGIC):
        return None
    stop = row.find(GAP, skip)
    stop = len(row) if stop < 0 else stop
    fields = fields_of(row[skip:stop])
    length = (fields or {}).get(b"content-length", b"")
    if not length.isdigit() or len(length) > 18:
        return None
    begin = stop + len(GAP)
    end = begin + int(length)
    if end < len(row) and row[end : end + 4] != GAP:
        return None
    named = lambda key: fields.get(key, b"").decode("utf-8", "replace")
    number = lambda key: int(m[1]) if (m := ID.search(fields.get(key, b""))) and abs(int(m[1])) < 1 << 63 else None
    out = {
        "at": skip - len(MAGIC), "begin": begin, "end": end, "next": end + len(GAP), "closed": end < len(row), "several": end > len(row), "head": row[skip:stop],
        "kind": named(b"warc-type"), "id": number(b"warc-record-id"), "refers_to": number(b"warc-refers-to"), "record_id": named(b"warc-record-id"),
        "refers_to_id": named(b"warc-refers-to"), "url": named(b"warc-target-uri"),
    }
    return out if out["several"] else out | {"head": None} | payload_facts(fields, row[begin:end])


def exits(at: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """Where the chain from each ascending offset first leaves these offsets, by pointer jumping: the jumps double in
    length until none goes on."""
    n, out = len(at), successor.copy()
    place = np.searchsorted(at, successor)
    jump = np.append(np.where((place < n) & (at[np.minimum(place, n - 1)] == successor), place, n) if n else np.zeros(0, np.int64), n)
    last = np.arange(n + 1)
    for _ in range(int(n).bit_length()):
        last = np.where(jump < n, last[jump], last)
        jump = jump[jump]
    return out[last[:n]] if n else out


def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per byte range: its candidates, with places counted from the range's first row, and one row of no kind with the
    bytes of all its rows and separators."""
    key, rows, spot = None, [], 0

    def flushed() -> pa.RecordBatch:
        at, after = (np.array([r[c] for r in rows], np.int64) for c in ("at", "next"))
        for r, x in zip(rows, exits(at, after).tolist(), strict=True):
            r["exit"] = x
        return pa.RecordBatch.from_pylist([{"file": key[0], "range": key[1], **r} for r in [*rows, {"next": spot}]], CANDIDATE)

    for batch in batches:
        for name, start, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if (name, start) != key:
                if key is not None:
                    yield flushed()
                key, rows, spot = (name, start), [], 0
            row = value.as_py()
            got = candidate(row, start == 0 and not spot)
            if rows and not rows[-1]["several"]:
                rows[-1]["closed"] = True
            if got is not None:
                rows.append(got | {c: got[c] + spot for c in ("at", "begin", "end", "next")})
            spot += len(row) + len(BREAK)
    if key is not None:
        yield flushed()


CANDIDATE_DDL = (
    "file string, range long, at long, next long, exit long, closed boolean, several boolean, head binary, kind string, id long, refers_to long, record_id string, "
    "refers_to_id string, url string, begin long, end long, body long, payload_bytes long, digest string, sound boolean"
)
_ARROW = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
CANDIDATE = pa.schema([(x.split()[0], _ARROW[x.split()[1]]) for x in CANDIDATE_DDL.split(", ")])
RECORD = ("file", "at", "next", "kind", "id", "refers_to", "record_id", "refers_to_id", "payload_bytes", "digest", "sound", "url", "begin", "end")


def chain(table: pa.Table) -> pa.Table:
    """The candidates of one byte range that the chain reaches from the range's ``entry``."""
    at, after = table.column("at").to_numpy(), table.column("next").to_numpy()
    order = np.argsort(at)
    at, after = at[order], after[order]
    entry = int(np.searchsorted(at, table.column("entry")[0].as_py()))
    n = len(at)
    place = np.searchsorted(at, after)
    jump = np.append(np.where((place < n) & (at[np.minimum(place, n - 1)] == after), place, n), n)
    on = np.zeros(n + 1, bool)
    on[entry] = True
    for _ in range(n.bit_length() + 1):
        on[jump[np.flatnonzero(on)]] = True
        jump = jump[jump]
    return table.take(pa.array(order[on[:n]])).drop_columns(["entry"])


def archive_rows(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """(file, range, value): what lies between two places where a record could begin, in order within a byte range.
    A compressed file that is damaged ends there, or is an error with ``whole``."""
    lines = spark.read.option("lineSep", BREAK.decode()).option("recursiveFileLookup", "true").option("ignoreCorruptFiles", str(not whole).lower()).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.col("value").cast("binary").alias("value"))


def placed(spark: SparkSession, path: str, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """(candidates with places in their file, byte ranges with the place ``base`` of their first row and the file's size)."""
    found = saved(archive_rows(spark, path, whole).mapInArrow(candidates, CANDIDATE_DDL), "candidates")
    ranges = found.filter("at is null").select("file", "range", F.col("next").alias("bytes"))
    by = Window.partitionBy("file")
    base = F.sum("bytes").over(by.orderBy("range")) - F.col("bytes")
    ranges = saved(ranges.select("file", "range", base.alias("base"), (F.sum("bytes").over(by) - len(BREAK)).alias("size")), "ranges")
    found = found.filter("at is not null").join(ranges.select("file", "range", "base"), ["file", "range"])
    return found.select(*[(F.col(c) + F.col("base") if c in ("at", "next", "exit", "begin", "end") else F.col(c)).alias(c) for c in CANDIDATE.names]), ranges


def entries(found: DataFrame) -> DataFrame:
    """(file, at): where the chain from offset 0 enters each byte range that has a record, by pointer jumping.

    A range can only be entered at offset 0 or where the chains of some range lead, so jumps are kept for these places
    alone: a few for each range, however many candidates it has. A jump leads to where a chain leaves the range; jumps
    double in length in every round, so the rounds grow with the logarithm of the ranges of a file.
    """
    begins = found.filter("at = 0").select("file", "at")
    enterable = found.select("file", F.col("exit").alias("at")).unionByName(begins).distinct()
    jumps = saved(found.select("file", "at", F.col("exit").alias("to")).join(enterable, ["file", "at"], "left_semi"), "jumps")
    spots = jumps.select("file", F.col("at").alias("to"))
    reach = saved(jumps.filter("at = 0").select("file", "at"), "reached")
    while True:
        after = reach.join(jumps, ["file", "at"]).select("file", "to").join(spots, ["file", "to"], "left_semi").select("file", F.col("to").alias("at"))
        fresh = saved(after.join(reach, ["file", "at"], "left_anti"), "reached")
        if fresh.isEmpty():
            return reach
        reach = saved(reach.unionByName(fresh), "reached")
        jumps = saved(jumps.join(jumps.select("file", F.col("at").alias("to"), F.col("to").alias("beyond")), ["file", "to"]).select("file", "at", F.col("beyond").alias("to")), "jumps")


def chained(spark: SparkSession, path: str, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records that the chains reach and that end as they should, byte ranges)."""
    found, ranges = placed(spark, path, whole)
    first = entries(found).withColumnRenamed("at", "entry")
    home = found.select("file", "range", F.col("at").alias("entry")).join(first, ["file", "entry"])
    reached = found.join(home, ["file", "range"]).groupBy("file", "range").applyInArrow(chain, CANDIDATE_DDL)
    starts = ranges.filter("base > 0").select("file", (F.col("base") - len(MAGIC)).alias("next"))
    ends = found.select("file", F.col("at").alias("next")).unionByName(starts).unionByName(ranges.select("file", F.col("size").alias("next"))).distinct()
    ended = reached.filter("closed").unionByName(reached.filter("not closed").join(ends, ["file", "next"], "left_semi"))
    return saved(ended, "records"), ranges


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Facts of records from their rows, which are pieces (at, value) of the file without separators."""
    names = ["file", "at", "body", "payload_bytes", "digest", "sound"]
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            data = BREAK.join(x["value"] for x in r["pieces"])
            begin = r["begin"] - r["pieces"][0]["pos"]
            out.append({"file": r["file"], "at": r["at"]} | payload_facts(fields_of(r["head"]), data[begin : begin + r["end"] - r["begin"]]))
        yield pa.RecordBatch.from_pylist(out, pa.schema([CANDIDATE.field(n) for n in names]))


def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their place, counted from their byte range's first row."""
    key, spot = None, 0
    for batch in batches:
        at = []
        for name, start, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if (name, start) != key:
                key, spot = (name, start), 0
            at.append(spot)
            spot += len(value.as_buffer()) + len(BREAK)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], ["file", "range", "value", "pos"])


def facts_of_several(spark: SparkSession, path: str, ranges: DataFrame, several: DataFrame) -> DataFrame:
    """Facts about the payloads of records of several rows, which a second pass over the archives brings together."""
    rows = archive_rows(spark, path).mapInArrow(positions, "file string, range long, value binary, pos long").join(ranges.select("file", "range", "base"), ["file", "range"])
    rows = rows.select("file", (F.col("pos") + F.col("base")).alias("pos"), "value").withColumn("cell", F.expr(f"pos div {CELL}"))
    want = several.select("file", "at", "begin", "end", "head", F.explode(F.expr(f"sequence(greatest(at, 0) div {CELL}, end div {CELL})")).alias("cell"))
    both = rows.join(want, ["file", "cell"]).filter("pos >= at and pos <= end")
    whole = both.groupBy("file", "at", "begin", "end", "head").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("pieces"))
    return whole.mapInArrow(gathered, "file string, at long, body long, payload_bytes long, digest string, sound boolean")


def stops(found: DataFrame, ranges: DataFrame) -> DataFrame:
    """(file, at, size) of files whose chain of records stops, at ``at``, before their end."""
    reached = found.groupBy("file").agg(F.max("next").alias("at"))
    files = ranges.select("file", "size").distinct().join(reached, "file", "left")
    return files.select("file", F.coalesce("at", F.lit(0)).cast("long").alias("at"), "size").filter("at <> size")


def read(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """One row per record of the archives under ``path``: file, at, next, kind, id, refers_to, record_id, refers_to_id,
    payload_bytes, digest, sound, url, begin, end (the payload's bytes in the file).

    Records of any version 1.x are read, with headers of any length and continued header lines. ``id`` and ``refers_to``
    are the numbers of this module's own record names, else null. Payload bytes and digest are computed from what is
    stored; those of a revisit are what its headers say. Plain files are read by byte ranges. Files whose names end in
    .gz, of one member or one for each record, are streamed, each by one task; their offsets are those of the
    decompressed bytes. A task holds one row at a time and the small rows of its range's candidates; a record that holds
    what looks like the begin of others is put together by a shuffle. An archive that breaks off or is damaged keeps its
    records up to there, see ``breaks``; with ``whole`` it is an error that names some of the files. An empty archive has
    no records; a folder of empty ones gives an empty table.
    """
    found, ranges = chained(spark, path, whole)
    if whole and (broken := stops(found, ranges).limit(NAMED).collect()):
        raise ValueError("archives break off: " + ", ".join(f"{r.file} at {r['at']} of {r['size']}" for r in broken))
    several = found.filter("several")
    out = found.filter("not several")
    if not several.isEmpty():
        facts = facts_of_several(spark, path, ranges, several)
        rest = several.drop("body", "payload_bytes", "digest", "sound").join(facts, ["file", "at"])
        out = out.unionByName(rest)
    return out.withColumn("begin", F.col("begin") + F.col("body")).select(*RECORD)


def not_empty(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The compressed files that hold anything or cannot be opened, from their contents; only the first byte is inflated."""
    for batch in batches:
        bad = []
        for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            try:
                if not gzip.open(io.BytesIO(data.as_buffer())).read(1):
                    continue
            except (OSError, EOFError, zlib.error):
                pass
            bad.append(name)
        yield pa.RecordBatch.from_arrays([pa.array(bad, pa.string())], ["file"])


def breaks(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, size) of the archives under ``path`` whose chain of records stops, at ``at``, before the file's end.

    ``size`` is what could be read, in bytes after decompression; null where a damaged file gave nothing at all, which is
    found by listing the files and opening those without any row.
    """
    found, ranges = chained(spark, path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter("length > 0")
    silent = files.select(F.col("_metadata.file_path").alias("file"), "content").join(ranges.select("file").distinct(), "file", "left_anti")
    unread = silent.mapInArrow(not_empty, "file string").select("file", F.lit(0).cast("long").alias("at"), F.lit(None).cast("long").alias("size"))
    return stops(found, ranges).unionByName(unread)


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and reads them back, one row a page; archives that do not come
    back whole are an error. An empty table gives an empty one; very long texts are records like any other, up to Spark's
    2 GB for a value."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path, **columns)
    return read(spark, path, whole=True)
