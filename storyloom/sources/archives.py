"""ZIP archives: their members as rows, and rows as archives. Spark reads and writes the files; an archive is one row.
A key with much content has several archives, so that none outgrows a row and tasks share the work."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.operators.scans import joined

#: The time that members of written archives have, so that equal contents are equal archives.
EPOCH = (1980, 1, 1, 0, 0, 0)
MEMBER = "path string, name string, length long, content binary, error string"
MEMBER_TYPE = pa.schema([("path", pa.string()), ("name", pa.string()), ("length", pa.int64()), ("content", pa.binary()), ("error", pa.string())])

#: Bytes of content that an archive of ``archives`` holds, about, and members and bytes of these that are given on at once.
VOLUME = 1 << 25
MEMBERS, MEMBER_BYTES = 1000, 1 << 22


def members(spark: SparkSession, path: str, pattern: str = "*.zip", ending: str = "") -> DataFrame:
    """(path, name, length, content, error) of the members of archives whose names end so; folders are left out.

    A damaged member has no content and says what is wrong; of a file that is no archive there is one row without a name.
    Members are unpacked one after the other.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return unpacked(found, ending)


def unpacked(found: DataFrame, ending: str = "") -> DataFrame:
    """As ``members``, of archives (path, content) that are rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for path, content in ((p.as_py(), c.as_py()) for batch in batches for p, c in zip(batch["path"], batch["content"], strict=True)):
            row = {"path": path, "name": None, "length": None, "content": None, "error": None}
            try:
                archive = zipfile.ZipFile(io.BytesIO(content))
            except zipfile.BadZipFile as e:
                yield row | {"error": str(e)}
                continue
            for info in archive.infolist():
                if info.is_dir() or not info.filename.endswith(ending):
                    continue
                one = row | {"name": info.filename, "length": info.file_size}
                try:
                    one["content"] = archive.read(info)
                except Exception as e:  # what a damaged member raises depends on the damage
                    one["error"] = f"{type(e).__name__}: {e}"
                yield one

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for one in each(batches):
            out.append(one)
            size += len(one["content"] or b"")
            if len(out) >= MEMBERS or size >= MEMBER_BYTES:
                yield pa.RecordBatch.from_pylist(out, MEMBER_TYPE)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, MEMBER_TYPE)

    return found.select("path", "content").mapInArrow(run, MEMBER)


def metadata(files: DataFrame) -> DataFrame:
    """(path, name, line_no, line): lines of the metadata.jsonl of every archive, at its root or one folder below."""
    there = files.filter(F.col("name").rlike(r"^([^/]+/)?metadata\.jsonl$") & F.col("content").isNotNull())
    lines = F.split(F.decode("content", "UTF-8"), r"\r?\n")
    return there.select("path", "name", F.posexplode(lines).alias("line_no", "line")).filter(F.trim("line") != "")


def archives(files: DataFrame, key: str, volume: int = VOLUME) -> DataFrame:
    """(``key``, archive): a ZIP of the files (``key``, name, content) of each key, members in order of their names. A key
    with more than ``volume`` bytes of content has so many more archives, its files dealt by their names; each archive is
    put together by one task."""
    fields = T.StructType([files.schema[key], T.StructField("archive", T.BinaryType())])

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, content in sorted(zip(group["name"], group["content"], strict=True), key=lambda m: m[0]):
                z.writestr(zipfile.ZipInfo(name, EPOCH), content or b"", zipfile.ZIP_DEFLATED)
        return pd.DataFrame({key: group[key].iloc[:1].to_numpy(), "archive": [out.getvalue()]})

    told = files.select(key, "name", F.col("content").cast("binary").alias("content"))
    sizes = told.groupBy(key).agg(F.ceil(F.sum(F.octet_length("content")) / volume).alias("volumes")).filter("volumes > 1")
    # Each of these keys has more than a volume, so they are few.
    dealt = joined(told, F.broadcast(sizes), [key])
    dealt = dealt.withColumn("volume", F.pmod(F.xxhash64("name"), F.coalesce("volumes", F.lit(1)))).drop("volumes")
    return dealt.groupBy(key, "volume").applyInPandas(pack, fields)
