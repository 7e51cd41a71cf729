"""Durations of wave files from their headers, by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file in which its parts are looked for, and how many of these at most.
HEAD, PARTS = 1 << 16, 64

#: Names of the parts, as hex digits.
RIFF, WAVE, FMT, DATA = "52494646", "57415645", "666D7420", "64617461"


def number(digits: Column, at: Column, size: int) -> Column:
    """The little-endian number of ``size`` bytes at byte ``at`` of hex digits."""
    byte = lambda i: F.substring(digits, (at * 2 + 2 * i + 1).cast("int"), F.lit(2))
    return F.conv(F.concat(*[byte(i) for i in reversed(range(size))]), 16, 10).cast("long")


def wav_ms(content: Column, length: Column) -> Column:
    """Milliseconds of a wave file by its bytes and ``length``, rounded down; null for anything else.

    Parts are gone through one after the other, so it does not matter which come before the format and the sound. A
    writer that did not know the size leaves 0 or all ones; then the sound goes to the end of the file.
    """
    digits = F.hex(F.substring(content, F.lit(1), F.lit(HEAD)))
    name = lambda at: F.substring(digits, (at * 2 + 1).cast("int"), F.lit(8))
    state = lambda at, rate, sound: F.struct(at.cast("long").alias("at"), rate.cast("long").alias("rate"), sound.cast("long").alias("sound"))
    none = F.lit(None).cast("long")

    def step(s: Column, _: Column) -> Column:
        size, rest = number(digits, s["at"] + 4, 4), F.greatest(length - s["at"] - 8, F.lit(0))
        sound = F.when(size.isin(0, 0xFFFFFFFF), rest).otherwise(F.least(size, rest))
        done = s["sound"].isNotNull() | size.isNull()
        following = F.when(done, s["at"]).otherwise(s["at"] + 8 + size + size % 2)
        rate = F.when(~done & (name(s["at"]) == FMT), number(digits, s["at"] + 16, 4)).otherwise(s["rate"])
        return state(following, rate, F.when(~done & (name(s["at"]) == DATA), sound).otherwise(s["sound"]))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(PARTS)), state(F.lit(12), none, none), step)
    ms = F.transform(F.array(found), lambda s: F.when(s["rate"] > 0, F.call_function("floor", s["sound"] * 1000 / s["rate"])))[0]
    return F.when((name(F.lit(0)) == RIFF) & (name(F.lit(8)) == WAVE), ms)


def durations(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, dur_ms) of the .wav files under a folder."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path)
    return found.select("path", "length", wav_ms(F.col("content"), F.col("length")).alias("dur_ms"))
