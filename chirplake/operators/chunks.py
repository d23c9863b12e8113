"""Recordings cut into time chunks: the rows of the split table, and the limits of exported chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Channel number of recordings read without channels.
NO_CHANNEL = 99


def chunk_count(duration: Column, step: float) -> Column:
    """Chunks of a recording: its length in steps, halves to even; a tail of half a step or more stays."""
    return F.greatest(F.bround(duration / F.lit(float(step))).cast("int"), F.lit(0))


def python_float(x: Column) -> Column:
    """Text of a number of seconds as Python prints it, for numbers up to 1e16 with at most six decimals."""
    fixed = F.regexp_replace(F.format_string("%.6f", x), r"0+$", "")
    return F.when(fixed.endswith("."), F.concat(fixed, F.lit("0"))).otherwise(fixed)


def split_time(df: DataFrame, step: float = 60.0, duration: str = "fileDuration", orid: str = "orid", channels: Column | None = None) -> DataFrame:
    """One row for each chunk and channel: chunkId, chunkFileStart, chunkFileStop, chunkDuration, and absolute limits if
    the recordings have ``absStart``.

    ``channels`` is an array of channel numbers; without it rows have NO_CHANNEL. A recording shorter than half a step
    has no rows.
    """
    n = chunk_count(F.col(duration), step)
    numbers = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    out = df.withColumn("_k", F.explode(numbers))
    start = F.col("_k") * F.lit(float(step))
    stop = F.least(start + F.lit(float(step)), F.col(duration).cast("double"))
    out = out.withColumn("chunkFileStart", start).withColumn("chunkFileStop", stop).withColumn("chunkDuration", F.col("chunkFileStop") - F.col("chunkFileStart"))
    if "absStart" in df.columns:
        out = out.withColumn("chunkAbsStart", F.col("absStart") + F.col("chunkFileStart")).withColumn("chunkAbsStop", F.col("absStart") + F.col("chunkFileStop"))
        limits = ("chunkAbsStart", "chunkAbsStop")
    else:
        limits = ("chunkFileStart", "chunkFileStop")
    out = out.withColumn("chunkId", F.concat_ws("-", F.col(orid).cast("string"), *[python_float(F.col(c)) for c in limits]))
    wanted = channels if channels is not None else F.array(F.lit(NO_CHANNEL))
    return out.withColumn("channel", F.explode(wanted.cast("array<bigint>"))).drop("_k")


def all_channels(nchannels: Column) -> Column:
    """Numbers of all channels of a recording."""
    return F.when(nchannels > 0, F.sequence(F.lit(0), nchannels - 1)).otherwise(F.array(F.lit(0)))


def unit_size(samplerate: Column, step: float, n_fft: int, hop: int) -> Column:
    """Spectrum frames of a whole chunk."""
    return F.bround((samplerate * F.lit(float(step)) - n_fft) / F.lit(float(hop))).cast("int") + 1


def frame_range(frames: Column, duration: Column, start: Column, size: Column) -> tuple[Column, Column, Column]:
    """(first frame, end frame, weight) of a chunk; the last frame is never included, as the end is clamped to it.

    The weight is the share of a whole chunk's frames; under half a chunk a row has no energy.
    """
    first = F.least(F.bround(frames / duration * start).cast("int"), frames - 1)
    end = F.least(first + size, frames - 1)
    return first, end, (end - first) / size


def export_limits(df: DataFrame, chop: float | None, threshold: float = 1.0, duration: str = "duration") -> DataFrame:
    """Rows with tlimits and number of the chunks that an export of each recording has.

    A recording is one chunk if it is shorter than ``chop`` or than ``threshold`` times it; else whole chunks, and a tail
    of half a chunk or more.
    """
    d = F.col(duration).cast("double")
    if chop is None:
        return df.withColumn("tlimits", F.array(F.lit(0.0), d)).withColumn("number", F.lit(0))
    whole = F.floor(d / chop).cast("int")
    n = F.when((d < chop) | (d / chop <= threshold), 1).otherwise(whole + F.when(d / chop - whole >= 0.5, 1).otherwise(0))
    one = n == 1
    limits = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.array(i * F.lit(float(chop)), F.when(one, d).otherwise(F.least((i + 1) * F.lit(float(chop)), d))).alias("tlimits"), i.alias("number")))
    return df.withColumn("_c", F.explode(limits)).select(*df.columns, "_c.tlimits", "_c.number")
