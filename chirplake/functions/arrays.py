"""Arrays as columns: normalisation, channels, zero crossings, bands. No UDFs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def min_max_norm(values: Column) -> Column:
    """(x - min) / (max - min) of each element; null where all are equal."""
    low, high = F.array_min(values), F.array_max(values)
    return F.transform(values, lambda x: (x - low) / F.when(high > low, high - low))


def channel(channels: Column, n: int) -> Column:
    """One channel of an array of channels; null if there is none such."""
    return F.get(channels, F.lit(n))


def channel_mean(channels: Column) -> Column:
    """Mean over channels, sample by sample; one channel passes through."""
    total = F.aggregate(F.slice(channels, 2, F.greatest(F.size(channels) - 1, F.lit(0))), F.get(channels, F.lit(0)), lambda s, c: F.zip_with(s, c, lambda a, b: a + b))
    return F.transform(total, lambda x: x / F.size(channels))


def zero_crossing_rate(values: Column) -> Column:
    """Share of neighbouring samples of unlike sign (0 counts as positive)."""
    steps = F.transform(F.sequence(F.lit(0), F.size(values) - 2), lambda i: ((F.get(values, i) >= 0) != (F.get(values, i + 1) >= 0)).cast("int"))
    return F.when(F.size(values) > 1, F.aggregate(steps, F.lit(0), lambda s, x: s + x) / F.size(values)).otherwise(F.lit(0.0))


def frequencies(samplerate: Column | int, n_fft: int) -> Column:
    """Centre frequencies of the bins of a spectrum."""
    rate = F.lit(samplerate) if isinstance(samplerate, int) else samplerate
    return F.transform(F.sequence(F.lit(0), F.lit(n_fft // 2)), lambda k: k * rate / F.lit(float(n_fft)))


def bands(values: Column, cuts: list[tuple[int, int]], how: str = "sum") -> list[Column]:
    """One aggregate for each band [start, stop) of an array; an empty band is null."""
    out = []
    for start, stop in cuts:
        part = F.transform(F.slice(values, start + 1, max(stop - start, 0)), lambda x: x.cast("double"))
        total = F.aggregate(part, F.lit(0.0), lambda s, x: s + x)
        value = {"sum": total, "mean": total / F.size(part), "min": F.array_min(part), "max": F.array_max(part)}[how]
        out.append(F.when(F.size(part) > 0, value))
    return out


def level_range(limits: tuple[float, float], lowest: float, highest: float, levels: int) -> tuple[int, int]:
    """First and last level of a frequency range, both included; ends are clamped, halves round to even."""
    if limits[0] >= limits[1]:
        raise ValueError("the lower frequency limit must be below the upper one")
    unit = (highest - lowest) / levels
    at = lambda f: min(max(round((min(max(f, lowest), highest) - lowest) / unit), 0), levels - 1)
    return at(limits[0]), at(limits[1])


def plain_name(text: Column) -> Column:
    """Letters and digits, with blanks as underscores, of a name."""
    return F.regexp_replace(F.translate(F.translate(text, "_", ""), " ", "_"), r"[^\p{L}\p{N}_]", "")


def resolve_path(path: Column, media_dir: str) -> Column:
    """A bare file name is in the media folder; anything with a folder stays."""
    return F.when(F.instr(path, "/") == 0, F.concat(F.lit(media_dir.rstrip("/") + "/"), path)).otherwise(path)


def split_path(key: str) -> list[str]:
    """Parts of a dotted path with indexes: ``a.b[0].c`` to a, b, [0], c."""
    return re.findall(r"\[\d+\]|[^.\[\]]+", key)
