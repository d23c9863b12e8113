"""Annotations of a recording in time and frequency: limits, groups, windows of a spectrogram, drawn masks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of spectrograms and masks that are handed on together.
CELLS = 1 << 18


def notes(media: DataFrame) -> DataFrame:
    """One row for each annotation of nested media, with the keys of its group if it is in one."""
    first = media.withColumn("_n", F.explode("data"))
    fields = first.schema["_n"].dataType.fieldNames()
    keys = [f for f in fields if f.startswith("gkey_")]
    if "data" in fields:
        return first.select("orid", *[F.col(f"_n.{k}") for k in keys], F.explode("_n.data").alias("_n")).select("orid", *keys, *_rest(first, keys))
    return first.select("orid", *[F.col(f"_n.{f}") for f in fields if f != "orid"])


def _rest(first: DataFrame, keys: list[str]):
    inner = first.schema["_n"].dataType["data"].dataType.elementType.fieldNames()
    return [F.col(f"_n.{f}") for f in inner if f != "orid"]


def select_notes(df: DataFrame, ids: list[int] | None = None, groups: dict[str, list] | None = None) -> DataFrame:
    """Annotations by id, by group keys, or all."""
    if ids is not None:
        df = df.where(F.col("id").isin(*ids))
    for key, values in (groups or {}).items():
        df = df.where(F.col(key).isin(*values))
    return df


def limits(df: DataFrame, keys: list[str]) -> DataFrame:
    """Bounding box (start, end, lowest and highest frequency) and number of the annotations of each group."""
    return df.groupBy(*keys).agg(
        F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.min("min_freq").alias("min_freq"),
        F.max("max_freq").alias("max_freq"), F.count(F.lit(1)).alias("n"),
    )


def geometries(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Vertices of each annotation, or a list of them for each group, in order of id."""
    if not keys:
        return df.select("orid", "id", "verts")
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "verts"))), lambda s: s.verts).alias("verts"))


@dataclass(frozen=True)
class Window:
    """A part of a spectrogram in bins, and how far its frame sticks out at each side."""

    time: tuple[int, int]
    freq: tuple[int, int]
    before: tuple[int, int]
    after: tuple[int, int]

    def cut(self, spec: np.ndarray) -> np.ndarray:
        """The window of a (frequency, time) matrix."""
        return self.framed(spec[self.freq[0] : self.freq[1], self.time[0] : self.time[1]])

    def framed(self, part: np.ndarray) -> np.ndarray:
        """What lies in the window, with its frame; what lies outside repeats the border."""
        return np.pad(part, ((self.before[1], self.after[1]), (self.before[0], self.after[0])), "edge")


def to_bins(low: float, high: float, extent: float, bins: int) -> tuple[int, int]:
    """First bin and end bin of a range of an axis; at least one bin, within the axis."""
    first = min(max(int(np.floor(low / extent * bins)), 0), bins - 1)
    return first, min(max(int(np.ceil(high / extent * bins)), first + 1), bins)


def window_of(box: tuple[float, float, float, float], duration: float, top_freq: float, shape: tuple[int, int], size: tuple[float | None, float | None] = (None, None), truncate: bool = False) -> Window:
    """The window around a box (start, end, min_freq, max_freq) of a spectrogram of ``shape`` (frequency, time bins).

    ``size`` is its length in seconds and hertz; a smaller box is centred in it. With ``truncate`` a larger one is cut to a
    third of the size at each side of its middle; else it keeps its own length.
    """
    start, end, low, high = box
    pairs = []
    for a, b, extent, bins, want in ((start, end, duration, shape[1], size[0]), (low, high, top_freq, shape[0], size[1])):
        if want is not None and b - a > want and truncate:
            middle = (a + b) / 2
            a, b = middle - want / 3, middle + want / 3
        first, stop = to_bins(max(a, 0.0), min(b, extent), extent, bins)
        before = after = 0
        if want is not None:
            lack = max(int(round(want / extent * bins)) - (stop - first), 0)
            lead = lack // 2
            before, after = max(lead - first, 0), max(stop + lack - lead - bins, 0)
            first, stop = max(first - lead, 0), min(stop + lack - lead, bins)
        pairs.append(((first, stop), before, after))
    (time, tb, ta), (freq, fb, fa) = pairs
    return Window(time, freq, (tb, fb), (ta, fa))


def draw(verts: list[list[float]], duration: float, top_freq: float, shape: tuple[int, int], closed: bool = False, within: tuple[tuple[int, int], tuple[int, int]] | None = None) -> np.ndarray:
    """A mask of ``shape`` (frequency, time bins) with the line through (time, frequency) vertices; of the bins ``within`` only."""
    rows_of, cols_of = within or ((0, shape[0]), (0, shape[1]))
    mask = np.zeros((rows_of[1] - rows_of[0], cols_of[1] - cols_of[0]), np.uint8)

    def put(rows: np.ndarray, cols: np.ndarray) -> None:
        inside = (rows >= rows_of[0]) & (rows < rows_of[1]) & (cols >= cols_of[0]) & (cols < cols_of[1])
        mask[rows[inside] - rows_of[0], cols[inside] - cols_of[0]] = 1

    if not verts:
        return mask
    points = np.array(verts, float)
    cols = np.clip(points[:, 0] / duration * shape[1], 0, shape[1] - 1)
    rows = np.clip(points[:, 1] / top_freq * shape[0], 0, shape[0] - 1)
    if closed and len(points) > 2:
        cols, rows = np.append(cols, cols[0]), np.append(rows, rows[0])
    put(rows.round().astype(int), cols.round().astype(int))
    for x0, y0, x1, y1 in zip(cols, rows, cols[1:], rows[1:], strict=False):
        steps = int(np.ceil(max(abs(x1 - x0), abs(y1 - y0)))) + 1
        xs, ys = np.linspace(x0, x1, steps), np.linspace(y0, y1, steps)
        for fx, fy in ((np.floor(xs), np.floor(ys)), (np.ceil(xs), np.ceil(ys))):
            near = (np.abs(fx - xs) < 1) & (np.abs(fy - ys) < 1)
            put(fy[near].astype(int), fx[near].astype(int))
    return mask


def profile(mask: np.ndarray, axis: str) -> np.ndarray:
    """A mask reduced to one dimension: 1 where anything is drawn along time or frequency."""
    return mask.max(axis=0 if axis == "time" else 1)


def annotation_matrices(
    recordings: DataFrame, window: tuple[float | None, float | None] = (None, None), truncate: bool = False, channel: int | None = None, n_fft: int = 1024, hop: int = 512, masks: str = "window"
) -> DataFrame:
    """(orid, id, start, stop, low, high, spec, mask): for each annotation of recordings with content or path, media_info and data,
    its bins of time and frequency, the spectrogram there, and what is drawn of it.

    ``masks`` is "window" (a mask of the window), "time" or "frequency" (reduced to one axis, as one row), or "whole" (a
    mask of the whole recording, and no spectrogram). Annotations without vertices are drawn as their box; without
    frequencies they span all of them. Of a path only the frames of a window are read, a window at a time, and for "whole"
    none; a recording without annotations gives no rows.
    """
    from chirplake.functions.dsp import frame_count, frequencies, pick_channel, stft
    from chirplake.sources.media import BytesFile, RangedFile, header, padded, samples

    nested = "data" in recordings.schema["data"].dataType.elementType.fieldNames()

    def number(x: Any, other: float) -> float:
        return other if x is None or pd.isna(x) else float(x)

    def rows(row: Any, file: Any) -> Iterator[tuple]:
        head = header(file)
        timeexp, pad = number(row.media_info["timeexp"], 1.0), n_fft // 2
        shape = (n_fft // 2 + 1, frame_count(head.nframes, n_fft, hop))
        duration, top = head.nframes / head.samplerate / timeexp, float(frequencies(int(head.samplerate * timeexp), n_fft)[-1])
        one = lambda a, k: pick_channel(samples(file, head, a, k), channel)
        for note in [n for g in row.data for n in g["data"]] if nested else row.data:
            start, stop = number(note["start_time"], 0.0), number(note["end_time"], duration)
            low, high = number(note["min_freq"], 0.0), number(note["max_freq"], top)
            verts = [list(v) for v in note["verts"]] if note["verts"] is not None and len(note["verts"]) else [[start, low], [stop, low], [stop, high], [start, high]]
            closed = note["notetype"] in ("bbox", "polygon", "multipolygon", "weak", "interval")
            w = window_of((start, stop, low, high), duration, top, shape, window, truncate)
            if masks == "whole":
                cut, mask = None, draw(verts, duration, top, shape, closed)
            else:
                a, b = w.time
                x = padded(one, head.nframes, a * hop - pad, (b - 1) * hop - pad + n_fft, pad)
                cut = w.framed(np.abs(stft(x, n_fft, hop, center=False))[w.freq[0] : w.freq[1]])
                mask = w.framed(draw(verts, duration, top, shape, closed, (w.freq, w.time)))
                mask = mask if masks == "window" else profile(mask, masks)[None, :]
            yield (row.orid, note["id"], w.time[0], w.time[1], w.freq[0], w.freq[1], None if cut is None else list(cut), [m.tolist() for m in mask])

    def frame(held: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(held, columns=["orid", "id", "start", "stop", "low", "high", "spec", "mask"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, cells = [], 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                with BytesFile(row.source) if isinstance(row.source, bytes) else RangedFile(row.source) as file:
                    for out in rows(row, file):
                        held.append(out)
                        cells += sum(len(x) * len(x[0]) for x in out[6:] if x is not None and len(x)) + 1
                        if cells >= CELLS:
                            yield frame(held)
                            held, cells = [], 0
        if held:
            yield frame(held)

    source = F.col("content" if "content" in recordings.columns else "path").alias("source")
    chosen = recordings.select("orid", "media_info", "data", source)
    if "content" not in recordings.columns:  # a row is small and its work isn't: dealt by number, as bytes would put many into a task
        spark = recordings.sparkSession
        chosen = chosen.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), F.xxhash64("orid"))  # not orid itself: a shuffle by it before would stand for this one
    return chosen.mapInPandas(run, "orid long, id long, start int, stop int, low int, high int, spec array<array<double>>, mask array<array<int>>")
