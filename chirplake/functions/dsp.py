"""Signals in numpy, and the Arrow functions that run them where the recordings are."""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Transform = Callable[..., Any]
#: Named callables for signals, spectrograms, bands and whole spectra; users add their own.
TRANSFORMS: dict[str, Transform] = {"sum": np.sum, "mean": np.mean, "max": np.max, "min": np.min, "std": np.std, "median": np.median, "abs": np.abs, "square": np.square}


def register(name: str, function: Transform) -> None:
    TRANSFORMS[name] = function


def apply(transform: dict | str | None, value: Any, **context: Any) -> Any:
    """A named transform with its arguments; an argument ``"$name"`` takes that value of the context. None: unchanged."""
    if transform is None:
        return value
    spec = {"transform": transform} if isinstance(transform, str) else transform
    kwargs = {k: context[v[1:]] if isinstance(v, str) and v.startswith("$") else v for k, v in spec.get("kwargs", {}).items()}
    return TRANSFORMS[spec["transform"]](value, **kwargs)


def wav_info(content: bytes) -> dict[str, Any]:
    """Sample rate, channels, sample width and frames of a RIFF file, from its header."""
    from chirplake.sources.media import HEADER_FIELDS, BytesFile, header

    found = header(BytesFile(content))
    return {k: getattr(found, k) for k in HEADER_FIELDS}


def decode(content: bytes, offset: float = 0.0, duration: float | None = None, sr: int | None = None) -> tuple[np.ndarray, int]:
    """(channels x samples from -1 to 1, sample rate) of a window of a file in memory, resampled if ``sr`` is given."""
    from chirplake.sources.media import BytesFile, window

    return window(BytesFile(content), offset, duration, sr)


def masked(mask: tuple[float, float] | None, timeexp: float | None) -> tuple[float, float | None]:
    """Offset and duration in the file of a window in real time; a file with a time expansion is read that much earlier."""
    if mask is None:
        return 0.0, None
    if mask[0] < 0 or mask[1] <= mask[0]:
        raise ValueError("a mask starts at 0 or later and ends after its start")
    return mask[0] / (timeexp or 1.0), (mask[1] - mask[0]) / (timeexp or 1.0)


def resample(x: np.ndarray, rate: int, sr: int) -> np.ndarray:
    """Band-limited resampling of each channel through its spectrum."""
    n = int(round(x.shape[-1] * sr / rate))
    if not n or not x.shape[-1]:
        return np.zeros((*x.shape[:-1], n))
    spectrum = np.fft.rfft(x, axis=-1)
    out = np.zeros((*x.shape[:-1], n // 2 + 1), complex)
    keep = min(out.shape[-1], spectrum.shape[-1])
    out[..., :keep] = spectrum[..., :keep]
    return np.fft.irfft(out, n, axis=-1) * n / x.shape[-1]


def encode(x: np.ndarray, rate: int) -> bytes:
    """A 16-bit PCM file of channels x samples (or samples)."""
    x = np.atleast_2d(x)
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(x.shape[0]), f.setsampwidth(2), f.setframerate(rate)
        f.writeframes(np.clip(np.round(x.T * 32767), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def pick_channel(x: np.ndarray, channel: int | None) -> np.ndarray:
    """A channel, or the mean of all; one-channel signals pass through."""
    if x.ndim == 1:
        return x
    if channel is None:
        return x.mean(axis=0) if len(x) > 1 else x[0]
    if not 0 <= channel < len(x):
        raise ValueError(f"no channel {channel}")
    return x[channel]


def stft(x: np.ndarray, n_fft: int = 1024, hop: int = 512, win_length: int | None = None, center: bool = True) -> np.ndarray:
    """Complex spectra (1 + n_fft / 2 bins x frames) under a periodic Hann window, padded by reflection if centred."""
    win = win_length or n_fft
    window = np.zeros(n_fft)
    lead = (n_fft - win) // 2
    window[lead : lead + win] = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(win) / win)
    if center and len(x):
        x = np.pad(x, n_fft // 2, "reflect" if len(x) > n_fft // 2 else "constant")
    if len(x) < n_fft:
        return np.zeros((n_fft // 2 + 1, 0), complex)
    frames = np.lib.stride_tricks.sliding_window_view(x, n_fft)[::hop]
    return np.fft.rfft(frames * window, axis=1).T


def spectrogram(x: np.ndarray, n_fft: int = 1024, hop: int = 512) -> np.ndarray:
    return np.abs(stft(x, n_fft, hop))


def frequencies(sr: int, n_fft: int) -> np.ndarray:
    return np.linspace(0, sr / 2, 1 + n_fft // 2)


def zcr(x: np.ndarray, frame_length: int = 2048, hop: int = 512, center: bool = True) -> np.ndarray:
    """Share of sign changes in each frame."""
    if center:
        x = np.pad(x, frame_length // 2, "edge") if len(x) else np.zeros(frame_length)
    if len(x) < frame_length:
        return np.zeros(0)
    crossed = np.concatenate(([False], np.signbit(x[1:]) != np.signbit(x[:-1])))
    return np.lib.stride_tricks.sliding_window_view(crossed, frame_length)[::hop].mean(axis=1)


def mel_filters(sr: int, n_fft: int, n_mels: int = 128) -> np.ndarray:
    """Triangular filters, evenly spaced on a scale that is linear to 1 kHz and logarithmic above, of equal area."""
    step, knee = 200.0 / 3, 1000.0
    log_step = np.log(6.4) / 27
    to_hz = lambda m: np.where(m < knee / step, m * step, knee * np.exp(log_step * (m - knee / step)))
    top = knee / step + np.log(max(sr / 2, knee) / knee) / log_step if sr / 2 > knee else sr / 2 / step
    edges = to_hz(np.linspace(0, top, n_mels + 2))
    freqs = frequencies(sr, n_fft)
    rise = (freqs - edges[:-2, None]) / np.diff(edges)[:-1, None]
    fall = (edges[2:, None] - freqs) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(rise, fall)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def mfcc(x: np.ndarray | None, sr: int, spec: np.ndarray | None = None, n_mfcc: int = 20, n_fft: int = 2048, hop: int = 512) -> np.ndarray:
    """Cepstral coefficients (n_mfcc x frames): orthonormal DCT-II of mel energies in decibels, 80 dB deep.

    ``spec`` is mel energies already in decibels.
    """
    if spec is None:
        power = mel_filters(sr, n_fft) @ spectrogram(x, n_fft, hop) ** 2
        spec = 10 * np.log10(np.maximum(power, 1e-10))
        if spec.size:
            spec = np.maximum(spec, spec.max() - 80)
    n = len(spec)
    k = np.arange(n_mfcc)[:, None]
    basis = np.cos(np.pi * k * (2 * np.arange(n) + 1) / (2 * n)) * np.sqrt(2 / n)
    basis[0] /= np.sqrt(2)
    return basis @ spec


def frequency_bands(freqs: np.ndarray, limits: tuple[float, float], n: int) -> list[tuple[int, int]]:
    """(first, end) bins of n bands of equal width from the lower limit; edges go to the nearest bin."""
    step = round(int(limits[1] - limits[0]) / n)
    at = [int(np.abs(freqs - (limits[0] + i * step)).argmin()) for i in range(n + 1)]
    return list(zip(at, at[1:], strict=False))


def frame_count(n: int, n_fft: int, hop: int) -> int:
    """Frames of a centred spectrogram of n samples."""
    padded = n + 2 * (n_fft // 2)
    return (padded - n_fft) // hop + 1 if n and padded >= n_fft else 0


def chunk_frames(frames: int, duration: float, start: float, size: int) -> tuple[int, int]:
    """(first, end) frames of a chunk of ``size`` frames from ``start``; the last frame is never included."""
    first = min(round(frames / duration * start), frames - 1) if duration else 0
    return first, max(min(first + size, frames - 1), first)


def band_values(part: np.ndarray, cuts: list[tuple[int, int]], aggr: dict | str = "sum", spec_transform: dict | str | None = None, full_spec: dict | None = None) -> list[float | None]:
    """A value for each band of a slice of a spectrogram; none for a band without bins.

    ``full_spec`` gives the values from the whole slice instead, as a dict with its out_names in order.
    """
    if full_spec:
        got = apply(full_spec, part, fCuts=cuts)
        return [float(got[k]) for k in full_spec["out_names"]]
    part = apply(spec_transform, part, fCuts=cuts)
    return [float(apply(aggr, part[a:b])) if b > a else None for a, b in cuts]


def slice_energy(
    spec: np.ndarray, duration: float, start: float, size: int, cuts: list[tuple[int, int]], aggr: dict | str = "sum", spec_transform: dict | str | None = None, full_spec: dict | None = None
) -> tuple[int, float, list[float | None]]:
    """(frames, weight, a value for each band) of a chunk of a whole spectrogram; one of under half the frames has zeros."""
    first, end = chunk_frames(spec.shape[1], duration, start, size)
    n = end - first
    if n < size / 2:
        return n, n / size, [0.0] * (len(full_spec["out_names"]) if full_spec else len(cuts))
    return n, n / size, band_values(spec[:, first:end], cuts, aggr, spec_transform, full_spec)


#: Bytes of samples in a piece of a recording, and in a task.
PIECE_BYTES, TASK_BYTES = 32 << 20, 128 << 20


def pieces(recordings: DataFrame, config: Any, tasks: int) -> DataFrame:
    """``recordings`` (path, filesize, fileDuration and more) with the chunks ``_from`` to ``_until`` of each piece, dealt to tasks by size.

    A long recording is cut at chunk bounds into pieces of about PIECE_BYTES, each read by range; where a transform or a
    resampling needs the whole signal it is one piece. Pieces are ordered by path and laid end to end, and each stretch of
    TASK_BYTES of them (less, for ``tasks`` tasks at least) is a task. Rows that move have a path and numbers, no samples.
    Recordings without a whole chunk have no pieces, so they aren't opened.
    """
    from chirplake.operators.aggregates import dealt
    from chirplake.operators.chunks import chunk_count

    n = chunk_count(F.col("fileDuration"), config.tStep)
    size = F.coalesce(F.col("filesize").cast("double"), F.lit(float(PIECE_BYTES)))
    a_chunk = F.greatest(size * F.lit(float(config.tStep)) / F.col("fileDuration"), F.lit(1.0))
    each = n if config.readSr or config.signal else F.least(F.greatest(F.floor(F.lit(float(PIECE_BYTES)) / a_chunk).cast("int"), F.lit(1)), n)
    cut = recordings.withColumn("_each", each).where(n > 0).withColumn("_from", F.explode(F.sequence(F.lit(0), n - 1, F.col("_each"))))
    cut = cut.withColumn("_until", F.least(F.col("_from") + F.col("_each"), n)).withColumn("_weight", (F.col("_until") - F.col("_from")) * a_chunk)
    return dealt(cut.drop("_each"), "_weight", ["path", "_from"], TASK_BYTES, tasks).drop("_weight")


def energies(recordings: DataFrame, config: Any, carry: list[str]) -> DataFrame:
    """The split rows with energies of recordings (orid, path or content, timeexp, fileDuration, absStart...), by piece.

    Of a path only the samples that a chunk's frames need are read, a chunk at a time; ``_from`` and ``_until`` are the
    chunks of a piece, without them all are. The values are those of a spectrogram of the whole recording.
    """
    names = config.columns()
    kinds = dict(recordings.dtypes)
    cuts_sql = ", ".join(f"`{n}` double" for n in names)
    plain = [c.replace(".", f"_{i}_") for i, c in enumerate(carry)]  # Python functions take no column with a dot in its name
    schema = ", ".join(f"`{p}` {kinds[c]}" for p, c in zip(plain, carry, strict=True)) + ", chunkId string, chunkFileStart double, chunkFileStop double, chunkDuration double, chunkTbins long, chunkWeight double, chunkAbsStart double, chunkAbsStop double, channel long, " + cuts_sql

    def channels_of(n: int) -> list[int | None]:
        if config.channels is None:
            return [None]
        if config.channels == "__all__":
            return list(range(n))
        if len(config.channels) > n:
            raise ValueError("more channels asked for than there are")
        return list(config.channels)

    def rows(row: Any, carried: tuple, file: Any) -> Iterator[tuple]:
        from chirplake.sources.media import header, padded, samples, window

        head = header(file)
        timeexp = 1.0 if pd.isna(row.timeexp) or not row.timeexp else float(row.timeexp)
        if config.signal or (config.readSr and config.readSr != head.samplerate):
            x, rate = window(file, sr=config.readSr)
            x = np.atleast_2d(apply(config.signal, x)) if config.signal else x
            read, n_channels, length = (lambda a, k: x[:, a : a + k]), len(x), x.shape[1]
        else:
            rate, n_channels, length = head.samplerate, head.nchannels, head.nframes
            read = lambda a, k: samples(file, head, a, k)
        rate, duration = rate * timeexp, float(row.fileDuration)
        steps = max(int(round(duration / config.tStep)), 0)
        first, until = (0, steps) if pd.isna(row.first) else (int(row.first), int(row.until))
        size = int(round((rate * config.tStep - config.n_fft) / config.hop_length) + 1)
        cuts = frequency_bands(frequencies(rate, config.n_fft), tuple(config.fLimits), config.fBins)
        frames, pad = frame_count(length, config.n_fft, config.hop_length), config.n_fft // 2
        base = None if pd.isna(row.absStart) else row.absStart
        for channel in channels_of(n_channels):
            one = lambda a, k, channel=channel: pick_channel(read(a, k), channel)
            for k in range(first, until):
                start, stop = k * config.tStep, min((k + 1) * config.tStep, duration)
                low, high = chunk_frames(frames, duration, start, size)
                n = high - low
                if n < size / 2:
                    values: list[float | None] = [0.0] * len(names)
                else:
                    needed = padded(one, length, low * config.hop_length - pad, (high - 1) * config.hop_length - pad + config.n_fft, pad)
                    values = band_values(np.abs(stft(needed, config.n_fft, config.hop_length, center=False)), cuts, config.aggr, config.spec, config.full_spec)
                lo, hi = (None, None) if base is None else (base + start, base + stop)
                ends = (float(start), float(stop)) if base is None else (float(lo), float(hi))
                yield (*carried, f"{row.orid}-{ends[0]}-{ends[1]}", float(start), float(stop), float(stop - start), n, float(n / size), lo, hi, 99 if channel is None else channel, *values)

    columns = [*plain, "chunkId", "chunkFileStart", "chunkFileStop", "chunkDuration", "chunkTbins", "chunkWeight", "chunkAbsStart", "chunkAbsStop", "channel", *names]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from chirplake.sources.media import BytesFile, RangedFile

        opened: tuple[str, Any] = ("", None)
        for batch in batches:
            at = [batch.columns.get_loc(p) for p in plain]
            own = batch.reindex(columns=["orid", "_path", "content", "timeexp", "fileDuration", "absStart", "_from", "_until"])
            own = own.set_axis(["orid", "path", "content", "timeexp", "fileDuration", "absStart", "first", "until"], axis=1)
            for row, carried in zip(own.itertuples(index=False), batch.iloc[:, at].itertuples(index=False, name=None), strict=True):
                if isinstance(row.content, bytes):
                    file = BytesFile(row.content)
                elif row.path == opened[0]:  # pieces of a recording lie next to each other
                    file = opened[1]
                else:
                    file = RangedFile(row.path)
                    opened = (row.path, file)
                if out := list(rows(row, carried, file)):
                    yield pd.DataFrame(out, columns=columns)

    rest = [c for c in ("content", "timeexp", "_from", "_until") if c in recordings.columns]
    where = [F.col("path").alias("_path")] if "path" in recordings.columns else []
    named = recordings.select(*[F.col(f"`{c}`").alias(p) for p, c in zip(plain, carry, strict=True)], *rest, *where)
    return named.mapInPandas(run, schema).toDF(*carry, *columns[len(plain) :])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def magnitudes(values: pd.Series) -> pd.Series:
    """Magnitudes of the discrete Fourier transform of arrays."""
    return values.map(lambda x: np.abs(np.fft.rfft(np.asarray(x, float))))


@F.pandas_udf(T.StructType([T.StructField(n, T.LongType()) for n in ("samplerate", "nchannels", "sampwidth", "nframes")]))
def header_info(content: pd.Series) -> pd.DataFrame:
    """What a file's header says; nulls if it isn't a RIFF file."""

    def one(data: bytes) -> tuple:
        try:
            return tuple(wav_info(data)[k] for k in ("samplerate", "nchannels", "sampwidth", "nframes"))
        except (ValueError, struct.error, TypeError):
            return None, None, None, None

    return pd.DataFrame([one(c) for c in content], columns=["samplerate", "nchannels", "sampwidth", "nframes"]).astype("Int64")
