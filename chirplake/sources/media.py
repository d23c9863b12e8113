"""Media files as a data source: listed and packed on the driver, read by range on the executors, columns as they are asked for."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatch
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith

#: Format tags of RIFF files: integers, floats, and those that name one of the two further on.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
#: Bytes that a whole file is read in, to hash it.
BLOCK = 1 << 20


class RangedFile:
    """A file of any store that Arrow knows, read by range; ``read`` counts the bytes that were asked for."""

    def __init__(self, path: str):
        from pyarrow import fs

        store, place = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        self._file = store.open_input_file(place)
        self.size, self.read = self._file.size(), 0

    def at(self, start: int, n: int) -> bytes:
        start, n = max(start, 0), max(min(n, self.size - start), 0)
        self.read += n
        return self._file.read_at(n, start) if n else b""

    def __enter__(self) -> RangedFile:
        return self

    def __exit__(self, *_: Any) -> None:
        self._file.close()


class BytesFile:
    """Bytes in memory, read like a :class:`RangedFile`."""

    def __init__(self, content: bytes):
        self.content, self.size, self.read = content, len(content), 0

    def at(self, start: int, n: int) -> bytes:
        out = self.content[max(start, 0) : max(start, 0) + max(n, 0)]
        self.read += len(out)
        return out

    def __enter__(self) -> BytesFile:
        return self

    def __exit__(self, *_: Any) -> None:
        pass


@dataclass(frozen=True)
class Header:
    """What the chunks before the data say, and where the data are."""

    samplerate: int
    nchannels: int
    sampwidth: int
    nframes: int
    data: int
    floats: bool = False

    @property
    def frame(self) -> int:
        return max(self.nchannels * self.sampwidth, 1)


def header(file: RangedFile | BytesFile) -> Header:
    """The header of a RIFF file, chunk by chunk, without what the chunks hold; an error if it isn't one."""
    head = file.at(0, 12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("no RIFF header")
    at, form = 12, None
    while at + 8 <= file.size:
        name, size = struct.unpack("<4sI", file.at(at, 8))
        if name == b"fmt ":
            form = file.at(at + 8, min(size, 40))
        elif name == b"data" and form is not None:
            if len(form) < 16:
                raise ValueError("the format is cut off")
            tag, channels, rate, _, _, bits = struct.unpack("<HHIIHH", form[:16])
            if tag == EXTENSIBLE and len(form) >= 26:
                tag = struct.unpack("<H", form[24:26])[0]
            width = bits // 8
            n = min(size, file.size - at - 8)  # a recorder that was stopped leaves a size that isn't there
            return Header(rate, channels, width, n // max(channels * width, 1), at + 8, tag == FLOAT)
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def samples(file: RangedFile | BytesFile, head: Header, first: int, n: int) -> np.ndarray:
    """(channels x frames from -1 to 1) of ``n`` frames from ``first``, of which only the bytes are read."""
    first = min(max(first, 0), head.nframes)
    n = min(max(n, 0), head.nframes - first)
    data = file.at(head.data + first * head.frame, n * head.frame)
    width = head.sampwidth
    if head.floats:
        x = np.frombuffer(data, f"<f{width}").astype(np.float64)
    elif width == 1:
        x = np.frombuffer(data, np.uint8).astype(np.float64) / 128 - 1
    elif width == 3:
        raw = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((raw[:, 0] << 8 | raw[:, 1] << 16 | raw[:, 2] << 24) >> 8).astype(np.float64) / 2**23
    else:
        x = np.frombuffer(data, f"<i{width}").astype(np.float64) / 2.0 ** (8 * width - 1)
    return x.reshape(-1, head.nchannels).T


def window(file: RangedFile | BytesFile, offset: float = 0.0, duration: float | None = None, sr: int | None = None) -> tuple[np.ndarray, int]:
    """(signal, sample rate) of a window in seconds, resampled if ``sr`` is given; no other frames are read."""
    from chirplake.functions.dsp import resample

    head = header(file)
    first = min(max(int(round(offset * head.samplerate)), 0), head.nframes)
    n = head.nframes - first if duration is None else max(int(round(duration * head.samplerate)), 0)
    x = samples(file, head, first, n)
    return (resample(x, head.samplerate, sr), sr) if sr and sr != head.samplerate else (x, head.samplerate)


def path_window(path: str, offset: float = 0.0, duration: float | None = None, sr: int | None = None) -> tuple[np.ndarray, int]:
    with RangedFile(path) as file:
        return window(file, offset, duration, sr)


def padded(read: Callable[[int, int], np.ndarray], n: int, start: int, stop: int, pad: int) -> np.ndarray:
    """Places start to stop of a signal of ``n`` samples that is padded by ``pad`` on both sides, by reflection if it is longer than
    that, else by zeros. ``read(first, count)`` gives samples; only those that the places need are asked for."""
    places = np.arange(start, stop)
    inside = (places >= 0) & (places < n)
    if n > pad:
        places = np.abs(places)
        places = np.where(places >= n, 2 * (n - 1) - places, places)
        inside[:] = True
    out = np.zeros(len(places))
    if inside.any():
        low, high = int(places[inside].min()), int(places[inside].max())
        out[inside] = read(low, high - low + 1)[places[inside] - low]
    return out


# the data source

COLUMNS = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("filesize", T.LongType()),
        T.StructField("head", T.BinaryType()),
        T.StructField("samplerate", T.LongType()),
        T.StructField("nchannels", T.LongType()),
        T.StructField("sampwidth", T.LongType()),
        T.StructField("nframes", T.LongType()),
        T.StructField("md5", T.StringType()),
        T.StructField("content", T.BinaryType()),
        T.StructField("bytes_read", T.LongType()),
    ]
)
HEADER_FIELDS = ("samplerate", "nchannels", "sampwidth", "nframes")


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]]


def listed(path: str, pattern: str, recursive: bool) -> list[tuple[str, int]]:
    """(path, size) of the files of a folder, or of one file; several folders are separated by commas."""
    from pyarrow import fs

    out = []
    for one in path.split(","):
        uri = one if "://" in one or one.startswith("file:") else f"file://{one}"
        store, place = fs.FileSystem.from_uri(uri)
        scheme = uri[: len(uri) - len(place)] if uri.endswith(place) else "file://"
        info = store.get_file_info(place)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(place, recursive=recursive))
        globs = pattern.split(",")
        out += [(scheme + i.path, i.size) for i in found if i.type == fs.FileType.File and any(fnmatch(i.base_name, g) for g in globs)]
    return sorted(out)


def packs(files: list[tuple[str, int]], cost: Callable[[int], int], most: int) -> list[list[tuple[str, int]]]:
    """Files in order, cut into packs where their costs come to ``most``."""
    out: list[list[tuple[str, int]]] = []
    total = most
    for file in files:
        if total >= most:
            out.append([])
            total = 0
        out[-1].append(file)
        total += cost(file[1])
    return out


def admits(wanted: Filter, path: str, size: int) -> bool | None:
    """Whether a filter admits a file by what the listing says of it; none if it asks for something else."""
    known = {("path",): path, ("filesize",): size}
    if wanted.attribute not in known:
        return None
    have = known[wanted.attribute]
    tests: dict[type, Callable[[Any], bool]] = {
        EqualTo: lambda v: have == v, GreaterThan: lambda v: have > v, GreaterThanOrEqual: lambda v: have >= v, LessThan: lambda v: have < v,
        LessThanOrEqual: lambda v: have <= v, In: lambda v: have in v, StringStartsWith: lambda v: have.startswith(v), StringEndsWith: lambda v: have.endswith(v),
    }
    test = tests.get(type(wanted))
    return None if test is None else test(wanted.value)


class MediaReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.names = schema.fieldNames()
        if unknown := set(self.names) - set(COLUMNS.fieldNames()):
            raise ValueError(f"media files have no {sorted(unknown)}")
        self.path, self.pattern = options["path"], options.get("pathGlobFilter", "*.wav,*.WAV")
        self.recursive = options.get("recursiveFileLookup", "true").lower() == "true"
        self.head, self.most = int(options.get("headBytes", 200)), int(options.get("partitionBytes", 128 << 20))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if hasattr(f, "attribute") and admits(f, "", 0) is not None:
                self.filters.append(f)
            else:
                yield f

    def cost(self, size: int) -> int:
        """Bytes that a file costs: what is read of it, and as much as opening it takes."""
        whole = {"md5", "content"} & set(self.names)
        return (64 << 10) + (size if whole else self.head)

    def partitions(self) -> list[InputPartition]:
        files = [(p, s) for p, s in listed(self.path, self.pattern, self.recursive) if all(admits(f, p, s) for f in self.filters)]
        return [Files(pack) for pack in packs(files, self.cost, self.most)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path, size in partition.files:
            yield self.row(path, size)

    def row(self, path: str, size: int) -> tuple:
        """The columns asked for; what none of them needs isn't read, and a file isn't opened for its name and size."""
        have: dict[str, Any] = {"path": path, "filesize": size, "bytes_read": 0}
        if set(self.names) - set(have):
            with RangedFile(path) as file:
                if "head" in self.names:
                    have["head"] = file.at(0, self.head)
                if set(HEADER_FIELDS) & set(self.names):
                    try:
                        found = header(file)
                        have |= {k: getattr(found, k) for k in HEADER_FIELDS}
                    except (ValueError, struct.error):
                        have |= dict.fromkeys(HEADER_FIELDS)
                if "content" in self.names:
                    have["content"] = file.at(0, file.size)
                if "md5" in self.names:
                    digest = hashlib.md5(have.get("content", b""), usedforsecurity=False)
                    if "content" not in have:
                        for at in range(0, file.size, BLOCK):
                            digest.update(file.at(at, BLOCK))
                    have["md5"] = digest.hexdigest()
                have["bytes_read"] = file.read
        return tuple(have[n] for n in self.names)


class MediaSource(DataSource):
    """``spark.read.format("media").schema("path string, samplerate long").load(folder)``.

    Columns: path, filesize, head (the first ``headBytes``), samplerate, nchannels, sampwidth, nframes, md5, content,
    bytes_read. The schema names those that are wanted; only their bytes are read: none for path and filesize, some for the
    header, all for md5 and content. Filters on path and filesize leave files out of the plan. Files are packed into tasks
    by the bytes that are read of them (``partitionBytes``).
    """

    @classmethod
    def name(cls) -> str:
        return "media"

    def schema(self) -> T.StructType:
        return COLUMNS

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return MediaReader(schema, self.options)


def media_files(spark: SparkSession, path: str, columns: list[str], **options: Any) -> DataFrame:
    """Columns of the media files of a folder; see :class:`MediaSource`."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MediaSource)
    fields = T.StructType([COLUMNS[c] for c in columns])
    reader = spark.read.format("media").schema(fields)
    for key, value in options.items():
        reader = reader.option(key, str(value))
    return reader.load(path)
