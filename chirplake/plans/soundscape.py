"""Soundscapes: configuration, the graph of named DataFrames, samples, matrices and retrieval by percentile."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chirplake.functions.arrays import level_range
from chirplake.functions.timefns import TIME_FORMAT, in_range, start_seconds, time_cell
from chirplake.operators import aggregates
from chirplake.operators.chunks import split_time
from chirplake.operators.filters import in_group, json_value
from chirplake.operators.mixed import MixedModel, fit_mixed
from chirplake.operators.sampling import stratified_sample
from chirplake.sources import writers


@dataclass(frozen=True)
class EnergyParams:
    """The defaults of each part of a configuration are these, and those of the classes below."""

    channels: str | list[int] | None = "__all__"
    n_fft: int = 1024
    hop_length: int = 512
    tStep: float = 60
    fBins: int = 10
    fLimits: tuple[float, float] = (0, 10000)
    readSr: int | None = None
    aggr: dict | str = "sum"
    signal: dict | str | None = None
    spec: dict | str | None = None
    full_spec: dict | None = None

    def columns(self) -> list[str]:
        return list(self.full_spec["out_names"]) if self.full_spec else [f"e_{i}" for i in range(self.fBins)]


@dataclass(frozen=True)
class SamplingParams:
    size: int = -1
    replace: bool = False


@dataclass(frozen=True)
class CronoParams:
    startDate: str | None = None
    timeZone: str | None = None
    timeFormat: str = TIME_FORMAT
    unit: float = 3600
    modulo: int = 24
    cell_from: str = "file"


@dataclass(frozen=True)
class GlobalParams:
    npartitions: int = 20
    collectionFilter: dict | None = None
    groupFields: tuple[str, ...] = ()


@dataclass(frozen=True)
class Config:
    globalParams: GlobalParams = field(default_factory=GlobalParams)
    energyParams: EnergyParams = field(default_factory=EnergyParams)
    samplingParams: SamplingParams = field(default_factory=SamplingParams)
    cronoParams: CronoParams | None = None

    def merged(self, changes: dict[str, dict]) -> Config:
        """Known keys over these; an unknown one is an error."""
        out = self
        for part, values in changes.items():
            if part == "cronoParams" and out.cronoParams is None:
                out = replace(out, cronoParams=CronoParams())
            if not hasattr(out, part) or any(not hasattr(getattr(out, part), k) for k in values):
                raise ValueError(f"unknown parameters in {part}: {sorted(values)}")
            fixed = {k: tuple(v) if k in ("fLimits", "groupFields") else v for k, v in values.items()}
            out = replace(out, **{part: replace(getattr(out, part), **fixed)})
        return out

    def fingerprint(self) -> str:
        return hashlib.md5(json.dumps(asdict(self), sort_keys=True, default=str).encode()).hexdigest()[:12]


def project_metadata(df: DataFrame, fields: list[str], kinds: dict[str, str] | None = None) -> DataFrame:
    """(orid, media_info, fileDuration, fields): metadata paths as columns of their dotted names.

    A field named like one of the first three is left to them. A missing path is null.
    """
    kinds = kinds or {}
    base = [F.col("orid"), F.col("media_info"), F.col("media_info.duration").alias("fileDuration")]
    extra = [json_value("metadata", f, kinds.get(f, "string")).alias(f) for f in fields if f not in ("orid", "media_info", "fileDuration")]
    return df.select(*base, *extra)


def infer_types(df: DataFrame, fields: list[str], sample: int = 10) -> dict[str, str]:
    """Types of metadata paths, from the first rows in order of id."""
    from chirplake.operators.filters import json_path
    from chirplake.functions.arrays import split_path

    first = df.orderBy("orid").limit(sample).select(F.try_parse_json("metadata").alias("v"))
    kinds = first.agg(*[F.schema_of_variant_agg(F.try_variant_get("v", json_path(split_path(f)), "variant")).alias(f"t{i}") for i, f in enumerate(fields)]).first()
    return {f: (kinds[i] or "VOID").lower().replace("void", "string") for i, f in enumerate(fields)}


class Soundscape:
    """Named lazy DataFrames over a fragment of recordings.

    Nodes: fragment, splits, counts, sample; and, with cronoParams, calendarized. Catalyst is the optimizer of the graph.
    Nodes that are kept go to ``path`` under the fingerprint of the configuration, so a changed one is never read.
    """

    def __init__(self, name: str, fragment: DataFrame, config: dict[str, dict] | None = None, path: str | None = None, splitter: Callable[[DataFrame, Config], DataFrame] | None = None):
        self.name, self.path = name, path
        self.config = Config().merged(config or {})
        if not fragment.limit(1).count():
            raise ValueError("the fragment has no recordings")
        self.nodes: dict[str, Callable[[], DataFrame]] = {}
        self.splitter = splitter or native_splits
        self.set_node("fragment", lambda: fragment)
        self._connect()

    def _connect(self) -> None:
        """The nodes that follow from the configuration."""
        self.set_node("splits", lambda f: self.splitter(f, self.config), "fragment")
        base = "splits"
        if self.config.cronoParams:
            self.set_node("calendarized", lambda s: calendarize(s, self.config.cronoParams), "splits")
            base = "calendarized"
        keys = ["timeCell", *self.config.globalParams.groupFields]
        self.set_node("counts", lambda s: aggregates.crono_counts(s) if "timeCell" in s.columns else aggregates.count(s), base)
        p = self.config.samplingParams
        self.set_node("sample", lambda s: stratified_sample(s, keys, p.size, p.replace, "chunkId"), base)

    def set_config(self, changes: dict[str, dict]) -> Soundscape:
        """Known keys over the configuration as it is; nodes that were added stay, and kept ones are read no more."""
        self.config = self.config.merged(changes)
        self._connect()
        return self

    def set_node(self, name: str, function: Callable[..., DataFrame], *inputs: str) -> None:
        """Add a node: a function of other nodes."""
        self.nodes[name] = lambda: function(*[self.get_node(i) for i in inputs])

    def get_node(self, name: str, group: dict[str, Any] | None = None, keep: bool = False, overwrite: bool = False) -> DataFrame:
        """A node, or one group of it; ``keep`` writes it for later, and reads it if it is there."""
        if name not in self.nodes:
            raise ValueError(f"no node {name}")
        place = f"{self.path}/{self.name}/persist/{self.config.fingerprint()}/{name}.parquet" if self.path else None
        spark = self._spark()
        if place and not overwrite and name != "fragment" and writers.exists(spark, place):
            return in_group(spark.read.parquet(place), group)
        df = self.nodes[name]()
        if keep:
            if not place:
                raise ValueError("a soundscape without a path keeps no nodes")
            writers.write_node(df, place, overwrite)
            df = spark.read.parquet(place)
        return in_group(df, group)

    def _spark(self):
        return self.nodes["fragment"]().sparkSession

    def get_splits(self, group: dict | None = None, **options: Any) -> DataFrame:
        return self.get_node("calendarized" if "calendarized" in self.nodes else "splits", group, **options)

    def get_counts(self, **options: Any) -> DataFrame:
        return self.get_node("counts", **options)

    def get_sample(self, group: dict | None = None, **options: Any) -> DataFrame:
        return self.get_node("sample", group, **options)

    def get_groups(self) -> DataFrame:
        return aggregates.group_counts(self.get_node("fragment"), list(self.config.globalParams.groupFields))

    def group_exists(self, group: dict[str, Any]) -> bool:
        """Whether a group has recordings; fields that aren't group fields are an error."""
        if unknown := set(group) - set(self.config.globalParams.groupFields):
            raise ValueError(f"no group fields {sorted(unknown)}")
        return bool(in_group(self.get_node("fragment"), group).limit(1).count())

    def clear(self) -> None:
        if self.path:
            writers.delete(self._spark(), f"{self.path}/{self.name}")

    def matrix(self, group: dict | None = None, stat: str = "mean", names: list[str] | None = None, time_limits: tuple[str, str] | None = None, freq_limits: tuple[float, float] | None = None) -> DataFrame:
        """(timeCell, level, value, norm): what a plot of the soundscape shows; ``freq_limits`` must span two levels."""
        c = self.config.cronoParams
        if freq_limits:
            names = self._levels(freq_limits)
            if len(names) < 2:
                raise ValueError(f"no range of levels in {freq_limits}")
        df = self._limited(self.get_splits(group), time_limits, None)
        return aggregates.crono_matrix(df, names or self.config.energyParams.columns(), 0, c.modulo - 1, stat=stat)

    def mixed_model(self, response: str, fixed: list[str], group: str, slope: bool = False, family: str = "gaussian", of: dict | None = None) -> MixedModel:
        """A mixed model of the splits: ``response`` by fixed effects and a random intercept (and slope) of each ``group``."""
        return fit_mixed(self.get_splits(of), response, fixed, group, slope, family)

    def _levels(self, freq_limits: tuple[float, float]) -> list[str]:
        energy = self.config.energyParams
        low, high = level_range(freq_limits, *energy.fLimits, energy.fBins)
        return energy.columns()[low : high + 1]

    def by_percentile(self, percentiles: tuple[float, float], group: dict | None = None, cells: list[int] | None = None, time_limits: tuple[str, str] | None = None, freq_limits: tuple[float, float] | None = None, names: list[str] | None = None, top: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
        """The rows whose energies lie most often between two percentiles, at most ``top``, with their score.

        With ``by`` the percentiles are those of a row's own group, and each group has its ``top``.
        """
        names = self._levels(freq_limits) if freq_limits else names or self.config.energyParams.columns()
        df = self._limited(self.get_splits(group), time_limits, cells)
        return aggregates.top_scores(aggregates.percentile_scores(df, names, percentiles, by), top, ["orid", "chunkId", "channel"], by)

    def _limited(self, df: DataFrame, time_limits: tuple[str, str] | None, cells: list[int] | None) -> DataFrame:
        c = self.config.cronoParams
        if cells is not None:
            df = df.where(F.col("timeCell").isin(*cells))
        if time_limits:
            df = df.where(in_range(F.col("absStart"), time_limits, c.timeZone, c.timeFormat))
        return df


def native_splits(fragment: DataFrame, config: Config) -> DataFrame:
    """Splits of recordings that carry energies already: chunks in time only."""
    return split_time(fragment, config.energyParams.tStep)


def audio_splits(fragment: DataFrame, config: Config) -> DataFrame:
    """Splits with energies of recordings: of their files, by ``path`` or ``media_info.path``, or of their bytes in ``content``.

    Files are dealt to tasks by size and read by range, long ones in pieces; at least ``npartitions`` tasks. Bytes that are
    there already stay where they are.
    """
    from chirplake.functions.dsp import energies, pieces

    carry = [c for c in fragment.columns if c not in ("content", "media_info", "timeexp", "filesize")]
    if "content" not in fragment.columns:
        info = {"path": "string", "timeexp": "double", "filesize": "long"}
        have = fragment.schema["media_info"].dataType.fieldNames() if "media_info" in fragment.columns else []
        missing = {c: F.col(f"media_info.{c}") if c in have else F.lit(None).cast(kind) for c, kind in info.items() if c not in fragment.columns}
        fragment = pieces(fragment.withColumns(missing).drop("media_info"), config.energyParams, config.globalParams.npartitions)
    return energies(fragment, config.energyParams, carry)


def calendarize(splits: DataFrame, crono: CronoParams) -> DataFrame:
    """``splits`` with timeCell: from the file's start, so that the chunks of a file share a cell, or from the chunk's."""
    if not crono.startDate or not crono.timeZone:
        raise ValueError("cronoParams need startDate and timeZone")
    start = start_seconds(crono.startDate, crono.timeZone, crono.timeFormat)
    at: Column = F.col("chunkAbsStart" if crono.cell_from == "chunk" else "absStart")
    return splits.withColumn("timeCell", time_cell(at, start, crono.unit, crono.modulo))


def mixed_model_formula(response: str, fixed: list[str], intercepts: list[str] = (), slopes: list[tuple[str, str]] = ()) -> str:
    """Formula of a mixed model: ``y ~ f1+f2+(1|g)+(1+f1|h)``; :func:`fit_mixed` fits those of one grouping factor."""
    return f"{response} ~ " + "+".join([*fixed, *[f"(1|{g})" for g in intercepts], *[f"(1+{f}|{g})" for f, g in slopes]])
