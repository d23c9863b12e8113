"""Datasets: the recordings that a filter selects from a collection, cut into splits and folds."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chirplake.operators.sampling import dataset_split
from chirplake.plans.collection import Collection
from chirplake.plans.soundscape import project_metadata
from chirplake.sources import writers


@dataclass(frozen=True)
class Filtering:
    """The defaults of each part of a configuration are these, and those of the class below."""

    collectionFilter: dict | None = None
    groupingFields: tuple[str, ...] = ()
    npartitions: int = 20


@dataclass(frozen=True)
class Splitting:
    folds: int = 5
    splits: dict[str, int] = field(default_factory=lambda: {"train": 70, "test": 20, "validation": 10})


@dataclass(frozen=True)
class DatasetConfig:
    globalParams: Filtering = field(default_factory=Filtering)
    splittingParams: Splitting = field(default_factory=Splitting)

    def merged(self, changes: dict[str, dict]) -> DatasetConfig:
        """Known keys over these; an unknown one is an error."""
        out = self
        for part, values in changes.items():
            if not hasattr(out, part) or any(not hasattr(getattr(out, part), k) for k in values):
                raise ValueError(f"unknown parameters in {part}: {sorted(values)}")
            fixed = {k: tuple(v or ()) if k == "groupingFields" else v for k, v in values.items()}
            out = replace(out, **{part: replace(getattr(out, part), **fixed)})
        return out


class Dataset:
    """A fragment of a collection with a split and a fold for each recording, the same on every run.

    With a path its description is kept there, and opening it with another collection is an error.
    """

    def __init__(self, collection: Collection, name: str, path: str | None = None, config: dict[str, dict] | None = None, overwrite: bool = False):
        self.collection, self.name, self.path = collection, name, path
        self.config = DatasetConfig()
        if path and not overwrite and writers.exists(collection.spark, self._info()):
            info = writers.load_json(collection.spark, self._info())
            if info["collection"] != self._source():
                raise ValueError(f"{path}/{name} is a dataset of the collection {info['collection']['name']}")
            self.config = self.config.merged(info["config"])
        self.set_config(config or {})

    def _info(self) -> str:
        return f"{self.path}/{self.name}/info.json"

    def _source(self) -> dict:
        return {"name": self.collection.name, "type": self.collection.get_type(), "path": self.collection.path}

    def get_type(self) -> str:
        return "audioDataset"

    def set_config(self, changes: dict[str, dict]) -> Dataset:
        """Known keys over the configuration as it is; a filter that selects nothing, or shares that don't add up, are errors."""
        config = self.config.merged(changes)
        if not self.collection.get_media(config.globalParams.collectionFilter).limit(1).count():
            raise ValueError("the fragment has no recordings")
        if sum(config.splittingParams.splits.values()) != 100:
            raise ValueError("the shares must add up to 100")
        self.config = config
        if self.path:
            info = {"name": self.name, "type": self.get_type(), "collection": self._source(), "config": asdict(config)}
            writers.save_json(self.collection.spark, self._info(), info)
        return self

    def get_media(self, split: str | None = None, fold: int | None = None) -> DataFrame:
        """(orid, media_info, fileDuration, grouping fields, split, fold) of all recordings, of one split or of one fold."""
        params = self.config.globalParams
        media = project_metadata(self.collection.get_media(params.collectionFilter), list(params.groupingFields))
        parts = dataset_split(media, "orid", self.config.splittingParams.splits, self.config.splittingParams.folds)
        if split is not None:
            parts = parts.where(F.col("split") == split)
        return parts if fold is None else parts.where(F.col("fold") == fold)
