"""A collection: the four catalogue tables behind one object, in the session or in a store."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chirplake.functions.arrays import resolve_path
from chirplake.operators import aggregates, ingest, joins
from chirplake.operators.chunks import export_limits
from chirplake.operators.filters import find
from chirplake.schema import REJECTS, TABLES
from chirplake.sources import readers, writers
from chirplake.sources.statements import read_statements, statements, write_statements
from chirplake.sources.store import Store


class Collection:
    """A catalogue of recordings and annotations.

    Without a path it lives in the session, and every change gives new tables. With one it is a :class:`Store` below it: a
    change is a snapshot of its own, which the next session opens, and writes only the buckets it touches. ``rejects``
    has what the last insert or annotation left out, with reasons.
    """

    timed: dict[str, str] | None = None

    def __init__(self, spark: SparkSession, name: str, path: str | None = None, metadata: dict | None = None, overwrite: bool = False, buckets: int = 64):
        self.spark, self.name, self.path, self.metadata = spark, name, path, metadata or {}
        self.rejects = spark.createDataFrame([], REJECTS)
        self.store: Store | None = None
        self.inserted: tuple[str, int] | None = None  # the last batch of a stream that this object added
        if path and writers.exists(spark, f"{path}/info.json") and not overwrite:
            info = writers.load_json(spark, f"{path}/info.json")
            if info["name"] != name or info["type"] != self.get_type():
                raise ValueError(f"{path} holds the {info['type']} collection {info['name']}")
            self.metadata = info["metadata"]
            if Store.exists(spark, path):
                self.store = Store(spark, path)
                self.tables = self.store.tables()
            else:  # a dump: plain tables, changed in the session only
                self.tables = writers.load_tables(spark, path, TABLES)
            return
        self.tables = {n: spark.createDataFrame([], s) for n, s in TABLES.items()}
        if path:
            self.to_disk(path, overwrite, buckets)

    def get_type(self) -> str:
        return "simpleCollection"

    # storage

    def dump(self, path: str, overwrite: bool = False, form: str = "parquet") -> None:
        """A copy of the tables and the description: as Parquet, with the parsers that made them, or as ``sql`` statements."""
        if form == "sql":
            write_statements(self.tables, path, overwrite)
        else:
            writers.save_tables({**self.tables, "parsers": self.get_parsers()}, path, overwrite)
        self._describe(path)

    def as_statements(self) -> DataFrame:
        """(value) the statements that insert all rows of all tables."""
        parts = [statements(df, n) for n, df in self.tables.items()]
        return reduce(DataFrame.unionByName, parts)

    def load_statements(self, path: str) -> Collection:
        """Take over a dump of statements, a folder of ours or one file of all tables, into an empty collection."""
        if self.tables["parsed"].limit(1).count():
            raise ValueError("the collection isn't empty")
        return self._add({n: self._settled(df) for n, df in read_statements(self.spark, path, TABLES).items()})

    def transfer(self, path: str, overwrite: bool = False) -> Collection:
        """This collection as a stored one at another path."""
        other = type(self)(self.spark, self.name, metadata=self.metadata)
        other.timed, other.tables = self.timed, self.tables
        return other.to_disk(path, overwrite)

    def to_disk(self, path: str, overwrite: bool = False, buckets: int = 64) -> Collection:
        """Make a store below a path and work on that; about as many ``buckets`` as leave each some 100 MB."""
        if writers.exists(self.spark, f"{path}/info.json"):
            if not overwrite:
                raise ValueError(f"{path} holds a collection")
            writers.delete(self.spark, f"{path}/snapshots")  # a store without snapshots is empty
        store = Store(self.spark, path, buckets)
        store.append(self.tables)
        self._describe(path)
        self.path, self.store, self.tables = path, store, store.tables()
        return self

    def _describe(self, path: str) -> None:
        writers.save_json(self.spark, f"{path}/info.json", {"name": self.name, "type": self.get_type(), "metadata": self.metadata})

    def refresh(self) -> Collection:
        """See what other sessions have committed."""
        if self.store:
            self.tables = self.store.refresh().tables()
        return self

    def shred(self, paths: list[str] | None = None) -> list[str]:
        """Keep JSON paths of the metadata in typed columns, the commonest ones if none are given: filters on them reach the scan."""
        if self.store is None:
            raise ValueError("only a stored collection keeps typed columns")
        chosen = self.store.shred(paths)
        self.tables = self.store.tables()
        return chosen

    def vacuum(self) -> int:
        """Delete what earlier snapshots of a stored collection had; gives the number of versions deleted."""
        return self.store.vacuum() if self.store else 0

    def drop(self) -> None:
        if self.path:
            writers.delete(self.spark, self.path)

    def materialize(self, media_dir: str) -> Collection:
        """Copy the media files to a folder by md5, and point the catalogue at the copies."""
        placed = ingest.stored(writers.copy_media(self.tables["parsed"], media_dir).select("orid", F.col("path").alias("_new")))

        def moved(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
            p = tables["parsed"].join(placed, "orid")
            info = F.col("media_info").withField("path", F.col("_new"))
            p = p.withColumn("original_path", F.col("path")).withColumn("path", F.element_at(F.split("_new", "/"), -1)).withColumn("media_info", info)
            return {**tables, "parsed": p.select(*tables["parsed"].columns)}

        return self._change(moved)

    def doggy_bag(self, path: str, overwrite: bool = False) -> None:
        """An export bundle: media copies and metadata.csv; its columns are the metadata keys of the first recording."""
        first = self.tables["parsed"].orderBy("orid").select(F.json_object_keys("metadata").alias("k")).limit(1).collect()
        keys = [k for k in (first[0].k or [])] if first else []
        placed = writers.copy_media(self.tables["parsed"], f"{path}/media").select("orid", F.col("path").alias("_new"))
        media = self.tables["parsed"].join(placed, "orid").select(F.col("_new").alias("path"), "md5", "metadata")
        writers.export_bundle(media, path, [k for k in keys if k not in ("path", "md5", "fname")], overwrite)

    # changes

    def _settled(self, df: DataFrame) -> DataFrame:
        """``df`` with its lineage cut, so that plans don't grow with the number of changes."""
        return ingest.stored(df)

    def _add(self, rows: dict[str, DataFrame], rejects: DataFrame | None = None, batch: tuple[str, int] | None = None) -> Collection:
        """Add rows to the tables; to those of a store in one snapshot."""
        if rejects is not None:
            self.rejects = self._settled(rejects)
        if self.store:
            self.store.append({n: df.select(*TABLES[n].fieldNames()) for n, df in rows.items()}, batch)
            self.tables = self.store.tables()
        else:
            after = ingest.added(self.tables, rows)
            self.tables = {n: df if n not in rows else self._settled(df) for n, df in after.items()}
        return self

    def _change(self, change: Callable[[dict[str, DataFrame]], dict[str, DataFrame]], query: dict | None = None, where: str | None = None, orid: int | None = None, names: tuple[str, ...] = ("parsed",)) -> Collection:
        """Apply a change of tables to the recordings that a predicate selects and what is in their buckets; other buckets stay."""
        if not self.store:
            after = change(self.tables)
            self.tables = {n: df if df is self.tables.get(n) else self._settled(df) for n, df in after.items()}
            return self
        everything = query is None and where is None and orid is None
        buckets = range(self.store.snapshot["buckets"]) if everything else self.store.buckets_of("parsed", self._found(query, where, orid))
        if len(buckets):
            after = change({**self.tables, **{n: self.store.table(n, buckets) for n in ("original", "parsed", "annotations")}})
            self.store.replace({n: after[n] for n in names}, buckets)
            self.tables = self.store.tables()
        return self

    def _tops(self) -> dict[str, int]:
        return self.store.snapshot["tops"] if self.store else ingest.largest(self.tables)

    def has_batch(self, batch: tuple[str, int]) -> bool:
        """Whether a stored collection has a batch of a stream, and so all before it."""
        return self.store is not None and self.store.refresh().snapshot.get("streams", {}).get(batch[0], -1) >= batch[1]

    def insert_media(self, records: DataFrame | list[dict], media: DataFrame, parse_seq: list[dict] | None = None, batch: tuple[str, int] | None = None) -> Collection:
        """Add records (a list of metadata dicts, or the rows of a reader); ``media`` has the files' headers by path.

        A ``batch`` of a stream that a stored collection has already is left alone.
        """
        if batch and self.has_batch(batch):
            self.inserted = None
            return self
        if isinstance(records, list):
            records = readers.direct(self.spark, {"data": records})
        known = self.store.known if self.store else ingest.known_in(self.tables)
        self.inserted = batch
        return self._add(*ingest.inserted(self.tables, records, media, parse_seq, self.timed, known, self._tops()), batch)

    def pull_datastore(self, kind: str, conf: dict, media: DataFrame, parse_seq: list[dict] | None = None) -> Collection:
        return self.insert_media(readers.pull(self.spark, kind, conf), media, parse_seq)

    def annotate(self, notes: DataFrame) -> Collection:
        good, rejects = ingest.annotated(notes, self._tops()["annotations"])
        return self._add({"annotations": good}, rejects)

    def transform_metadata(self, parse_seq: list[dict], operation: str = "append", query: dict | None = None) -> Collection:
        return self._change(lambda t: ingest.transform_metadata(t, parse_seq, operation, query, self.timed), query)

    def update_field(self, field: str, value: Any, query: dict | None = None, orid: int | None = None) -> Collection:
        return self._change(lambda t: {**t, "parsed": ingest.update_field(t["parsed"], field, value, query, orid)}, query, orid=orid)

    def drop_media(self, query: dict | None = None, where: str | None = None, orid: int | None = None, cascade: bool = True) -> DataFrame:
        """Remove the media that a predicate selects, and their files where those are the collection's own; gives them back.

        A bare file name is in the collection's media folder. Files elsewhere stay.
        """
        if not query and where is None and orid is None:
            raise ValueError("removing needs a predicate")
        gone = self._settled(find(self.tables["parsed"], query, where, orid))
        names = ("original", "parsed", "annotations") if cascade else ("original", "parsed")
        self._change(lambda t: ingest.without(t, gone.select("orid"), cascade), query, where, orid, names)
        if self.store:
            self.store.forget_md5s(gone)
            self.tables = self.store.tables()
        if self.path:
            own = gone.where("instr(path, '/') = 0").select(resolve_path(F.col("path"), f"{self.path}/media").alias("path"))
            writers.delete_files(own)
        return gone

    def merge(self, other: Collection) -> Collection:
        return self._add(ingest.merged(self.tables, other.tables, self._tops()))

    # queries

    def select(self, statement: str) -> DataFrame:
        """``SELECT`` and any SQL after it; ``{parsed}``, ``{original}``, ``{annotations}``, ``{datastores}`` are the tables."""
        return self.spark.sql("SELECT " + statement, **self.tables)

    def get_parsers(self) -> DataFrame:
        """(function, kwargs) of the parsers that recordings went through, and the number of recordings."""
        steps = self.tables["parsed"].select(F.explode("parse_seq").alias("p"))
        return steps.groupBy("p.function", "p.kwargs").agg(F.count(F.lit(1)).alias("count"))

    def _found(self, query: dict | None = None, where: str | None = None, orid: int | None = None) -> DataFrame:
        """Recordings that a predicate selects; by the typed columns of a store, where it has those of a path."""
        if not self.store or not self.store.snapshot["shred"]:
            return find(self.tables["parsed"], query, where, orid)
        wide = find(self.store.table("parsed", wide=True), query, where, orid, shredded=self.store.shredded())
        return wide.select(*TABLES["parsed"].fieldNames())

    def _parsed(self, query: dict | None = None, where: str | None = None, orid: int | None = None) -> DataFrame:
        df = self._found(query, where, orid)
        return df.withColumn("path", resolve_path(F.col("path"), f"{self.path}/media")) if self.path else df

    def get_media(self, query: dict | None = None, where: str | None = None, orid: int | None = None) -> DataFrame:
        """Recordings: id, md5, path, header fields, metadata."""
        return self._parsed(query, where, orid).select("orid", "md5", "path", "media_info", "metadata")

    def get_metadata(self, query: dict | None = None, where: str | None = None, orid: int | None = None) -> DataFrame:
        return self._parsed(query, where, orid).select("orid", "metadata")

    def get_annotations(self, query: dict | None = None, noteid: int | None = None) -> DataFrame:
        """Annotations; an id overrides the query."""
        return find(self.tables["annotations"], {"id": noteid} if noteid is not None else query)

    def get_annotated_media(self, query: dict | None = None, noteid: int | None = None, media_fields: tuple[str, ...] = (), subgroup: tuple[str, ...] = ()) -> DataFrame:
        query = {"id": noteid} if noteid is not None else query
        return joins.annotated(self.tables["annotations"], self._parsed(), query, media_fields, subgroup)

    def get_signals(self, query: dict | None = None, sr: int | None = None, channel: int | None = None, mask: tuple[float, float] | None = None) -> DataFrame:
        """(orid, md5, signal) of one channel, or the mean of all; ``mask`` is a window in seconds of real time."""
        from chirplake.functions.dsp import masked, pick_channel
        from chirplake.sources.media import path_window

        @F.pandas_udf("array<double>")
        def signal(path: pd.Series, timeexp: pd.Series) -> pd.Series:
            return pd.Series([pick_channel(path_window(p, *masked(mask, t), sr)[0], channel) for p, t in zip(path, timeexp, strict=True)], dtype=object)

        return self._parsed(query).select("orid", "md5", signal("path", "media_info.timeexp").alias("signal"))

    def get_specs(self, query: dict | None = None, sr: int | None = None, channel: int | None = None, n_fft: int = 1024, hop: int = 512, mask: tuple[float, float] | None = None) -> DataFrame:
        """(orid, md5, freqs, spec): centre frequencies, and magnitudes by frequency and frame; of a window with ``mask``."""
        from chirplake.functions.arrays import frequencies
        from chirplake.functions.dsp import masked, pick_channel, spectrogram
        from chirplake.sources.media import path_window

        @F.pandas_udf("array<array<double>>")
        def spec(path: pd.Series, timeexp: pd.Series) -> pd.Series:
            signals = (pick_channel(path_window(p, *masked(mask, t), sr)[0], channel) for p, t in zip(path, timeexp, strict=True))
            return pd.Series([list(spectrogram(x, n_fft, hop)) for x in signals], dtype=object)

        rate = F.lit(sr) if sr else F.col("media_info.samplerate")
        return self._parsed(query).select("orid", "md5", frequencies(rate, n_fft).alias("freqs"), spec("path", "media_info.timeexp").alias("spec"))

    def get_zcr(self, query: dict | None = None, channel: int | None = None, frame_length: int = 2048, hop: int = 512) -> DataFrame:
        """(orid, md5, zcr): share of sign changes in each frame."""
        from chirplake.functions.dsp import pick_channel, zcr
        from chirplake.sources.media import path_window

        @F.pandas_udf("array<double>")
        def rates(path):  # noqa: ANN001, ANN202
            return path.map(lambda p: zcr(pick_channel(path_window(p)[0], channel), frame_length, hop))

        return self._parsed(query).select("orid", "md5", rates("path").alias("zcr"))

    def get_mfcc(self, query: dict | None = None, sr: int | None = None, channel: int | None = None, n_mfcc: int = 20, n_fft: int = 2048, hop: int = 512) -> DataFrame:
        """(orid, md5, mfcc): cepstral coefficients by coefficient and frame."""
        from chirplake.functions.dsp import mfcc, pick_channel
        from chirplake.sources.media import path_window

        @F.pandas_udf("array<array<double>>")
        def coefficients(path):  # noqa: ANN001, ANN202
            def one(p: str) -> list:
                x, rate = path_window(p, sr=sr)
                return list(mfcc(pick_channel(x, channel), rate, None, n_mfcc, n_fft, hop))

            return path.map(one)

        return self._parsed(query).select("orid", "md5", coefficients("path").alias("mfcc"))

    def get_annotation_matrices(self, query: dict | None = None, window: tuple[float | None, float | None] = (None, None), truncate: bool = False, channel: int | None = None, n_fft: int = 1024, hop: int = 512, masks: str = "window") -> DataFrame:
        """Spectrogram windows and masks of the annotations that a query selects."""
        from chirplake.operators.geometry import annotation_matrices

        media = self.get_annotated_media(query, media_fields=("path",))
        return annotation_matrices(media, window, truncate, channel, n_fft, hop, masks)

    def write_chunks(self, folder: str, sr: int | None = None, chop: float | None = None, threshold: float = 1.0, query: dict | None = None) -> DataFrame:
        """Export recordings, resampled and cut, as WAV files; a row for each file."""
        media = export_limits(self._parsed(query).select("orid", "md5", "path", (F.col("media_info.duration") * F.col("media_info.timeexp")).alias("duration")), chop, threshold)
        return writers.write_chunks(media, folder, sr)

    def get_size(self, query: dict | None = None) -> int:
        return self._found(query).count()

    def levels(self, field: str, query: dict | None = None) -> DataFrame:
        """Distinct values of a metadata path."""
        from chirplake.operators.filters import json_value

        return aggregates.field_levels(find(self.tables["parsed"], query), json_value("metadata", field), field)

    def iterate(self, df: DataFrame) -> Iterator[Any]:
        """Rows one by one, a partition at a time."""
        return df.toLocalIterator()


class TimedCollection(Collection):
    """A collection whose metadata carries absolute time."""

    def __init__(self, spark: SparkSession, name: str, path: str | None = None, metadata: dict | None = None, overwrite: bool = False, time_field: str = "datetime", zone_field: str = "timezone", fmt: str = "%d-%m-%Y %H:%M:%S", buckets: int = 64):
        self.timed = {"time_field": time_field, "zone_field": zone_field, "fmt": fmt}
        super().__init__(spark, name, path, metadata, overwrite, buckets)

    def get_type(self) -> str:
        return "timedCollection"

    def build_time(self) -> Collection:
        return self._change(lambda t: ingest.build_time(t, self.timed))
