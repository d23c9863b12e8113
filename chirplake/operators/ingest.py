"""Changes of the catalogue as transforms of immutable tables: insert, annotate, update, transform, remove, merge."""

from __future__ import annotations

import json
import tempfile
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chirplake.functions.timefns import TIME_FORMAT, span_fields, standardize_time
from chirplake.operators.filters import find, json_value
from chirplake.schema import GEOMETRIES, NOTE_TYPES, TABLES

#: Datastores that go to each task, and the share of rows from which one does if there are more.
FEW, SHARE = 100_000, 1e-3
#: Named parsers: metadata dict and keyword arguments to metadata dict.
PARSERS: dict[str, Callable[..., dict]] = {}


def register_parser(name: str, function: Callable[..., dict]) -> None:
    PARSERS[name] = function


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which all executors share; where none is set on a local master (tests), a temporary one.

    On a cluster a folder of one machine would lose rows, so there it is an error.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="chirplake-"))
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as it was worked out once, in the checkpoint folder: what is read twice is the same rows in the same partitions."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def dense_ids(df: DataFrame, name: str, order: list[Column | str], after: int = 0) -> DataFrame:
    """Ids after, after + 1, ... in an order, without gaps.

    Rows are range-sorted and stored; each partition has numbered its own rows, and the sizes of the partitions before it
    are added. So no partition holds all rows. The order must have no ties if ids are to be the same on each run.
    """
    columns = df.columns
    placed = df.select(F.struct(*columns).alias("row"), F.struct(*order).alias("k")).withColumn("h", F.col("k")).repartitionByRange("k").sortWithinPartitions("k")
    placed = stored(placed.select("row", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m")))
    sizes = placed.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    bases = sizes.select("p", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("base"))
    number = F.col("base") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1)) + F.lit(after + 1)
    return placed.join(F.broadcast(bases), "p").select(number.alias(name), "row.*")


def run_parsers(metadata: Column, parse_seq: list[dict[str, Any]]) -> Column:
    """JSON text through a chain of named parsers, once each; Python runs once for the whole chain."""
    if not parse_seq:
        return metadata
    chain = [(PARSERS[p["function"]], p.get("kwargs") or {}) for p in parse_seq]

    @F.pandas_udf(T.StringType())
    def parse(texts):  # noqa: ANN001, ANN202
        def one(text: str | None) -> str | None:
            if text is None:
                return None
            value = json.loads(text)
            for function, kwargs in chain:
                value = function(value, **kwargs)
            return json.dumps(value)

        return texts.map(one, na_action="ignore")

    return parse(metadata)


def parser_rows(parse_seq: list[dict[str, Any]]) -> Column:
    kind = TABLES["parsed"]["parse_seq"].dataType
    if not parse_seq:
        return F.array().cast(kind)
    fields = ("path", "function", "kwargs", "original_path", "creation")
    value = lambda p, k: json.dumps(p.get(k) or {}) if k == "kwargs" else p.get(k)
    return F.array(*[F.struct(*[F.lit(value(p, k)).cast("string").alias(k) for k in fields]) for p in parse_seq])


def with_time(df: DataFrame, duration: Column, time_field: str = "datetime", zone_field: str = "timezone", fmt: str = TIME_FORMAT, where: Column | None = None) -> DataFrame:
    """``df`` with standardStart, standardStop, absStart and absStop in its metadata; unchanged where time can't be read, or
    ``where`` doesn't hold. Each step is a column of its own, so that the text is read once for all that follows from it."""
    named = df.withColumn("_text", json_value("metadata", time_field)).withColumn("_zone", json_value("metadata", zone_field))
    started = named.withColumn("_start", standardize_time(F.col("_text"), F.col("_zone"), fmt))
    fields = span_fields(F.col("_start"), F.col("_zone"), duration)
    added = F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))
    empty = F.regexp_like("metadata", F.lit(r"^\s*\{\s*\}\s*$"))
    merged = F.concat(F.regexp_replace("metadata", r"\s*\}\s*$", ""), F.when(empty, "").otherwise(","), F.substring(added, 2, 1 << 30))
    holds = F.col("_start").isNotNull() if where is None else F.col("_start").isNotNull() & where
    return started.withColumn("metadata", F.when(holds, merged).otherwise(F.col("metadata"))).select(*df.columns)


def screen(records: DataFrame, media: DataFrame, known: Callable[[DataFrame], DataFrame], parse_seq: list[dict[str, Any]] | None = None) -> DataFrame:
    """Records after the parsers, with the header of their file and the reason why they can't be taken; null where they can.

    Metadata must have a path and a timeexp, the file a readable header, and an md5 must be new: not ``known``, nor that of
    a record before it. Records of one md5 are ranked inside each map task first, and only the first of each is ranked with
    those of other tasks, so an md5 that half of the records have makes no hot task. ``known`` gives those of a table of
    md5s, one row each, that are stored.
    """
    parsed = records.select("datastore", "source", F.col("metadata").alias("raw"), run_parsers(F.col("metadata"), parse_seq or []).alias("metadata"))
    parsed = parsed.withColumn("path", json_value("metadata", "path")).withColumn("timeexp", json_value("metadata", "timeexp", "double"))
    m = media.select(F.col("path").alias("_path"), F.col("md5").alias("_md5"), "filesize", "samplerate", "sampwidth", "nchannels", "nframes")
    parsed = parsed.join(m, F.col("path") == F.col("_path"), "left").withColumn("md5", F.coalesce(json_value("metadata", "md5"), "_md5"))
    reason = (
        F.when(F.col("path").isNull(), "no path").when(F.col("timeexp").isNull(), "no timeexp").when(F.col("samplerate").isNull(), "file can't be read").when(F.col("md5").isNull(), "no md5")
    )
    order = F.struct("datastore.hash", "source.fkey", "raw")
    aside = F.when(F.col("reason").isNotNull(), F.xxhash64("raw"))  # what is rejected anyway needs no common place
    ranked = parsed.withColumn("reason", reason).withColumn("_task", F.spark_partition_id())
    ranked = ranked.withColumn("_rank", F.row_number().over(Window.partitionBy("md5", "_task", aside).orderBy(order)))
    apart = F.when(aside.isNotNull() | (F.col("_rank") > 1), F.xxhash64("_task", "raw"))
    ranked = ranked.withColumn("_all", F.row_number().over(Window.partitionBy("md5", apart).orderBy(order)))
    first = F.col("reason").isNull() & (F.col("_rank") == 1) & (F.col("_all") == 1)
    ranked = ranked.withColumn("_key", F.when(first, F.col("md5")))  # the others meet nothing
    there = known(ranked.where("_key IS NOT NULL").select("md5")).select(F.col("md5").alias("_key"), F.lit(True).alias("there"))
    ranked = ranked.join(there, "_key", "left")
    reason = F.coalesce("reason", F.when(F.col("there") | ~first, "md5 is there already"))
    return ranked.withColumn("reason", reason).drop("there", "_rank", "_all", "_task", "_key")


def rejected(screened: DataFrame) -> DataFrame:
    """(record, reason) of what an insert leaves out."""
    return screened.where("reason IS NOT NULL").select(F.col("raw").alias("record"), "reason")


def known_in(tables: dict[str, DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Which md5s a catalogue has, by a semi join."""
    return lambda wanted: wanted.join(tables["parsed"].select("md5"), "md5", "left_semi")


def with_store(rows: DataFrame, stores: DataFrame, key: str, how: str = "inner", few: int = FEW) -> DataFrame:
    """``rows`` with the columns of their datastore, by a key that ``stores`` has once.

    A datastore may have all of the rows, so they don't meet by a hash of it, which would be one task: up to ``few``
    datastores go to each task. Of more than that, those that have a ``SHARE`` of the rows or more do, and the rest meet by hash.
    """
    if stores.count() <= few:
        return rows.join(F.broadcast(stores), key, how)
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hot = stored(counts.crossJoin(F.broadcast(counts.agg(F.sum("_n").alias("_of")))).where(F.col("_n") >= F.col("_of") * SHARE).select(key))
    kept = lambda df, kind: df.join(F.broadcast(hot), key, kind)
    common = kept(rows, "left_semi").join(F.broadcast(kept(stores, "left_semi")), key, how)
    return common.unionByName(kept(rows, "left_anti").join(kept(stores, "left_anti"), key, how))


def largest(tables: dict[str, DataFrame]) -> dict[str, int]:
    """The largest ids of a catalogue."""
    return {name: tables[name].agg(F.max("id")).first()[0] or 0 for name in ("datastores", "original", "annotations")}


def inserted(
    tables: dict[str, DataFrame],
    records: DataFrame,
    media: DataFrame,
    parse_seq: list[dict[str, Any]] | None = None,
    timed: dict[str, str] | None = None,
    known: Callable[[DataFrame], DataFrame] | None = None,
    tops: dict[str, int] | None = None,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """(rows that an insert adds to each table, rejected records with a reason); see :func:`screen`.

    ``records`` are (datastore, source, metadata); ``media`` has a row of header fields for each path. Nothing of a
    rejected record stays. What was screened is stored, so it is worked out once.
    """
    parse_seq = parse_seq or []
    tops = tops or largest(tables)
    have = tables["datastores"]
    new_stores = records.select("datastore.*").distinct().join(have.select("hash"), "hash", "left_anti")
    new_stores = dense_ids(new_stores.select("hash", "type", "conf", "metadata"), "id", ["hash"], tops["datastores"])
    stores = have.unionByName(new_stores)

    screened = stored(screen(records, media, known or known_in(tables), parse_seq))
    good = dense_ids(screened.where("reason IS NULL").drop("reason"), "orid", ["datastore.hash", "source.fkey", "raw", "md5"], tops["original"])
    good = with_store(good.withColumn("_hash", F.col("datastore.hash")), stores.select(F.col("id").alias("source_id"), F.col("hash").alias("_hash")), "_hash")

    duration = F.col("nframes") / F.col("samplerate") / F.col("timeexp")
    info = F.struct(
        F.col("path"), F.col("filesize").cast("long").alias("filesize"), F.col("timeexp"), F.col("samplerate").cast("int").alias("samplerate"), F.col("sampwidth").cast("int").alias("sampwidth"),
        F.col("nframes").cast("long").alias("length"), F.col("nchannels").cast("int").alias("nchannels"), duration.alias("duration"), F.col("md5"),
    )
    new_original = good.select(F.col("orid").alias("id"), F.to_json(F.struct("source.fkey", "source_id")).alias("source"), F.col("raw").alias("metadata"))
    good = with_time(good, duration, **timed) if timed is not None else good
    new_parsed = good.select("orid", "md5", "path", F.col("path").alias("original_path"), parser_rows(parse_seq).alias("parse_seq"), info.alias("media_info"), "metadata")
    return {"datastores": new_stores.select(*have.columns), "original": new_original, "parsed": new_parsed}, rejected(screened)


def added(tables: dict[str, DataFrame], rows: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """A catalogue with more rows."""
    return {n: df.unionByName(rows[n].select(*df.columns)) if n in rows else df for n, df in tables.items()}


def insert(tables: dict[str, DataFrame], records: DataFrame, media: DataFrame, parse_seq: list[dict[str, Any]] | None = None, timed: dict[str, str] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables after an insert, rejected records with a reason); see :func:`inserted`."""
    rows, rejects = inserted(tables, records, media, parse_seq, timed)
    return added(tables, rows), rejects


def annotated(notes: DataFrame, top: int) -> tuple[DataFrame, DataFrame]:
    """(annotations with ids after ``top``, rejected ones with a reason).

    A known type is needed, and its times, label, groups and metadata; a geometry needs both frequencies and its text.
    """
    kinds = TABLES["annotations"]
    have = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in notes.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in kinds if f.name != "id"]
    rows = notes.select(*have)
    missing = lambda names: reduce(lambda a, b: a | b, [F.col(n).isNull() for n in names])
    reason = (
        F.when(F.col("notetype").isNull() | ~F.col("notetype").isin(*NOTE_TYPES), "unknown notetype")
        .when(missing(["start_time", "end_time", "duration"]), "no time limits")
        .when(missing(["label", "groups", "metadata"]), "no label, groups or metadata")
        .when(F.col("notetype").isin(*GEOMETRIES) & missing(["max_freq", "min_freq", "wkt"]), "no frequency limits or wkt")
    )
    rows = rows.withColumn("reason", reason)
    rejects = rows.where("reason IS NOT NULL").select(F.to_json(F.struct(*[f.name for f in kinds if f.name != "id"])).alias("record"), "reason")
    good = dense_ids(rows.where("reason IS NULL").drop("reason"), "id", ["orid", "start_time", "end_time", "notetype", "label", F.xxhash64("groups", "metadata", "verts", "wkt")], top)
    return good.select(*kinds.fieldNames()), rejects


def annotate(tables: dict[str, DataFrame], notes: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables with the annotations, rejected ones with a reason); see :func:`annotated`."""
    good, rejects = annotated(notes, tables["annotations"].agg(F.max("id")).first()[0] or 0)
    return added(tables, {"annotations": good}), rejects


def update_field(df: DataFrame, field: str, value: Any, query: dict | None = None, orid: int | None = None, id_column: str = "orid", **options: Any) -> DataFrame:
    """``df`` with a new value of a field where everything given holds; all rows if nothing is given."""
    from chirplake.operators.filters import Compiler

    condition = Compiler(df.schema, **options).compile(query)
    if orid is not None:
        one = F.col(id_column) == orid
        condition = one if condition is None else condition & one
    new = value if isinstance(value, Column) else F.lit(value)
    new = new.cast(df.schema[field].dataType)
    return df.withColumn(field, new if condition is None else F.when(condition, new).otherwise(F.col(field)))


def transform_metadata(tables: dict[str, DataFrame], parse_seq: list[dict[str, Any]], operation: str = "append", query: dict | None = None, timed: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Run parsers over stored metadata (append) or over the original metadata (overwrite), and record them."""
    if operation not in ("append", "overwrite"):
        raise ValueError("operation must be append or overwrite")
    parsed = tables["parsed"]
    chosen = find(parsed, query)
    rest = parsed.join(chosen.select("orid"), "orid", "left_anti") if query else parsed.limit(0)
    if operation == "overwrite":
        raw = tables["original"].select(F.col("id").alias("orid"), F.col("metadata").alias("_raw"))
        chosen = chosen.join(raw, "orid")
        metadata, sequence = run_parsers(F.col("_raw"), parse_seq), parser_rows(parse_seq)
    else:
        metadata, sequence = run_parsers(F.col("metadata"), parse_seq), F.concat("parse_seq", parser_rows(parse_seq))
    changed = chosen.withColumn("metadata", metadata).withColumn("parse_seq", sequence).select(*parsed.columns)
    if timed is not None and operation == "overwrite":
        changed = with_time(changed, F.col("media_info.duration"), **timed)
    return {**tables, "parsed": rest.select(*parsed.columns).unionByName(changed)}


def build_time(tables: dict[str, DataFrame], timed: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Time fields for rows that have none yet."""
    none = json_value("metadata", "absStart", "double").isNull()
    return {**tables, "parsed": with_time(tables["parsed"], F.col("media_info.duration"), **(timed or {}), where=none)}


def remove(tables: dict[str, DataFrame], query: dict | None = None, where: str | None = None, orid: int | None = None, cascade: bool = True) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables without the media that a predicate selects, the media removed). Annotations go with them."""
    if not query and where is None and orid is None:
        raise ValueError("removing needs a predicate")
    gone = find(tables["parsed"], query, where, orid)
    return without(tables, gone.select("orid"), cascade), gone


def without(tables: dict[str, DataFrame], ids: DataFrame, cascade: bool = True) -> dict[str, DataFrame]:
    """A catalogue without the media of some ids, and their annotations."""
    keys = {"parsed": "orid", "original": "id"} | ({"annotations": "orid"} if cascade else {})
    return tables | {n: tables[n].join(ids.select(F.col("orid").alias(k)), k, "left_anti").select(*tables[n].columns) for n, k in keys.items()}


def merge(first: dict[str, DataFrame], second: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Two catalogues as one; see :func:`merged`."""
    return added(first, merged(first, second))


def merged(first: dict[str, DataFrame], second: dict[str, DataFrame], tops: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """The rows that a second catalogue adds: its ids follow the first's, media whose md5 the first has are left out."""
    shift = tops or largest(first)
    stores = second["datastores"].join(first["datastores"].select("hash"), "hash", "left_anti")
    fresh = second["parsed"].join(first["parsed"].select("md5"), "md5", "left_anti")
    ids = fresh.select("orid")
    moved_stores = first["datastores"].select("id", "hash").unionByName(stores.select((F.col("id") + shift["datastores"]).alias("id"), "hash"))
    renamed = second["datastores"].select(F.col("id").alias("_old"), "hash").join(moved_stores.select(F.col("id").alias("source_id"), "hash"), "hash")
    original = second["original"].join(ids.withColumnRenamed("orid", "id"), "id", "left_semi")
    original = original.withColumn("fkey", json_value("source", "fkey")).withColumn("_old", json_value("source", "source_id", "bigint"))
    original = with_store(original, renamed.select("_old", "source_id"), "_old", "left").withColumn("source", F.to_json(F.struct("fkey", "source_id"))).select("id", "source", "metadata")
    notes = second["annotations"].join(ids, "orid", "left_semi")
    return {
        "datastores": stores.withColumn("id", F.col("id") + shift["datastores"]),
        "original": original.withColumn("id", F.col("id") + shift["original"]),
        "parsed": fresh.withColumn("orid", F.col("orid") + shift["original"]),
        "annotations": notes.withColumn("id", F.col("id") + shift["annotations"]).withColumn("orid", F.col("orid") + shift["original"]),
    }
