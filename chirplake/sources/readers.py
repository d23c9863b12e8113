"""Sources of recordings as DataFrames of (datastore, source, metadata), by type.

``datastore`` is the descriptor (hash, type, conf, metadata), ``source`` has fkey, ``metadata`` is JSON text. Passwords
never reach a descriptor.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chirplake.sources.media import HEADER_FIELDS, media_files

SECRETS = {"password", "passwd", "pwd", "token", "secret"}
#: Places (start, end) of fields in the first 200 bytes of a recorder's file; the second set is for shifted headers.
HEADER = {"time": (68, 87), "voltage": (166, 169), "device_id": (107, 123), "gain": (140, 141)}
SHIFTED = {"time": (68, 87), "voltage": (168, 171), "device_id": (109, 125), "gain": (142, 143)}
ZONES = ((89, 92), (84, 94))
HEAD_BYTES = 200


def hash_dict(d: dict) -> str:
    """md5 of a dict as canonical JSON."""
    return hashlib.md5(json.dumps(d, sort_keys=True, ensure_ascii=True).encode()).hexdigest()


def redacted(conf: dict) -> dict:
    return {k: "***" if k.lower() in SECRETS else redacted(v) if isinstance(v, dict) else v for k, v in conf.items()}


def descriptor(kind: str, conf: dict, metadata: dict | None = None) -> dict[str, str | None]:
    shown = redacted(conf)
    return {"hash": hash_dict(shown), "type": kind, "conf": json.dumps(shown, sort_keys=True), "metadata": json.dumps(metadata) if metadata is not None else None}


def _records(df: DataFrame, spec: dict, fkey: Column, metadata: Column) -> DataFrame:
    store = F.struct(*[F.lit(spec[k]).cast("string").alias(k) for k in ("hash", "type", "conf", "metadata")])
    return df.select(store.alias("datastore"), F.struct(fkey.cast("string").alias("fkey")).alias("source"), metadata.alias("metadata"))


def direct(spark: SparkSession, conf: dict) -> DataFrame:
    """A list of dicts; its index is the key."""
    spec = descriptor("direct", {"dbname": None, "host": None, "port": None, "target": None})
    rows = [(i, json.dumps(r)) for i, r in enumerate(conf["data"])]
    return _records(spark.createDataFrame(rows, "i long, metadata string"), spec, F.col("i"), F.col("metadata"))


def json_lines(spark: SparkSession, conf: dict) -> DataFrame:
    """Files of one JSON object a line; ``ukey`` names the key."""
    df = spark.read.text(conf["path"])
    return _records(df, descriptor("json", conf), F.get_json_object("value", f"$.{conf['ukey']}"), F.col("value"))


def csv(spark: SparkSession, conf: dict) -> DataFrame:
    """Delimited files with a header; ``ukey`` names the key column."""
    df = spark.read.csv(conf["path"], header=True, sep=conf.get("sep", ","))
    return _records(df, descriptor("csv", conf), F.col(conf["ukey"]), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))


def postgresql(spark: SparkSession, conf: dict) -> DataFrame:
    """Rows of a SELECT (``target``) over JDBC; ``ukey`` becomes text. Split by ``partition_column`` if that is given."""
    reader = spark.read.format("jdbc").option("url", f"jdbc:postgresql://{conf['host']}:{conf.get('port', 5432)}/{conf['dbname']}")
    reader = reader.option("user", conf.get("user", "")).option("password", conf.get("password", ""))
    if "partition_column" in conf:
        reader = reader.option("dbtable", f"({conf['target']}) q").option("partitionColumn", conf["partition_column"])
        for key, name in (("lower", "lowerBound"), ("upper", "upperBound"), ("partitions", "numPartitions")):
            reader = reader.option(name, conf[key])
    else:
        reader = reader.option("query", conf["target"])
    df = reader.load()
    df = df.withColumn(conf["ukey"], F.col(conf["ukey"]).cast("string"))
    return _records(df, descriptor("postgresql", conf), F.col(conf["ukey"]), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))


#: Ids that one lookup asks for.
LOOKUP = 1000


def id_table(spark: SparkSession, ids: Any) -> DataFrame:
    """(id) distinct ids as text: of a table of one column, of a path of text files of an id a line, or of a list."""
    if isinstance(ids, str):
        ids = spark.read.text(ids)
    elif not isinstance(ids, DataFrame):
        import pandas as pd

        ids = spark.createDataFrame(pd.DataFrame({"id": [str(i) for i in ids if i is not None]}, dtype="string"), "id string")
    return ids.select(F.col(ids.columns[0]).cast("string").alias("id")).where("id IS NOT NULL").distinct()


def looked_up(ids: DataFrame, fetch: Callable[[list[str]], Iterator[dict[str, Any]]], key: str, batch: int = LOOKUP) -> DataFrame:
    """(fkey, metadata) of what a source has for a table of ids, asked for in batches where the ids are.

    ``fetch`` gets a list of ids and gives documents; it is called once for each batch, on the executors. So no list of
    ids is in the plan, and the source is never read as a whole. Ids are dealt out by hash, each to one batch.
    """

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pandas as pd

        held: list[str] = []

        def answers(some: list[str]) -> Any:
            found = list(fetch(some))
            return pd.DataFrame({"fkey": [str(d[key]) for d in found], "metadata": [json.dumps(d, default=str) for d in found]}, dtype="string")

        for part in batches:
            held += part.id.tolist()
            while len(held) >= batch:
                yield answers(held[:batch])
                held = held[batch:]
        if held:
            yield answers(held)

    return ids.repartition("id").mapInPandas(run, "fkey string, metadata string")


def mongo_fetch(conf: dict) -> Callable[[list[str]], Iterator[dict[str, Any]]]:
    """Documents of a collection by their keys, over the driver's client library on each executor."""
    place, key, fields = f"mongodb://{conf['host']}:{conf.get('port', 27017)}", conf["ukey"], conf.get("fields")

    def fetch(some: list[str]) -> Iterator[dict[str, Any]]:
        from bson import ObjectId
        from pymongo import MongoClient

        wanted = [*some, *[ObjectId(s) for s in some if key == "_id" and ObjectId.is_valid(s)], *[int(s) for s in some if s.lstrip("-").isdigit()]]
        with MongoClient(place) as client:
            yield from client[conf["dbname"]][conf["collection"]].find({key: {"$in": wanted}}, dict.fromkeys([key, *fields], 1) if fields else None)

    return fetch


def mongodb(spark: SparkSession, conf: dict) -> DataFrame:
    """A collection of documents: what a query selects (``filter``) through the Spark connector, or the documents of ``ids``.

    ``ids`` (or a list as ``filter``) is a list, a table or a path of keys, looked up in batches by ``fetch``, which is
    :func:`mongo_fetch` if it isn't given. ``fields`` are the columns, ``ukey`` the key.
    """
    from chirplake.operators.filters import find

    shown = {k: v for k, v in conf.items() if k not in ("fetch", "ids") and not isinstance(v, DataFrame)}
    ids = conf.get("ids", conf.get("filter") if isinstance(conf.get("filter"), list) else None)
    if ids is not None:
        shown.pop("filter", None)
        found = looked_up(id_table(spark, ids), conf.get("fetch") or mongo_fetch(shown), conf["ukey"], conf.get("batch", LOOKUP))
        return _records(found, descriptor("mongodb", shown), F.col("fkey"), F.col("metadata"))
    df = spark.read.format("mongodb").option("connection.uri", f"mongodb://{conf['host']}:{conf.get('port', 27017)}").option("database", conf["dbname"]).option("collection", conf["collection"]).load()
    df = find(df, conf.get("filter"), json_columns=())
    if conf.get("fields"):
        df = df.select(conf["ukey"], *[f for f in conf["fields"] if f != conf["ukey"]])
    return _records(df, descriptor("mongodb", shown), F.col(conf["ukey"]), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))


def audiomoth(spark: SparkSession, conf: dict) -> DataFrame:
    """Recorder files of a folder (not below it): device, time, zone, gain and voltage from the first 200 bytes, and no more is read.

    Where a number can't be read at its usual place, the shifted places hold.
    """
    files = media_files(spark, conf["path"], ["path", "head"], recursiveFileLookup="false", headBytes=HEAD_BYTES)
    head = F.decode("head", "ISO-8859-1")
    at = lambda place: F.substring(head, place[0] + 1, place[1] - place[0])

    def fields(places: dict) -> Column:
        zone = F.when(F.instr(at(ZONES[0]), "-") + F.instr(at(ZONES[1]), "-") > 0, at(ZONES[1])).otherwise(at(ZONES[0]))
        numbers = {k: at(places[k]).try_cast("double") for k in ("voltage", "gain")}
        ok = numbers["voltage"].isNotNull() & numbers["gain"].isNotNull()
        return F.when(ok, F.struct(F.col("path"), at(places["time"]).alias("time"), zone.alias("tZone"), at(places["device_id"]).alias("device_id"), numbers["gain"].alias("gain"), numbers["voltage"].alias("battery"), F.lit(1.0).alias("timeexp")))

    read = F.coalesce(fields(HEADER), fields(SHIFTED))
    return _records(files.withColumn("h", read), descriptor("audioMoth", conf), F.element_at(F.split("path", "/"), -1), F.to_json("h", {"ignoreNullFields": "false"}))


def streamed(df: DataFrame, name: str, metadata: Column) -> DataFrame:
    """Records of files that a stream brings; the path is the key."""
    return _records(df, descriptor("stream", {"name": name}), F.col("path"), metadata)


READERS: dict[str, Callable[[SparkSession, dict], DataFrame]] = {
    "direct": direct, "json": json_lines, "csv": csv, "postgresql": postgresql, "mongodb": mongodb, "audioMoth": audiomoth,
}


def register(kind: str, reader: Callable[[SparkSession, dict], DataFrame]) -> None:
    READERS[kind] = reader


def pull(spark: SparkSession, kind: str, conf: dict[str, Any]) -> DataFrame:
    """Records of a datastore by its type."""
    if kind not in READERS:
        raise ValueError(f"no datastore type {kind}")
    return READERS[kind](spark, conf)


def wav_files(spark: SparkSession, path: str) -> DataFrame:
    """Files with media_info but timeexp: path, filesize, header fields, md5; one row a file, hashed a block at a time."""
    return media_files(spark, path, ["path", "filesize", "md5", *HEADER_FIELDS])


def with_content(media: DataFrame) -> DataFrame:
    """``media`` (with a path) and the bytes of each file, one file at a time; any store that Arrow knows."""
    from collections.abc import Iterator

    import pyarrow as pa
    from pyarrow import fs

    names = media.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, path in enumerate(batch.column("path").to_pylist()):
                store, place = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
                with store.open_input_file(place) as f:
                    data = f.read()
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([data], pa.binary())], names=[*names, "content"])

    kinds = ", ".join(f"`{n}` {t}" for n, t in media.dtypes)
    return media.mapInArrow(run, f"{kinds}, content binary")
