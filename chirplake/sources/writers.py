"""Sinks: table snapshots, export bundles, audio chunks."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def save_tables(tables: dict[str, DataFrame], path: str, overwrite: bool = False) -> None:
    """One Parquet table for each name; an error if there is one already, unless overwritten."""
    for name, df in tables.items():
        df.write.mode("overwrite" if overwrite else "error").parquet(f"{path}/{name}.parquet")


def load_tables(spark: SparkSession, path: str, schemas: dict[str, T.StructType]) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).parquet(f"{path}/{name}.parquet") for name, schema in schemas.items()}


def write_node(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """A result kept for later: Parquet with gzip."""
    df.write.mode("overwrite" if overwrite else "error").option("compression", "gzip").parquet(path)


def save_json(spark: SparkSession, path: str, value: Any, overwrite: bool = True) -> None:
    """A small document as a file of its own, in any store that Spark writes."""
    jvm, at = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, overwrite)
    writer = jvm.java.io.OutputStreamWriter(stream, "UTF-8")
    writer.write(json.dumps(value, sort_keys=True))
    writer.close()


def load_json(spark: SparkSession, path: str) -> Any:
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).limit(1).collect()))


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def export_bundle(media: DataFrame, path: str, keys: list[str], overwrite: bool = False) -> None:
    """``metadata.csv`` (``|``, header) of media (path, md5, metadata): path, md5, fname and the metadata keys given."""
    columns = [F.col("path"), F.col("md5"), F.element_at(F.split("path", "/"), -1).alias("fname")]
    columns += [F.get_json_object("metadata", f"$['{k}']").alias(k) for k in keys]
    media.select(*columns).write.mode("overwrite" if overwrite else "error").csv(f"{path}/metadata.csv", sep="|", header=True, quote='"', escape='"')


def copy_media(media: DataFrame, folder: str) -> DataFrame:
    """Copy each file to ``folder``/<md5>.wav on the executors; (orid, md5, path, original_path) with the new places."""
    from pyarrow import fs

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                target = f"{folder.rstrip('/')}/{row.md5}.wav"
                local = lambda p: p if "://" in p or p.startswith("file:") else f"file://{p}"
                store, root = fs.FileSystem.from_uri(local(folder))
                store.create_dir(root, recursive=True)
                fs.copy_files(local(row.path), local(target))
                out.append((row.orid, row.md5, target, row.path))
            yield pd.DataFrame(out, columns=["orid", "md5", "path", "original_path"])

    return media.select("orid", "md5", "path").mapInPandas(run, "orid long, md5 string, path string, original_path string")


def delete_files(files: DataFrame) -> int:
    """Delete the files of a column ``path`` on the executors, and count those that were there."""
    from pyarrow import fs

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = 0
            for path in batch.path:
                store, place = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
                if store.get_file_info(place).type == fs.FileType.File:
                    store.delete_file(place)
                    n += 1
            yield pd.DataFrame({"n": [n]})

    return files.select("path").mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def write_chunks(media: DataFrame, folder: str, sr: int | None = None) -> DataFrame:
    """Write (orid, md5, path, tlimits, number) chunks as WAV to ``folder``/<md5>; (orid, number, tlimits, path).

    A chunk's frames are read by range, so a row has no bytes, and a recording of many chunks isn't read once for each.
    """
    from pyarrow import fs

    from chirplake.functions.dsp import encode
    from chirplake.sources.media import path_window

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                start, stop = row.tlimits
                x, rate = path_window(row.path, start, stop - start, sr)
                place = f"{root}/{row.md5}/{row.number}.wav"
                store.create_dir(place.rpartition("/")[0], recursive=True)
                with store.open_output_stream(place) as f:
                    f.write(encode(x, rate))
                out.append((row.orid, row.number, list(row.tlimits), place))
            yield pd.DataFrame(out, columns=["orid", "number", "tlimits", "path"])

    return media.select("orid", "md5", "path", "tlimits", "number").mapInPandas(run, "orid long, number int, tlimits array<double>, path string")


def write_signals(signals: DataFrame, folder: str, rate: int) -> DataFrame:
    """Write (name, signal) rows as one-channel WAV files to ``folder``, each where its row is; (name, path)."""
    from pyarrow import fs

    from chirplake.functions.dsp import encode

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        base = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
        store, root = fs.FileSystem.from_uri(base)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for name, signal in zip(batch.name, batch.signal, strict=True):
                with store.open_output_stream(f"{root}/{name}.wav") as f:
                    f.write(encode(np.asarray(signal, float), rate))
            yield pd.DataFrame({"name": batch.name, "path": [f"{base.rstrip('/')}/{n}.wav" for n in batch.name]})

    return signals.select("name", "signal").mapInPandas(run, "name string, path string")
