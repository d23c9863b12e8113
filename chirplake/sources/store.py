"""Stored catalogues: tables in buckets, changed bucket by bucket, under numbered snapshots."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chirplake.operators.filters import json_number, json_text
from chirplake.schema import TABLES
from chirplake.sources import writers

#: What decides the bucket of a row; rows of a recording are in the same bucket of each table.
KEYS = {"datastores": "id", "original": "id", "parsed": "orid", "annotations": "orid", "md5s": "md5"}
SCHEMAS = {**TABLES, "md5s": T.StructType([T.StructField("md5", T.StringType()), T.StructField("orid", T.LongType())])}
#: Columns whose largest value a snapshot keeps, so that new ids need no scan.
TOPS = {"datastores": "id", "original": "id", "annotations": "id"}
#: Words of 64 bits of a filter of a part of a bucket, and bits that an md5 sets in it.
WORDS, PROBES = 1 << 14, 7
#: Parts of a bucket from which it is written anew.
MOST_PARTS = 16


class Conflict(RuntimeError):
    """Another writer has committed a snapshot since this one was read."""


def probes(md5: Column) -> Column:
    """Places of an md5's bits in the filter of its bucket."""
    return F.array_distinct(F.array(*[F.pmod(F.xxhash64(md5, F.lit(k)), F.lit(WORDS * 64)) for k in range(PROBES)]))


class Store:
    """Tables below a path: ``data/<table>/<version>/bucket=<n>`` and ``snapshots/<number>.json``.

    A snapshot names, for each table, the versions and buckets that it consists of. Appending adds a version; a change
    writes a new version of the buckets it touches and leaves the others as they are. Nothing is written over, and a
    snapshot appears by a rename once its data are there, so a crash leaves the one before as it was. Snapshots are
    numbered: of two writers from the same one, the later gets :class:`Conflict` and starts again.

    md5s have a table of their own, in buckets by md5. Each part of a bucket has a Bloom filter, stored as its words that
    aren't zero, so that a search opens only parts that may hold what it looks for. ``scanned`` has those of the last one.
    Paths in ``shred`` have their values in typed columns beside the JSON text.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.scanned = spark, path.rstrip("/"), []
        self.snapshot = self._last() or {"number": 0, "buckets": buckets, "tables": {n: [] for n in SCHEMAS}, "tops": dict.fromkeys(TOPS, 0), "shred": [], "streams": {}}

    # files, by Hadoop's interface to any store

    def _fs(self, path: str) -> tuple[Any, Any]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, path: str) -> list[str]:
        fs, at = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def _last(self) -> dict | None:
        numbers = sorted(n for n in self._names(f"{self.path}/snapshots") if re.fullmatch(r"\d+\.json", n))
        return writers.load_json(self.spark, f"{self.path}/snapshots/{numbers[-1]}") if numbers else None

    @staticmethod
    def exists(spark: SparkSession, path: str) -> bool:
        return writers.exists(spark, f"{path.rstrip('/')}/snapshots")

    def commit(self, changed: dict[str, Any]) -> None:
        """The next snapshot: this one with what has changed."""
        new = {**self.snapshot, **changed, "number": self.snapshot["number"] + 1}
        place, draft = f"{self.path}/snapshots/{new['number']:012d}.json", f"{self.path}/snapshots/.{uuid.uuid4().hex}"
        writers.save_json(self.spark, draft, new)
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        none = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        context = hadoop.FileContext.getFileContext(self._fs(place)[0].getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(hadoop.Path(draft), hadoop.Path(place), none)  # an error if the number is taken
        except Py4JJavaError as e:
            writers.delete(self.spark, draft)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"snapshot {new['number']} is there already") from e
            raise
        self.snapshot = new

    def refresh(self) -> Store:
        self.snapshot = self._last() or self.snapshot
        return self

    # reading

    def bucket(self, name: str) -> Column:
        n = 1 if name == "datastores" else self.snapshot["buckets"]
        return F.pmod(F.xxhash64(F.col(KEYS[name])), F.lit(n)).cast("int")

    def shredded(self) -> dict[str, tuple[str, str]]:
        """Paths in typed columns: that of its numbers and that of its texts."""
        return {p: (f"_number{i}", f"_text{i}") for i, p in enumerate(self.snapshot["shred"])}

    def schema(self, name: str, wide: bool = False) -> T.StructType:
        out = T.StructType(list(SCHEMAS[name].fields))
        for number, text in self.shredded().values() if wide and name == "parsed" else ():
            out = out.add(number, "double").add(text, "string")
        return out

    def paths(self, name: str, buckets: Iterable[int] | None = None) -> list[str]:
        wanted = None if buckets is None else set(buckets)
        return [f"{self.path}/data/{name}/{v}/bucket={b}" for v, have in self.snapshot["tables"][name] for b in have if wanted is None or b in wanted]

    def table(self, name: str, buckets: Iterable[int] | None = None, wide: bool = False) -> DataFrame:
        """A table, or some of its buckets; ``wide`` with the typed columns of JSON paths."""
        paths, schema = self.paths(name, buckets), self.schema(name, wide)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def tables(self) -> dict[str, DataFrame]:
        return {n: self.table(n) for n in TABLES}

    def buckets_of(self, name: str, rows: DataFrame) -> list[int]:
        """The buckets that rows are in; not more than there are."""
        return sorted(r.b for r in rows.select(self.bucket(name).alias("b")).distinct().collect())

    # writing

    def _typed(self, name: str, df: DataFrame) -> DataFrame:
        plain = df.select(*SCHEMAS[name].fieldNames())
        if name == "parsed":
            for path, (number, text) in self.shredded().items():
                plain = plain.withColumn(number, json_number(path)).withColumn(text, json_text(path))
        return plain

    def _write(self, name: str, df: DataFrame) -> list:
        """A new version of a table: (version, its buckets)."""
        version = uuid.uuid4().hex
        place = f"{self.path}/data/{name}/{version}"
        # a bucket that holds too much for one task is split by Spark
        self._typed(name, df).withColumn("bucket", self.bucket(name)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(place)
        buckets = sorted(int(n.removeprefix("bucket=")) for n in self._names(place) if n.startswith("bucket="))
        if name == "md5s" and buckets:
            rows = self.spark.read.schema(SCHEMAS[name]).parquet(*[f"{place}/bucket={b}" for b in buckets])
            bits = rows.where("md5 IS NOT NULL").select(self.bucket(name).alias("bucket"), F.explode(probes(F.col("md5"))).alias("p"))
            words = bits.groupBy("bucket", F.floor(F.col("p") / 64).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)).cast("int"))).alias("bits"))
            words.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/blooms/{version}")
        return [version, buckets]

    def _raised(self, rows: dict[str, DataFrame]) -> dict[str, int]:
        tops = dict(self.snapshot["tops"])
        for name, column in TOPS.items():
            if name in rows:
                tops[name] = max(tops[name], rows[name].agg(F.max(column)).first()[0] or 0)
        return tops

    def append(self, rows: dict[str, DataFrame], batch: tuple[str, int] | None = None) -> None:
        """Add rows to tables, in one snapshot; buckets that came to many parts are written anew.

        ``batch`` is a stream and the number of its batch; it is kept with the rows, so that a batch is there or isn't.
        """
        rows = dict(rows)
        written = {n: self._write(n, df) for n, df in rows.items()}
        if "parsed" in rows:
            version, buckets = written["parsed"]
            back = [f"{self.path}/data/parsed/{version}/bucket={b}" for b in buckets]
            if back:
                written["md5s"] = self._write("md5s", self.spark.read.schema(self.schema("parsed")).parquet(*back).select("md5", "orid"))
        tables = dict(self.snapshot["tables"])
        for name, (version, buckets) in written.items():
            if buckets:
                tables[name] = [*tables[name], [version, buckets]]
        new = {n: self.spark.read.schema(self.schema(n)).parquet(*[f"{self.path}/data/{n}/{v}/bucket={b}" for b in have]) for n, (v, have) in written.items() if have}
        streams = {**self.snapshot.get("streams", {}), **({batch[0]: batch[1]} if batch else {})}
        self.commit({"tables": tables, "tops": self._raised({n: df for n, df in new.items() if n in TOPS}), "streams": streams})
        self.compact()

    def replace(self, rows: dict[str, DataFrame], buckets: Iterable[int]) -> None:
        """Tables with other rows in the buckets given, in one snapshot. What is in other buckets isn't read or written."""
        gone = sorted(set(buckets))
        tables = dict(self.snapshot["tables"])
        for name, df in rows.items():
            version, have = self._write(name, df)
            if extra := set(have) - set(gone):
                raise ValueError(f"rows of {name} for buckets {sorted(extra)}, which aren't replaced")
            kept = [[v, [b for b in bs if b not in gone]] for v, bs in tables[name]]
            tables[name] = [p for p in [*kept, [version, have]] if p[1]]
        self.commit({"tables": tables})

    def forget_md5s(self, md5s: DataFrame) -> None:
        """Leave md5s out; their buckets are written anew, with their filters."""
        buckets = self.buckets_of("md5s", md5s)
        self.replace({"md5s": self.table("md5s", buckets).join(md5s.select("md5"), "md5", "left_anti")}, buckets)

    def compact(self, most: int = MOST_PARTS) -> None:
        """Write buckets of more than ``most`` parts anew, as one."""
        for name in SCHEMAS:
            count: dict[int, int] = {}
            for _, buckets in self.snapshot["tables"][name]:
                for b in buckets:
                    count[b] = count.get(b, 0) + 1
            if full := [b for b, n in count.items() if n > most]:
                self.replace({name: self.table(name, full)}, full)

    def shred(self, paths: list[str] | None = None, most: int = 16) -> list[str]:
        """Keep the values of JSON paths in typed columns from now on; of the ``most`` commonest ones, if none are given."""
        chosen = common_paths(self.table("parsed"), most) if paths is None else list(paths)
        before, everything = self.snapshot, range(self.snapshot["buckets"])
        plain = self.table("parsed")
        self.snapshot = {**before, "shred": chosen}
        try:
            self.replace({"parsed": plain}, everything)
        except BaseException:
            self.snapshot = before
            raise
        return chosen

    def vacuum(self) -> int:
        """Delete snapshots before this one and the versions that it doesn't name; gives the number of versions deleted.

        For when no other session reads or writes the store.
        """
        for n in self._names(f"{self.path}/snapshots"):
            if n != f"{self.snapshot['number']:012d}.json":
                writers.delete(self.spark, f"{self.path}/snapshots/{n}")
        gone = 0
        for name in [*SCHEMAS, "blooms"]:
            used = {v for v, _ in self.snapshot["tables"]["md5s" if name == "blooms" else name]}
            for version in set(self._names(f"{self.path}/data/{name}")) - used:
                writers.delete(self.spark, f"{self.path}/data/{name}/{version}")
                gone += 1
        return gone

    # md5s

    def known(self, wanted: DataFrame) -> DataFrame:
        """(md5) those of ``wanted`` that are stored. Parts of buckets whose filters rule all of them out aren't opened.

        What reaches the driver is names of parts, at most MOST_PARTS for a bucket.
        """
        self.scanned = []
        nothing = self.spark.createDataFrame([], "md5 string")
        parts = self.snapshot["tables"]["md5s"]
        asked = wanted.select("md5").where("md5 IS NOT NULL").distinct().withColumn("bucket", self.bucket("md5s"))
        buckets = {r.bucket for r in asked.select("bucket").distinct().collect()}
        words = self._filters(parts, buckets)
        if words is None:
            return nothing
        each = asked.select("md5", "bucket", F.size(probes(F.col("md5"))).alias("n"), F.explode(probes(F.col("md5"))).alias("p")).withColumn("word", F.floor(F.col("p") / 64).cast("int"))
        there = F.call_function("shiftright", "bits", F.pmod("p", F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1
        found = each.join(words, ["bucket", "word"]).where(there).groupBy("md5", "bucket", "part", "n").agg(F.count(F.lit(1)).alias("hits")).where("hits = n")
        maybe = found.select("part", "bucket").distinct().collect()
        self.scanned = sorted((parts[r.part][0], r.bucket) for r in maybe)
        if not maybe:
            return nothing
        stored = self.spark.read.schema(SCHEMAS["md5s"]).parquet(*[f"{self.path}/data/md5s/{v}/bucket={b}" for v, b in self.scanned])
        return asked.select("md5").join(stored.select("md5"), "md5", "left_semi")

    def _filters(self, parts: list, buckets: set[int]) -> DataFrame | None:
        """(part, bucket, word, bits) of the filters of buckets; the parts are told apart by their folders."""
        paths = [f"{self.path}/data/blooms/{v}/bucket={b}" for v, have in parts for b in have if b in buckets]
        if not paths:
            return None
        rows = self.spark.read.schema("word int, bits long").parquet(*paths)
        place = F.regexp_extract(F.col("_metadata.file_path"), r"/blooms/([0-9a-f]+)/bucket=(\d+)/", 1)
        bucket = F.regexp_extract(F.col("_metadata.file_path"), r"/blooms/([0-9a-f]+)/bucket=(\d+)/", 2).cast("int")
        numbers = F.create_map(*[F.lit(x) for i, (v, _) in enumerate(parts) for x in (v, i)])
        return rows.select(F.element_at(numbers, place).alias("part"), bucket.alias("bucket"), "word", "bits")


def leaves(kind: str) -> list[tuple[str, ...]]:
    """Paths of the values in a type as Spark writes it: ``OBJECT<a: BIGINT, b: OBJECT<c: STRING>>``."""

    def walk(text: str) -> list[tuple[str, ...]]:
        if not (text.startswith("OBJECT<") and text.endswith(">")):
            return [()]
        out, depth, at, inside = [], 0, 0, text[7:-1]
        for i, c in enumerate(inside + ","):
            depth += (c == "<") - (c == ">") + (c == "(") - (c == ")")
            if c == "," and depth == 0 and inside[at:i].strip():
                name, _, rest = inside[at:i].strip().partition(": ")
                out += [(name.strip("`"), *tail) for tail in walk(rest)]
                at = i + 1
        return out

    return [p for p in walk(kind) if p]


def common_paths(parsed: DataFrame, most: int, column: str = "metadata") -> list[str]:
    """The ``most`` paths of a JSON column that most rows have, by two aggregates over all of them."""
    variants = parsed.select(F.try_parse_json(column).alias("v"))
    kind = variants.agg(F.schema_of_variant_agg("v")).first()[0] or ""
    paths = [p for p in leaves(kind) if all(re.fullmatch(r"[A-Za-z0-9_ -]+", x) for x in p)]
    if not paths:
        return []
    from chirplake.operators.filters import json_path

    counts = variants.agg(*[F.count(F.try_variant_get("v", json_path(p), "variant")).alias(f"n{i}") for i, p in enumerate(paths)]).first()
    order = sorted(range(len(paths)), key=lambda i: (-counts[i], paths[i]))
    return [".".join((column, *paths[i])) for i in order[:most] if counts[i]]

