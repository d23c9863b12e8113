"""Helpers of the operators: tables in the shared folder, components of a link graph, bucketed pair search."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the word rules of the operators see it.
SPACES = r"\x20\x09-\x0D"
WORD = f"[^{SPACES}]+"

_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset on a local master (tests), a temporary folder.

    On a cluster a folder of one machine would lose rows, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        folder = _own_folders.setdefault(app, "file://" + tempfile.mkdtemp(prefix="chirplake-"))
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/chirplake/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables of :func:`saved` that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._saved_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Neighbours from which a node of a link graph is joined apart, at least, and such nodes, at most.
HOT, HOT_NODES = 512, 100_000
#: Rows up to which a table whose rows have been counted is broadcast.
BROADCAST_ROWS = 200_000


def few(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A saved table, to be broadcast if its counted rows are few; else Spark joins it by shuffles."""
    return F.broadcast(df) if df.count() <= most else df


def with_least(links: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(links (a, b) with m, the least of a and its b; the (a, m) themselves).

    ``links`` has at most ``n`` rows. The minima are combined map-side. Nodes with more neighbours than HOT or than
    ``n / HOT_NODES`` are at most HOT_NODES, so their minima are broadcast, and no task gets all links of one of them.
    """
    low = links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
    hot = F.col("n") > max(HOT, n // HOT_NODES)
    stars = F.broadcast(low.where(hot).select("a", F.col("m").alias("star")))
    dealt = links.join(stars, "a", "left")
    rest = dealt.where("star IS NULL").drop("star").join(low.where(~hot).select("a", "m"), "a")
    return dealt.where("star IS NOT NULL").select("a", "b", F.col("star").alias("m")).union(rest.select("a", "b", "m")), low.select("a", "m")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long); root is the least node of its component.

    Alternating large-star and small-star rounds: each round is two map-side combined minima and two joins, and the
    number of rounds grows with the logarithm of the longest chain. Only a count and a checksum reach the driver.
    """

    def state(df: DataFrame) -> tuple[int, int]:
        x = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31))).alias("h")).first()
        return x["n"], x["h"] or 0

    now = saved(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = state(now)
    while before[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = saved(with_least(both, 2 * before[0])[0].where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "links-large")
        small, low = with_least(large, 2 * before[0])
        small = small.where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        after = saved(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        forget(now, large)
        now, last, before = after, before, state(after)
        if before == last:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


class Forest:
    """Components of nodes 0..n-1 under batches of links, in arrays; keeps labels, not links."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            x, y = label[a], label[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            low, high = np.minimum(x, y), np.maximum(x, y)
            np.minimum.at(label, high, low)
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label = up
        self.label = label

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Each node that isn't the least of its component, with that least node."""
        rest = np.flatnonzero(self.label != np.arange(len(self.label)))
        return rest, self.label[rest]


def hot_cells(rows: DataFrame, chunk: int = 2048, weight: str | None = None, weighs: int = 1 << 20) -> DataFrame:
    """(cell, parts) of the cells whose rows are more than ``chunk``, or whose weights are more than ``weighs``; saved."""
    counts = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(weight) if weight else F.lit(0)).alias("w"))
    parts = F.greatest(F.ceil(F.col("n") / chunk), F.ceil(F.col("w") / weighs)).cast("int")
    return saved(counts.select("cell", parts.alias("parts")).where("parts > 1"), "hot-cells")


def by_cell(rows: DataFrame, hot: DataFrame, search: Callable[[pd.DataFrame], pd.DataFrame], schema: str, tasks: int) -> DataFrame:
    """``search`` over the rows of each cell; ``rows`` has ``cell`` and ``node`` (long), ``hot`` is of :func:`hot_cells`.

    A hot cell is dealt into parts by a hash of the node, and each pair of parts goes somewhere of its own, so that no
    task holds more than two parts of one cell and no pair is lost. ``search`` gets the rows of many cells at once, with
    ``lo`` and ``hi``, the pair of parts they are there for, and ``part``, their own; it compares rows of the same
    (cell, lo, hi), and of different ``part`` where lo < hi.
    """
    parts = F.coalesce(F.col("parts"), F.lit(1))
    dealt = (
        rows.join(few(hot), "cell", "left")
        .withColumn("part", F.pmod(F.xxhash64("node", F.lit(7)), parts).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .withColumn("lo", F.least("part", "other"))
        .withColumn("hi", F.greatest("part", "other"))
        .drop("parts", "other")
    )
    dealt = dealt.withColumn("bin", F.pmod(F.xxhash64("cell", "lo", "hi"), F.lit(tasks)).cast("int"))
    return dealt.groupBy("bin").applyInPandas(search, schema)


def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal keys in sorted arrays."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, int), np.zeros(0, int)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    starts = np.flatnonzero(new)
    return starts, np.append(starts[1:], n)


def pieces(items: list, most: int) -> Iterator[list]:
    for i in range(0, len(items), most):
        yield items[i : i + most]


def release_memory() -> None:
    """Give memory that this worker has freed back to the system, where its C library can; Python and Arrow keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
