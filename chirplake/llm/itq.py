"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, reranking with the original vectors."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from chirplake.llm.shared import Forest, by_cell, components, few, forget, hot_cells, runs, saved

COSINE = 0.93
ROUNDS = 30
#: Rows that a cell of a table has on average, at most; the least bits of a table; the share of pairs at COSINE that may share
#: no table if directions were random.
CELL_ROWS, TABLE_BITS, MISS = 4096, 8, 0.03
#: Vectors that a rotation is learned on, the first of their length in order of a hash of the vector; codes and tables hold
#: every vector, and CODED of them are coded at once.
FIT_SAMPLE, CODED = 10_000, 8192
SLICE = 512


def shape(rows: int) -> tuple[int, int]:
    """(tables, bits of each) for so many vectors of a label: bits grow with the rows, and tables with the bits."""
    bits = max(TABLE_BITS, math.ceil(math.log2(max(rows, 1) / CELL_ROWS)))
    alike = (1 - math.acos(COSINE) / math.pi) ** bits
    return max(1, round(math.log(MISS) / math.log(1 - alike))), bits


def learn(vectors: np.ndarray, bits: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(centre, projection) of unit vectors: principal directions, turned until their signs lose least.

    Vectors of fewer dimensions than ``bits`` get random directions for the rest.
    """
    rng = np.random.default_rng(0)
    centre = vectors.mean(axis=0)
    x = vectors - centre
    dims = min(bits, x.shape[1])
    _, axes = np.linalg.eigh(x.T @ x)
    main = axes[:, ::-1][:, :dims]
    y = x @ main
    turn = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
    for _ in range(rounds):
        left, _, right = np.linalg.svd(np.where(y @ turn >= 0, 1.0, -1.0).T @ y)
        turn = (left @ right).T
    return centre, np.hstack([main @ turn, rng.standard_normal((x.shape[1], bits - dims))])


def codes(vectors: np.ndarray, model: tuple[np.ndarray, np.ndarray], tables: int) -> np.ndarray:
    """A number for each table: the signs of its share of the directions."""
    signs = ((vectors - model[0]) @ model[1] >= 0).reshape(len(vectors), tables, -1)
    return signs @ (1 << np.arange(signs.shape[2], dtype=np.int64))


def unit(batch: pa.Array, dims: int) -> np.ndarray:
    x = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def search(rows: pd.DataFrame) -> pd.DataFrame:
    """Of each cell's pairs at COSINE or more: how many vectors each class links with here, and links that span them.

    A pair that shares several tables counts in the first of them only.
    """
    rows = rows.sort_values(["cell", "lo", "hi", "label", "dims"], kind="stable")
    cell, lo, hi, part, copies, table, label, dims = (rows[c].to_numpy() for c in ("cell", "lo", "hi", "part", "copies", "table", "label", "dims"))
    nodes, at = np.unique(rows["node"].to_numpy(), return_inverse=True)
    code = np.frombuffer(b"".join(rows["code"]), np.int64).reshape(len(rows), -1)
    forest, linked = Forest(len(nodes)), np.zeros(len(nodes), np.int64)
    vectors = rows["vector"].to_numpy()
    for start, end in zip(*runs(cell, lo, hi, label, dims), strict=True):  # a cell is a hash
        if end - start < 2:
            continue
        kind = np.float32 if len(vectors[start]) == 4 * dims[start] else np.float64
        x = np.frombuffer(b"".join(vectors[start:end]), kind).reshape(end - start, -1).astype(np.float64)
        norm, t, whole = np.linalg.norm(x, axis=1), table[start], lo[start] == hi[start]
        for i in range(start, end, SLICE):
            j = min(i + SLICE, end)
            cosines = x[i - start : j - start] @ x.T / (norm[i - start : j - start, None] * norm)
            a, b = np.nonzero(cosines >= COSINE)
            a, b = a + i, b + start
            fit = (b < a) & (whole | (part[a] != part[b]))
            a, b = a[fit], b[fit]
            first = (code[a] == code[b]).argmax(axis=1) == t
            a, b = a[first], b[first]
            np.add.at(linked, at[a], copies[b])
            np.add.at(linked, at[b], copies[a])
            forest.add(at[a], at[b])
    has = np.flatnonzero(linked)
    a, b = forest.links()
    counts = pd.DataFrame({"a": nodes[has], "b": pd.array([None] * len(has), "Int64"), "n": pd.array(linked[has], "Int64")})
    links = pd.DataFrame({"a": nodes[a], "b": pd.array(nodes[b], "Int64"), "n": pd.array([None] * len(a), "Int64")})
    return pd.concat([counts, links]) if len(has) else links


def fitted(classes: DataFrame, sample: int, bits: int) -> DataFrame:
    """(dims, centre, directions) of each length of vectors, learned where its sample is; ``classes`` has n, rows of its length.

    The first ``sample`` vectors in order of a hash have hashes below some share of all; twice that share goes to be ranked.
    """

    def fit(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        dims = rows.column("dims")[0]
        centre, directions = learn(unit(rows.column("vector").combine_chunks(), dims.as_py()), bits)
        return pa.table({"dims": pa.array([dims.as_py()], pa.int32()), "centre": [centre.tobytes()], "directions": [directions.tobytes()]})

    share = F.least(F.lit(1.0), 2.0 * sample / F.col("n"))
    low = classes.withColumn("h", F.xxhash64("vector")).where((F.col("h") / F.lit(2.0**64) + 0.5) <= share)
    place = F.row_number().over(Window.partitionBy("dims").orderBy("h", "label"))
    chosen = low.select("dims", "vector", place.alias("place")).where(F.col("place") <= sample)
    return chosen.groupBy("dims").applyInArrow(fit, "dims int, centre binary, directions binary")


def usable(vector: str = "vector"):
    """Not null, not empty, not zero, without null or non-finite components."""
    ok = lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))  # noqa: E731  nan is above infinity
    return F.coalesce(F.forall(vector, ok) & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_vectors(table: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label", sample: int = FIT_SAMPLE) -> DataFrame:
    """(row, n_links, component_id): rows of ``table`` as structs without the vector, with links and component.

    Vectors of one label and length link at a cosine of COSINE or more, in double precision. Equal vectors of a label are
    one class, which meets the others once; its members link with each other. A class's code has one number in each of
    several Hamming tables (:func:`shape`), from a rotation learned for its length; classes that share one are compared by their original vectors. Two vectors at
    a cosine of 0.93 or more miss all tables for about MISS of the pairs if directions were random, and for far fewer
    with learned ones (the tests measure it). A task returns counts and spanning links, not pairs.

    Rows whose label is null, or whose vector is null, empty, zero or holds null or non-finite components, link with
    nothing: 0 links, their own id as component. Rows with a null id take part; the least id reached is their
    component_id. Repeated rows link with each other. Empty in, empty out.
    """
    spark = table.sparkSession
    rest = [F.col(c) for c in table.columns if c != vector]
    doubles = F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0))
    rows = table.select(F.struct(*rest, F.lit(0).alias("_")).alias("row"), doubles.alias("vector"), F.col(label).cast("long").alias("label"), F.col(vec_id).alias("id"))
    rows = rows.withColumn("vector", F.when(usable() & F.col("label").isNotNull(), F.col("vector")))
    classes = rows.where("vector IS NOT NULL").groupBy("label", "vector").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    classes = saved(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("dims", F.size("vector")), "itq-classes")
    largest = classes.groupBy("label", "dims").count().agg(F.max("count")).first()[0] or 0
    n_tables, bits = shape(largest)
    lengths = saved(classes.groupBy("dims").agg(F.count(F.lit(1)).alias("n")), "itq-lengths")
    models = saved(fitted(classes.join(few(lengths), "dims"), sample, n_tables * bits), "itq-models")
    narrow = isinstance(table.schema[vector].dataType.elementType, T.FloatType)  # such vectors travel as they came

    def encode(rows: pa.Table, model: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return kind.empty_table()
        n, dims = rows.num_rows, rows.column("dims")[0].as_py()
        x = rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, dims)
        centre, directions = (np.frombuffer(model.column(c)[0].as_py(), np.float64) for c in ("centre", "directions"))
        code = codes(x / np.linalg.norm(x, axis=1, keepdims=True), (centre, directions.reshape(dims, -1)), n_tables)
        every = pa.array(np.repeat(np.arange(n), n_tables))
        binary = lambda a: pa.array([r.tobytes() for r in a], pa.binary()).take(every)
        columns = [rows.column(c).take(every) for c in ("label", "dims", "node", "copies")]
        columns += [pa.array(np.tile(np.arange(n_tables, dtype=np.int32), n)), pa.array(code.ravel()), binary(code), binary(x.astype(np.float32) if narrow else x)]
        return pa.table(columns, schema=kind)

    coded = "label long, dims int, node long, copies long, table int, at long, code binary, vector binary"
    kind = to_arrow_schema(T.StructType.fromDDL(coded))
    parts = F.ceil(F.col("n") / CODED).cast("int")
    rows_in = classes.join(few(lengths), "dims").withColumn("bin", F.pmod(F.xxhash64("node"), parts).cast("int")).drop("n")
    model_in = models.join(few(lengths), "dims").withColumn("bin", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")
    tables = rows_in.groupBy("dims", "bin").cogroup(model_in.groupBy("dims", "bin")).applyInArrow(encode, coded)
    tables = tables.withColumn("cell", F.xxhash64("label", "dims", "table", "at")).drop("at")
    tasks = max(256, classes.count() * n_tables // 4_000)
    found = saved(by_cell(tables, hot_cells(tables.select("cell")), search, "a long, b long, n long", tasks), "itq-found")
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    counts = found.where("n IS NOT NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    joined = classes.select("node", "id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = joined.groupBy("root").agg(F.min("id").alias("component_id")).join(joined.select("root", "node"), "root").select("node", "component_id")
    full = classes.join(least, "node").join(counts, "node", "left")
    full = full.select("label", "vector", "component_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    full = saved(full, "itq-out")
    forget(classes, lengths, models, found)
    out = rows.join(full, ["label", "vector"], "left")
    alone = F.when(F.col("vector").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select("row", F.coalesce("n_links", F.lit(0)).alias("n_links"), alone.alias("component_id"))
