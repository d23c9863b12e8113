"""Embedding whitening: exact covariances by digit-sliced products, eigenvectors, components of unit variance."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chirplake.llm.shared import saved

#: x = floor(SCALE * c) + SHIFT of an entry c.
SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Bits of a limb, and rows of a product: 2 * 19 + 13 < 53 bits, so that float64 holds every sum of products exactly.
BITS, ROWS = 19, 8192
MASK = (1 << BITS) - 1
#: Parts whose sums meet in a task of the first round of merging; the second round merges those.
FAN_IN = 256
#: A component has no variance if its eigenvalue is at most this times the number of dimensions and the largest one.
FLAT = 1e-14


def fixed_points(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places in the batch, x as rows) of the usable vectors, by length."""
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(int)
    values = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(SCALE * values)
        bad = ~(np.abs(scaled) < 2.0**62)
    ok = lengths > 0
    ok[np.repeat(np.arange(len(lengths)), lengths)[bad]] = False
    starts = np.cumsum(lengths) - lengths
    for d in np.unique(lengths[ok]):
        at = np.flatnonzero(ok & (lengths == d))
        yield int(d), at, scaled[starts[at][:, None] + np.arange(d)].astype(np.int64) + SHIFT


def limbs(y: np.ndarray, bits: int) -> list[np.ndarray]:
    """Integers of up to ``bits`` bits and a sign as limbs in float64, lowest first; the last has the sign."""
    n = max(-(-(bits + 1) // BITS), 1)
    out = [((y >> (BITS * k)) & MASK).astype(float) for k in range(n - 1)]
    return [*out, (y >> (BITS * (n - 1))).astype(float)]


def carried(planes: np.ndarray) -> np.ndarray:
    """Big integers as int64 planes of BITS bits, lowest first, after carrying; the last plane has the sign."""
    planes = planes.copy()
    for k in range(len(planes) - 1):
        planes[k + 1] += planes[k] >> BITS
        planes[k] &= MASK
    return planes


def joined(planes: np.ndarray) -> np.ndarray:
    """Planes as Python integers."""
    return sum(p.astype(object) << (BITS * k) for k, p in enumerate(planes))


def products(y: np.ndarray, bits: int) -> np.ndarray:
    """Planes of y'y, exact: a float64 product for each pair of limbs, recombined by their places."""
    parts = limbs(y, bits)
    out = np.zeros((2 * len(parts) + 3, y.shape[1], y.shape[1]), np.int64)
    for a, left in enumerate(parts):
        for b in range(a, len(parts)):
            g = (left.T @ parts[b]).astype(np.int64)
            out[a + b] += g if a == b else g + g.T
    return carried(out)


def centred(x: np.ndarray, n: int, sums: list[int], bits: int) -> np.ndarray:
    """n * x - S, exact. int64 may wrap on the way, but not in the end unless more than 62 bits are needed."""
    if bits > 62:
        return x.astype(object) * n - np.array(sums, object)
    wrap = lambda v: (v + (1 << 63)) % (1 << 64) - (1 << 63)
    with np.errstate(over="ignore"):
        return x * np.int64(wrap(n)) - np.array([wrap(s) for s in sums], np.int64)


def gathered(vectors: DataFrame, gather: Callable[[int, np.ndarray], np.ndarray]) -> dict[int, tuple[int, np.ndarray, list[int], list[int]]]:
    """By length: (n, planes, lowest x, highest x), with the planes of ``gather(length, x)`` summed over all vectors.

    Each task hands on one row a length; their sums are merged in two rounds, FAN_IN rows to a task in the first. What
    reaches the driver is one row a length, of the size of a model.
    """
    schema = "d int, n long, part int, rows int, low array<long>, high array<long>, planes array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        have: dict[int, list] = {}
        for batch in batches:
            for d, _, x in fixed_points(batch.column(0)):
                for i in range(0, len(x), ROWS):
                    block = x[i : i + ROWS]
                    new = [len(block), gather(d, block), block.min(axis=0), block.max(axis=0)]
                    if old := have.get(d):
                        new = [old[0] + new[0], carried(old[1] + new[1]), np.minimum(old[2], new[2]), np.maximum(old[3], new[3])]
                    have[d] = new
        part = TaskContext.get().partitionId()
        for d, (n, planes, low, high) in have.items():
            yield pa.RecordBatch.from_pydict(
                {"d": pa.array([d], pa.int32()), "n": [n], "part": pa.array([part], pa.int32()), "rows": pa.array([len(planes)], pa.int32()), "low": [low], "high": [high], "planes": [planes.ravel()]}
            )

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        planes = np.sum([carried(np.asarray(p, np.int64).reshape(r, -1)) for p, r in zip(group.planes, group.rows, strict=True)], axis=0)
        low, high = np.min(np.stack(group.low.tolist()), axis=0), np.max(np.stack(group.high.tolist()), axis=0)
        return pd.DataFrame({"d": [group.d[0]], "n": [group.n.sum()], "part": [group.part[0] // FAN_IN], "rows": [group.rows[0]], "low": [low], "high": [high], "planes": [carried(planes).ravel()]})

    parts = vectors.mapInArrow(run, schema)
    once = parts.groupBy("d", F.floor(F.col("part") / FAN_IN)).applyInPandas(lambda _, g: merge(g), schema)
    rows = once.groupBy("d").applyInPandas(merge, schema).collect()
    return {r.d: (r.n, np.array(r.planes, np.int64).reshape(r.rows, -1), list(r.low), list(r.high)) for r in rows}


@dataclass
class Whitener:
    """The fit of the vectors of one length."""

    n: int
    sums: list[int]
    bits: int
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> tuple[list[int | None], np.ndarray]:
        """(squared deviations times n squared, null where a long can't hold them; whitened components, nan where flat)."""
        y = centred(x, self.n, self.sums, self.bits)
        if 2 * self.bits + len(self.sums).bit_length() > 62:
            squares = (y.astype(object) ** 2).sum(axis=1)
            deviation = [int(s) if s < 1 << 63 else None for s in squares]
        else:
            deviation = (y * y).sum(axis=1).tolist()
        with np.errstate(divide="ignore"):
            scale = np.where(self.values > FLAT * len(self.sums) * self.values.max(), 1 / np.sqrt(np.maximum(self.values, 0)), np.nan)
        return deviation, (y.astype(float) / self.n) @ self.vectors * scale

    def explained(self) -> list[float | None]:
        return [float(v / self.trace) if self.trace > 0 else None for v in self.values]


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Whitener]:
    """A fit for each length of the usable vectors in the one column: two passes, one for sums and one for products of what is centred."""
    first = gathered(vectors, lambda d, x: carried(np.stack([p.sum(axis=0).astype(np.int64) for p in [*limbs(x, 62), np.zeros((1, d)), np.zeros((1, d))]])))
    known: dict[int, tuple[int, list[int], int]] = {}
    for d, (n, planes, low, high) in first.items():
        sums = [int(s) for s in joined(planes)]
        widest = max(max(abs(n * a - s), abs(n * b - s)) for a, b, s in zip(low, high, sums, strict=True))
        known[d] = n, sums, widest.bit_length()

    def gather(d: int, x: np.ndarray) -> np.ndarray:
        n, sums, bits = known[d]
        return products(centred(x, n, sums, bits), bits)

    out = {}
    for d, (n, planes, _, _) in gathered(vectors, gather).items():
        exact = joined(planes).reshape(d, d)
        cov = np.array([[int(c) / n**3 for c in row] for row in exact])  # each entry rounded once
        values, rotation = np.linalg.eigh(cov)
        k = min(components, d)
        trace = sum(int(exact[i, i]) for i in range(d)) / n**3
        out[d] = Whitener(n, known[d][1], known[d][2], values[::-1][:k], rotation[:, ::-1][:, :k], trace)
    return out


def whiten(rows: DataFrame, embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(row, n, deviation, component, whitened, explained, identity_error): up to ``components`` rows for each usable row.

    ``row`` is the row without its vector. Vectors that are null or hold null or non-finite entries, or entries whose x
    no long can hold, are dropped; the others are the fit list, copies included. Vectors of different lengths make fit
    lists of their own, and an empty one has no components. A component without variance has a null ``whitened``;
    ``explained`` is null where nothing varies, and ``deviation`` where no long can hold it. ``identity_error`` is worked
    out on the whitened values themselves, over the fit list. An empty table gives no rows.
    """
    spark = rows.sparkSession
    vectors = rows.select(F.col(embedding).cast("array<double>").alias("v"))
    models = fit(vectors, components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, x in fixed_points(batch.column("v")):
                deviation, z = models[d].project(x)
                flat = pa.array(z.ravel(), pa.float64(), from_pandas=True)
                whole = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), flat)
                columns = [batch.column("row").take(pa.array(at)), pa.array([d] * len(at), pa.int32()), pa.array(deviation, pa.int64()), whole]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "d", "deviation", "whitened"])

    rest = F.struct(*[F.col(c) for c in rows.columns if c != embedding], F.lit(0).alias("_"))
    both = rows.select(rest.alias("row"), F.col(embedding).cast("array<double>").alias("v"))
    kind = both.schema["row"].dataType.simpleString()
    done = saved(both.mapInArrow(run, f"row {kind}, d int, deviation long, whitened array<double>"), "whitened")

    k = max((len(m.values) for m in models.values()), default=0)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    moment = lambda i, j: F.covar_pop(F.get("whitened", F.lit(i)), F.get("whitened", F.lit(j)))
    off = [F.abs(moment(i, j) - F.lit(1.0 if i == j else 0.0)) for i, j in pairs]
    worst = F.array_max(F.array(*off)) if off else F.lit(None).cast("double")
    errors = {r.d: r.e for r in done.groupBy("d").agg(worst.alias("e")).collect()}
    facts = [(d, i, m.n, e, errors.get(d)) for d, m in models.items() for i, e in enumerate(m.explained())]
    facts = spark.createDataFrame(facts, "d int, place int, n long, explained double, identity_error double")
    each = done.select("row", "d", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    out = each.join(F.broadcast(facts), ["d", "place"])  # a row for each component of a length
    return out.select("row", "n", "deviation", (F.col("place") + 1).alias("component"), "whitened", "explained", "identity_error")
