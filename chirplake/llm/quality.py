"""Quality by compression: dictionaries of good and of bad texts, and what they save on a text, as a calibrated score."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chirplake.llm.shared import forget, saved

#: Labelled documents of each class to learn from, at most; half make the dictionary, half calibrate.
FIT_ROWS = 4000
#: Bytes of text of each class that a dictionary is built from, at most, of one document, and of a sample of it.
FIT_BYTES, FIT_PER_TEXT, SAMPLE = 8 << 20, 32 << 10, 512
#: Bytes of a dictionary.
DICTIONARY = 112_640
#: Texts are compressed in pieces of so many bytes, so that what came before in a long text doesn't outweigh the dictionary.
PIECE, LEVEL = 1024, 3
THRESHOLD = 0.3


@dataclass
class Classifier:
    """Dictionaries of bad and good texts, and a logistic regression on what they save; none where a class has no texts."""

    dictionaries: list[bytes] = field(default_factory=list)
    mean: np.ndarray = field(default_factory=lambda: np.zeros(5))
    spread: np.ndarray = field(default_factory=lambda: np.ones(5))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(6))

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for data in self.dictionaries:
            known = zstandard.ZstdCompressionDict(data)
            known.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out

    def score(self, sizes: np.ndarray) -> np.ndarray:
        x = (features(sizes) - self.mean) / self.spread
        return 1 / (1 + np.exp(-np.clip(np.column_stack([np.ones(len(x)), x]) @ self.weights, -40, 40)))


def sizes(text: str | None, compressors: list[zstandard.ZstdCompressor]) -> tuple[int, int, int]:
    """Bytes of a whole text, and compressed with the dictionary of bad and of good texts."""
    data = (text or "").encode("utf-8", "surrogatepass")
    pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
    return (len(data), *[sum(len(c.compress(p)) for p in pieces) for c in compressors]) if compressors else (len(data), 0, 0)


def features(measured: np.ndarray) -> np.ndarray:
    """Normalised differences of compressed sizes: bad against good dictionary, and plain against bad; and their products."""
    n, bad, good = measured.T.astype(float)
    between, saving = (bad - good) / np.maximum(bad + good, 1), (n - bad) / np.maximum(n + bad, 1)
    return np.column_stack([between, saving, between**2, saving**2, between * saving])


def excerpt(text: str, seed: int) -> list[bytes]:
    """Samples of a text for a dictionary, from all over it."""
    data = text.encode("utf-8", "surrogatepass")
    parts = [data[i : i + SAMPLE] for i in range(0, len(data), SAMPLE)]
    most = FIT_PER_TEXT // SAMPLE
    return parts if len(parts) <= most else [parts[i] for i in sorted(np.random.RandomState(seed).choice(len(parts), most, replace=False))]


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from samples; where they are too few to train one, the samples themselves, after what marks no header."""
    samples = [s for s in samples if len(s) >= 8]
    order = np.random.RandomState(7).permutation(len(samples))
    kept, total = [], 0
    for i in order:
        if total + len(samples[i]) > FIT_BYTES:
            break
        kept.append(samples[i])
        total += len(samples[i])
    if len(kept) >= 64:
        try:
            return zstandard.train_dictionary(min(DICTIONARY, max(total // 4, 1024)), kept).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"        " + b"".join(kept)[-DICTIONARY:]


def regression(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression, intercept first, with a little weight against steep slopes."""
    a, w = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    ridge = np.diag([1e-4, *[1e-2] * x.shape[1]])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ w)
        w += np.clip(step, -3, 3)
    return w


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = FIT_ROWS) -> Classifier:
    """A classifier from at most ``most`` labelled documents of each class that aren't held out.

    A hash of the text decides whether a document goes into the dictionaries or calibrates, so copies go the same way.
    Dictionaries are trained on the executors, a class a task, from a bounded sample; two dictionaries and three numbers
    for each row of the sample reach the driver. Of an id that repeats the least text counts. Rows without a label, an id or a text, or with labels that contradict
    each other, aren't learned from; where a class is missing every text gets the smoothed share of good labels.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("id"))
    known = known.agg(F.min(label).cast("int").alias("good"), F.max(label).cast("int").alias("top")).where("good = top AND good IN (0, 1)").drop("top")
    order = [F.xxhash64("id"), F.col("id")]
    chosen = known.where("good = 1").orderBy(*order).limit(most).union(known.where("good = 0").orderBy(*order).limit(most))
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).where("text IS NOT NULL")
    part = F.pmod(F.xxhash64("text", F.lit(13)), F.lit(2)).alias("part")
    labelled = texts.join(F.broadcast(chosen), "id").groupBy("id", "good").agg(F.min("text").alias("text"))  # 2 * most rows, also where ids repeat
    sample = saved(labelled.select("id", "good", "text", part), "quality-sample")

    def samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, good, t in zip(*[batch.column(c).to_pylist() for c in ("id", "good", "text")], strict=True):
                cut = excerpt(t, int(i) & 0xFFFF if isinstance(i, int) else 0)
                yield pa.RecordBatch.from_arrays([pa.array([good] * len(cut), pa.int32()), pa.array([str(i)] * len(cut)), pa.array(cut, pa.binary())], names=["good", "id", "cut"])

    def train(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("cut", "ascending")])
        return pa.table({"good": table.column("good")[:1].combine_chunks(), "dictionary": pa.array([dictionary(table.column("cut").to_pylist())], pa.binary())})

    cuts = sample.where("part = 0").mapInArrow(samples, "good int, id string, cut binary")
    made = {r.good: bytes(r.dictionary) for r in cuts.groupBy("good").applyInArrow(train, "good int, dictionary binary").collect()}
    counts = {r.good: r.n for r in sample.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = Classifier([made[0], made[1]] if len(made) == 2 else [])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        for batch in batches:
            got = [sizes(t, compressors) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("good"), *[pa.array([g[i] for g in got], pa.int64()) for i in range(3)]], names=["good", "n", "bad", "fine"])

    seen = sample.where("part = 1").select("good", "text").mapInArrow(measure, "good int, n long, bad long, fine long").toArrow()
    forget(sample)
    y = seen.column("good").to_numpy().astype(float)
    if not model.dictionaries or not len(y) or y.min() == y.max():
        share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
        model.weights[0] = np.log(share / (1 - share))
        return model
    x = features(np.column_stack([seen.column(c).to_numpy() for c in ("n", "bad", "fine")]))
    model.mean, model.spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    model.weights = regression((x - model.mean) / model.spread, y)
    return model


def quality(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """(row, score): each row of ``docs`` as a struct without its text, with its score from 0 to 1, higher for likelier good.

    Whole texts are compressed, in pieces; a null text counts as empty, and an empty one has a score like any other. Rows
    aren't changed, joined or dropped, repeated ones stay, and clashing names of columns don't matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY bytes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = shared.value.compressors()
        for batch in batches:
            measured = np.array([sizes(t, compressors) for t in batch.column("text").to_pylist()]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(shared.value.score(measured), pa.float64())], names=["row", "score"])

    rest = F.struct(*[F.col(c) for c in docs.columns if c != text], F.lit(0).alias("_"))
    rows = docs.select(rest.alias("row"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, score double")
