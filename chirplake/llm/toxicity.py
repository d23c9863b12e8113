"""Toxicity: a learned, weighted lexicon matched by Aho-Corasick in folded text, normalised by length, with exceptions."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chirplake.llm.shared import forget, saved

# Characters that are read as another.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t",
    "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ɡ": "g", "ｏ": "o",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}

#: Labelled rows that the lexicon is learned from, at most, by label: the first in order of a hash of the id.
FIT_TOXIC, FIT_CLEAN = 4000, 8000
STEMS, SKETCHES = range(4, 11), 4
THRESHOLD = 0.3
#: Log-likelihood that a term has to gain over chance.
GAIN = 9.2

#: Inside a word, before a letter that it begins, or after a letter that it ends; the class comes first, as it is rare in texts.
_leet = re.compile(r"[0134578@$!](?:(?<=\w.)(?=\w)|(?<!\w.)(?=[^\W\d])|(?<=[^\W\d][^!])(?!\w))")
_other = re.compile("[^\\W_]+")
_glyphs = str.maketrans(HOMOGLYPHS)
_special = re.compile("[" + "".join(HOMOGLYPHS) + "]")
_marks = re.compile("[\u0300-\u036f]")
_invisible = re.compile("[­​-‏⁠﻿]")


def fold(text: str) -> str:
    """Words of a text in lower case, apart by one space, with homoglyphs and digits in words read as letters.

    Full-width, mathematical and accented letters are their plain ones (NFKD without marks).
    """
    text = text.lower()
    if not text.isascii():
        text = _invisible.sub("", _marks.sub("", unicodedata.normalize("NFKD", text).lower()))
        if _special.search(text):
            text = text.translate(_glyphs)
    text = _leet.sub(lambda m: DIGITS[m[0]], text)
    return " ".join(_other.findall(text))


@dataclass
class Lexicon:
    """Weighted words (``"word "``) and stems (``"stem"``), exceptions (longer words, and phrases around either), and the
    calibration.

    ``rate`` is the weight that a text's matches add up to, per hundred words; the score is logistic in log(1 + rate).
    """

    weights: dict[str, float]
    exceptions: set[str] = field(default_factory=set)
    slope: float = 1.0
    bias: float = 0.0

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for term, w in self.weights.items():
            found.add_word(" " + term, (len(term), w))
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (len(phrase) + 1, 0.0))
        if len(found):
            found.make_automaton()
        return found


def rate(text: str | None, found: ahocorasick.Automaton) -> float:
    """Weight of the longest match at each place, per hundred words; a match inside an exception counts nothing."""
    return folded_rate(fold(text or ""), found)


def folded_rate(folded: str, found: ahocorasick.Automaton) -> float:
    if not folded or not len(found):
        return 0.0
    best: dict[int, tuple[int, float]] = {}
    for end, (length, weight) in found.iter(f" {folded} "):
        start = end - length
        if start not in best or best[start][0] < length:
            best[start] = (length, weight)
    total, clear = 0.0, -1
    for start in sorted(best):
        length, weight = best[start]
        if weight == 0.0:
            clear = max(clear, start + length)
        elif start >= clear:
            total += weight
    return 100.0 * total / (folded.count(" ") + 1 + 10)


def score(rates: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(lexicon.slope * np.log1p(rates) + lexicon.bias, -40, 40)))


def select(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> Lexicon:
    """The lexicon from (term, toxic documents, clean documents); a term ending in a space is a word, else a stem.

    Terms have to be far commoner in toxic documents than chance allows. Of stems that grow from one another the
    longest that keeps the documents stays.
    """
    table = {t: (x, y) for t, x, y in counts}
    share = toxic / max(toxic + clean, 1)
    strong = {}
    for term, (x, y) in table.items():
        n = x + y
        if n < 1 or x / n < 0.5 or not 0 < share < 1:
            continue
        p = min(max(x / n, 1e-9), 1 - 1e-9)
        gain = x * math.log(p / share) + y * math.log((1 - p) / (1 - share))
        if gain > GAIN:
            strong[term] = gain
    chosen: list[str] = []
    for term in sorted((t for t in strong if not any(t[:k] in strong for k in range(min(STEMS), len(t)))), key=lambda t: (-strong[t], t)):
        best = term
        grown = [t for t in strong if t.startswith(term) and t != term]
        for other in sorted(grown, key=len):
            if other.startswith(best) and table[other][0] >= 0.95 * table[best][0]:
                best = other
        chosen.append(best)
    weights = {}
    for term in chosen:
        x, y = table[term]
        weights[term] = math.log((x + 0.5) / (toxic + 1)) - math.log((y + 0.5) / (clean + 1))
    return Lexicon(weights)


def calibrate(lexicon: Lexicon, rates: np.ndarray, labels: np.ndarray) -> Lexicon:
    """Slope and bias of a logistic regression on one feature, with a little weight against steep slopes."""
    if not len(labels) or labels.min() == labels.max():
        mean = float(labels.mean()) if len(labels) else 0.0
        lexicon.slope, lexicon.bias = 1.0, math.log((mean + 0.01) / (1.01 - mean))
        return lexicon
    x = np.column_stack([np.log1p(rates), np.ones(len(rates))])
    w, ridge = np.zeros(2), np.diag([1e-2, 1e-4])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (labels - p) - ridge @ w)
        w += np.clip(step, -3, 3)
    lexicon.slope, lexicon.bias = max(float(w[0]), 0.0), float(w[1])
    return lexicon


def terms(folded: str) -> set[str]:
    out: set[str] = set()
    for word in set(folded.split()):
        out.add(word + " ")
        out.update(word[:k] for k in STEMS if k <= len(word))
    return out


def sketch(folded: str) -> list[int]:
    """Minima of SKETCHES hashes over a text's shingles of five words; near copies share nearly all of them."""
    words = folded.split()
    if not words:
        return []
    shingles = {" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))}
    hashes = np.array([xxhash.xxh64_intdigest(s) for s in shingles], np.uint64)
    return [int((hashes * np.uint64(2 * k + 3) ^ (hashes >> np.uint64(29 + k))).min().view(np.int64)) for k in range(SKETCHES)]


def folded_sample(sample: DataFrame) -> DataFrame:
    """A sample (id, text, toxic) with its texts folded, once for all that is learned from them, and their minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [fold(t or "") for t in batch.column("text").to_pylist()]
            minima = pa.array([sketch(t) for t in texts], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("toxic"), pa.array(texts, pa.string()), minima], names=["id", "toxic", "text", "minima"])

    kinds = ", ".join(f"{c} {sample.schema[c].dataType.simpleString()}" for c in ("id", "toxic"))
    return sample.select("id", "toxic", "text").mapInArrow(run, f"{kinds}, text string, minima array<long>")


def without_copies(sample: DataFrame) -> DataFrame:
    """A folded sample without later copies: else the rare words of one text that was copied many times would look like
    words of toxic texts in general. A row goes if any of its minima is an earlier row's."""
    minima = sample.select("id", F.posexplode("minima").alias("k", "m"))
    first = minima.groupBy("k", "m").agg(F.min("id").alias("first"))
    copies = minima.join(first, ["k", "m"]).where("id > first").select("id").distinct()
    return sample.drop("minima").join(copies, "id", "left_anti")


def phrases(folded: str, lexicon: Lexicon) -> set[str]:
    """Phrases of two and three words of a folded text around each word that the lexicon weighs."""
    words = folded.split()
    stems = {len(t): set() for t in lexicon.weights}
    for t in lexicon.weights:
        stems[len(t)].add(t)
    out: set[str] = set()
    for i, w in enumerate(words):
        if any(f"{w} "[:n] in known for n, known in stems.items()):
            out.update(" ".join(words[a:b]) for a, b in ((i - 1, i + 1), (i, i + 2), (i - 2, i + 1), (i - 1, i + 2), (i, i + 3)) if a >= 0 and b <= len(words))
    return out


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, toxic: int = FIT_TOXIC, clean: int = FIT_CLEAN) -> Lexicon:
    """A lexicon from at most ``toxic`` + ``clean`` labelled documents that aren't held out.

    Document counts of words and stems, and then of the phrases around those that the lexicon has, are made on the executors.
    Longer words and phrases that clean documents have as well are its exceptions. What reaches the driver is the terms that clear the
    bar of :func:`select`, at most in proportion to the bounded sample, and two numbers for each row of the sample.
    Rows without a label or an id, or with labels that contradict each other, aren't learned from.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("top")).where("toxic = top")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("toxic = 1").orderBy(*order).limit(toxic).union(known.where("toxic = 0").orderBy(*order).limit(clean))
    chosen = F.broadcast(chosen.select(F.col("doc_id").alias("id"), "toxic"))  # toxic + clean rows at most
    sample = docs.select(F.col("doc_id").alias("id"), "text").join(chosen, "id").repartition(48, "id")
    labelled = saved(folded_sample(sample), "toxicity-labelled")
    sample = saved(without_copies(labelled).repartition(48, "id"), "toxicity-sample")

    def counted(found: Callable[[str], set[str]]) -> DataFrame:
        """(term, toxic documents, clean documents) of what is found in each text of the sample."""

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, 200):
                    part = batch.slice(i, 200)
                    counts: dict[str, list[int]] = {}
                    for text, label in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True):
                        for term in found(text):
                            counts.setdefault(term, [0, 0])[label] += 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(counts), pa.string()), pa.array([c[1] for c in counts.values()], pa.int64()), pa.array([c[0] for c in counts.values()], pa.int64())],
                        names=["term", "x", "y"],
                    )

        parts = sample.select("text", "toxic").mapInArrow(spread, "term string, x long, y long")
        return parts.groupBy("term").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))

    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = saved(counted(terms).where("x >= 3 OR y >= 3"), "toxicity-terms")
    found = counts.where("x >= 3 and x >= y").collect()
    lexicon = select([(r["term"], r["x"], r["y"]) for r in found], n.get(1, 0), n.get(0, 0))
    share = n.get(1, 0) / max(sum(n.values()), 1)
    benign = (F.col("y") >= 3) & (F.col("x") * (1 - share) < 2 * F.col("y") * share)  # no likelier than others to be in toxic documents
    stems = [s for s in lexicon.weights if not s.endswith(" ")]
    if stems:
        like = counts.where(F.col("term").endswith(" ") & benign & F.substring("term", 1, min(STEMS)).isin(sorted({s[: min(STEMS)] for s in stems})))
        words = [r["term"] for r in like.select("term").collect()]
        lexicon.exceptions = {t.strip() for t in words if any(t.startswith(s) for s in stems) and t not in lexicon.weights}
    if lexicon.weights:
        lexicon.exceptions |= {r["term"] for r in counted(lambda text: phrases(text, lexicon)).where(benign).select("term").collect()}
    automaton = lexicon.automaton()

    def rates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([folded_rate(t, automaton) for t in batch.column("text").to_pylist()], pa.float64())], names=["toxic", "rate"])

    seen = sample.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(rates, "toxic int, rate double").toArrow()
    forget(labelled, sample, counts)
    return calibrate(lexicon, seen.column("rate").to_numpy(), seen.column("toxic").to_numpy().astype(float))


def toxicity(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """(row, score): each row of ``docs`` as a struct with its score from 0 to 1, higher for likelier toxic.

    A text without words scores what a text without matches does; null counts as empty. Whole texts are read; rows
    aren't changed, joined or dropped, whatever their columns are called.
    """
    automaton = lexicon.automaton()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rates = np.array([rate(t, automaton) for t in batch.column("text").to_pylist()], float)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(score(rates, lexicon))], names=["row", "score"])

    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, score double")
