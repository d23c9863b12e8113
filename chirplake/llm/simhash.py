"""SimHash near-dedup: segment popcounts, a grid range-join under Manhattan distance, exact verification."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chirplake.llm.shared import Forest, by_cell, components, few, forget, hot_cells, runs, saved

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Segments of two bits, dealt to three grids: fingerprints at Manhattan distance 4 or less are at 1 or less in one.
GRIDS = [list(range(0, 11)), list(range(11, 22)), list(range(22, 32))]
SLICE = 1 << 16

#: Similar texts: words of a shingle, the similarity as a fraction, bits that fingerprints of 128 bits may differ in, the
#: share of pairs at that similarity that have to meet in a grid, and pairs that a node may have by chance in its cells.
SIMILAR_SHINGLE, UPPER, LOWER = 5, 4, 5
WIDE_SEGMENTS, WIDE_DISTANCE, MEET, BY_CHANCE = 64, 32, 0.95, 400_000
#: 64-bit words of the parity sketch of a set; pairs of sets that are bounded at once.
SKETCH, BLOCK = 16, 1 << 15


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each word shingle of a text, repeats included.

    Words are runs of anything but ASCII white space, with A-Z in lower case. Fewer words than a shingle has make one.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(found)) - 1
    h = xxhash.xxh64_intdigest
    return np.array([h(line[a:b], SEED) for a, b in zip(starts[: len(found) - k].tolist(), ends[k:].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are those that more than half of the hashes have; 0 without hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), SLICE):
        ones += np.unpackbits(hashes[i : i + SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned SimHash of a text's word shingles, repeats included; 0 if it has no words."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, fp): each row of ``docs`` as a struct without its text, and its fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(prints, pa.int64())], names=["row", "fp"])

    rest = F.struct(*[F.col(c) for c in docs.columns if c != text]) if len(docs.columns) > 1 else F.struct(F.lit(0).alias("none"))
    rows = docs.select(rest.alias("row"), F.col(text).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, fp long")


# the grid range-join


def popcounts(prints: np.ndarray) -> np.ndarray:
    """Ones in each two-bit segment: one row of small counts for each fingerprint, a row of 64-bit words."""
    x = prints.view(np.uint64).reshape(len(prints), -1)
    pairs = (x & np.uint64(0x5555555555555555)) + ((x >> np.uint64(1)) & np.uint64(0x5555555555555555))
    shifts = np.arange(0, 64, 2, dtype=np.uint64)
    return ((pairs[:, :, None] >> shifts) & np.uint64(3)).astype(np.int64).reshape(len(x), 32 * x.shape[1])


def grid_rows(grids: list[list[int]], words: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each fingerprint at home in its cell of each grid, and as a guest in the cells one step up.

    A grid is a list of segments; ``words`` are the columns of a fingerprint. Of two cells at distance 1 one is a step
    up from the other, so each range probe is made from one side only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = popcounts(np.column_stack([batch.column(w).to_numpy() for w in words]))
            cells, which, home = [], [], []
            for g, segments in enumerate(grids):
                own = counts[:, segments]
                powers = 3 ** np.arange(len(segments), dtype=np.int64) * len(grids)
                at = own @ powers + g
                cells.append(at), which.append(np.arange(len(at))), home.append(np.ones(len(at), bool))
                row, dim = np.nonzero(own < 2)
                cells.append(at[row] + powers[dim]), which.append(row), home.append(np.zeros(len(row), bool))
            carried = [batch.column(i).take(pa.array(np.concatenate(which))) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells)), *carried, pa.array(np.concatenate(home))], names=["cell", *batch.schema.names, "home"])

    return run


def searcher(words: list[str], distance: int, sized: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Links that span what a Hamming distance connects among the rows of each cell.

    ``sized``: of two rows the sizes ``n`` may differ as much as UPPER / LOWER allows; hosts are in order of size, so that
    only those are looked at.
    """

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        order = ["cell", "lo", "hi", "home", *(["n"] if sized else [])]
        rows = rows.sort_values(order, ascending=[c != "home" for c in order], kind="stable")
        cell, lo, hi, part, home = (rows[c].to_numpy() for c in ("cell", "lo", "hi", "part", "home"))
        nodes, at = np.unique(rows["node"].to_numpy(), return_inverse=True)
        bits = [rows[w].to_numpy().view(np.uint64) for w in words]
        starts, ends = runs(cell, lo, hi)
        run = np.repeat(np.arange(len(starts)), ends - starts)
        n = rows["n"].to_numpy(np.int64) if sized else np.zeros(len(rows), np.int64)
        hosts = np.flatnonzero(home)
        key = run[hosts] << 32 | n[hosts]
        first = np.searchsorted(key, run << 32 | -(-UPPER * n // LOWER))
        last = np.searchsorted(key, run << 32 | LOWER * n // UPPER, side="right")
        last[hosts] = np.minimum(last[hosts], np.arange(len(hosts)))  # of two rows at home the later one looks
        forest, row, whole = Forest(len(nodes)), np.flatnonzero(first < last), lo == hi
        held_a, held_b, held = [], [], 0
        for k in range(int((last - first).max(initial=0))):
            row = row[first[row] + k < last[row]]
            host = hosts[first[row] + k]
            apart = sum(np.bitwise_count(b[row] ^ b[host]) for b in bits)
            near = apart <= distance
            a, b = row[near], host[near]
            fit = whole[a] | (part[a] != part[b])
            a, b = at[a[fit]], at[b[fit]]
            new = forest.label[a] != forest.label[b]
            if new.any():
                held_a.append(a[new]), held_b.append(b[new])
                held += int(new.sum())
            if held > 100_000:
                forest.add(np.concatenate(held_a), np.concatenate(held_b))
                held_a, held_b, held = [], [], 0
        if held:
            forest.add(np.concatenate(held_a), np.concatenate(held_b))
        a, b = forest.links()
        return pd.DataFrame({"a": nodes[a], "b": nodes[b]})

    return search


def range_join(nodes: DataFrame, grids: list[list[int]], words: list[str], distance: int, sized: bool = False) -> DataFrame:
    """Links (a, b) that span what the distance connects of ``nodes`` (saved: node, words, n if sized), over all grids."""
    columns = list(dict.fromkeys(["node", *words, *(["n"] if sized else [])]))
    kinds = ", ".join(f"{c} {nodes.schema[c].dataType.simpleString()}" for c in columns)
    rows = nodes.select(*columns).mapInArrow(grid_rows(grids, words), f"cell long, {kinds}, home boolean")
    n, guests = nodes.count(), sum(1 + len(g) * 3 // 4 for g in grids)
    tasks = max(min(512, 8 + n // 16), n * guests // 40_000)
    return by_cell(rows, hot_cells(rows), searcher(words, distance, sized), "a long, b long", tasks)


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(row, fp, component_id): rows of ``docs`` as structs without their text, with fingerprint and component.

    Documents link where their fingerprints differ in at most DISTANCE bits; component_id is the least doc_id that links
    reach. Exact copies share a fingerprint and meet once, as one node. The distinct fingerprints are joined over three
    grids of segment popcounts, whose Manhattan distance never exceeds the Hamming distance; a task returns links that
    span what it found, so a group of n near copies yields fewer than n links for each grid, not n * n.

    Empty and null texts have fingerprint 0 and link like others. Rows with a null id take part; their component_id is
    the least id reached, null if there is none. Repeated rows come back as often as they come. Empty in, empty out.
    """
    marked = saved(fingerprints(docs, text), "simhash")
    nodes = saved(marked.groupBy(F.col("fp").alias("node")).agg(F.min(f"row.{doc_id}").alias("id")), "simhash-nodes")
    roots = components(range_join(nodes, GRIDS, ["node"], DISTANCE))
    joined = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = saved(joined.groupBy("root").agg(F.min("id").alias("component_id")).join(joined.select("root", "node"), "root").select("node", "component_id"), "simhash-components")
    forget(nodes)
    return marked.join(least.withColumnRenamed("node", "fp"), "fp").select("row", "fp", "component_id")


def hex16(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# similar texts: the same join on wider fingerprints, verified on the sets of shingles


def wide_grids(n: int) -> list[list[int]]:
    """Grids for ``n`` nodes: segments enough to leave each node BY_CHANCE pairs, grids enough that of pairs at the
    similarity a share of MEET are at distance 1 or less in one of them."""
    angle = math.acos(2 * UPPER / (UPPER + LOWER)) / math.pi  # of sets of one size: the share of bits that differ
    same, step = (1 - angle) ** 2 + angle**2 / 2, 2 * angle * (1 - angle)
    s = 8
    while True:
        meet = same**s + s * step * same ** (s - 1)
        grids = max(1, round(math.log(1 - MEET) / math.log(1 - meet)))
        chance = 0.375**s + s * 0.5 * 0.375 ** (s - 1)
        if n * grids * chance <= BY_CHANCE or s == 24:
            break
        s += 1
    rng, out, left = np.random.default_rng(0), [], []
    for _ in range(grids):  # segments stand in one grid each, as far as they go
        if len(left) < s:
            left = rng.permutation(WIDE_SEGMENTS).tolist()
        out.append(sorted(left[:s]))
        left = left[s:]
    return out


def wide(hashes: np.ndarray) -> tuple[int, int]:
    """The SimHash of 128 bits of a set of hashes: of the hashes, and of the hashes mixed."""
    mixed = (hashes ^ hashes >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return majority(hashes), majority(mixed ^ mixed >> np.uint64(29))


def wide_fingerprints(docs: DataFrame, text: str) -> DataFrame:
    """(row, node, n, f0, f1): each row as a struct without its text, with a hash of its set of shingles, their number and
    their fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, SIMILAR_SHINGLE)) for t in batch.column("text").to_pylist()]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            prints = np.array([wide(s) for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
            size = pa.array([len(s) for s in sets], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(node), size, pa.array(prints[:, 0]), pa.array(prints[:, 1])], names=["row", "node", "n", "f0", "f1"])

    rest = F.struct(*[F.col(c) for c in docs.columns if c != text])
    rows = docs.select(rest.alias("row"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, node long, n int, f0 long, f1 long")


def sketch(found: np.ndarray) -> np.ndarray:
    """Parities of a set's hashes over buckets: two sketches never differ in more bits than their sets in hashes."""
    odd = np.bincount((found % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(a) + len(b) - len(np.union1d(a, b))
    return (UPPER + LOWER) * shared >= UPPER * (len(a) + len(b))


def verify(rows: pd.DataFrame) -> pd.DataFrame:
    """Links that span what similar sets connect among the rows of each cell: bounds on sizes and sketches, then the sets."""
    rows = rows.assign(n=[len(x) // 8 for x in rows["set"]]).sort_values(["cell", "lo", "hi", "n", "node"], kind="stable")
    cell, lo, hi, part, n = (rows[c].to_numpy() for c in ("cell", "lo", "hi", "part", "n"))
    nodes, one, at = np.unique(rows["node"].to_numpy(), return_index=True, return_inverse=True)
    data = rows["set"].to_numpy()
    sets = [np.frombuffer(data[i], np.uint64) for i in one]
    sketches = np.array([sketch(s) for s in sets], np.uint64).reshape(-1, SKETCH)
    forest = Forest(len(nodes))
    for start, end in zip(*runs(cell, lo, hi), strict=True):
        whole = lo[start] == hi[start]
        for i in range(start, end - 1):
            last = i + 1 + int(np.searchsorted(n[i + 1 : end], LOWER * n[i] // UPPER, side="right"))
            for begin in range(i + 1, last, BLOCK):
                j = np.arange(begin, min(begin + BLOCK, last))
                fit = forest.label[at[j]] != forest.label[at[i]]
                if not whole:
                    fit &= part[j] != part[i]
                j = j[fit]
                apart = np.bitwise_count(sketches[at[j]] ^ sketches[at[i]]).sum(axis=1, dtype=np.int64)
                for k in at[j[(UPPER + LOWER) * apart <= (LOWER - UPPER) * (n[j] + n[i])]].tolist():
                    x, y = forest.label[at[i]], forest.label[k]
                    if x != y and similar(sets[at[i]], sets[k]):
                        forest.label[forest.label == max(x, y)] = min(x, y)
    a, b = forest.links()
    return pd.DataFrame({"a": nodes[a], "b": nodes[b]})


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(cell, node, set): the set of shingles, as bytes, in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, SIMILAR_SHINGLE)).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("cell"), batch.column("node"), pa.array(sets, pa.binary())], names=["cell", "node", "set"])

    return texts.select("cell", "node", "text").mapInArrow(run, "cell long, node long, set binary")


def similar_documents(docs: DataFrame, text: str = "text", marks: tuple[str, ...] = ("h", "g")) -> DataFrame:
    """(row, root): rows of ``docs`` as structs without their text, with the group that they are in.

    Documents link where the Jaccard similarity of their sets of five-word shingles is UPPER / LOWER or more; a group is
    what links connect, and ``root`` a hash that its rows share, whatever their ids. Candidates come from SimHash: the
    distinct sets' fingerprints of 128 bits meet over grids of segment popcounts at Manhattan distance 1 or less, and
    are candidates at a Hamming distance of WIDE_DISTANCE or less if their sizes allow the similarity. All that candidates
    connect is then compared on the whole sets, so nothing links below the similarity; a pair above it can be missed
    only where no chain of candidates connects it (the README has the measured share).

    ``marks`` are columns that tell rows apart by a hash of each, by which texts of candidates are found again. Texts
    without words, null among them, have equal sets. Repeated rows come back as often as they come. Empty in, empty out.
    """
    marked = saved(wide_fingerprints(docs, text), "similar")
    least = F.min(F.struct(*[F.col(f"row.{m}") for m in marks])).alias("one")
    nodes = saved(marked.groupBy("node").agg(F.first("n").alias("n"), F.first("f0").alias("f0"), F.first("f1").alias("f1"), least), "similar-nodes")
    met = components(range_join(nodes, wide_grids(nodes.count()), ["f0", "f1"], WIDE_DISTANCE, sized=True))
    some = saved(nodes.join(met, "node").select("node", "n", "one.*", F.col("root").alias("cell")), "similar-candidates")
    forget(nodes)
    sizes = some.agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).first()
    texts = docs.select(*marks, F.col(text).alias("text"))
    if sizes["rows"] > 500_000:  # rows that are alike are one before the join, so that none of any number meets it
        texts = texts.groupBy(*marks).agg(F.first("text").alias("text")).join(some, list(marks))
    else:
        texts = texts.join(F.broadcast(some), list(marks)).groupBy(*marks, "cell", "node").agg(F.first("text").alias("text"))
    tasks = max(min(256, 8 + sizes["rows"] // 16), (sizes["n"] or 0) // 1_000_000)
    links = by_cell(shingle_sets(texts), hot_cells(some, weight="n"), verify, "a long, b long", tasks)
    roots = components(links)
    return marked.select("row", "node").join(roots, "node", "left").select("row", F.coalesce("root", "node").alias("root"))
