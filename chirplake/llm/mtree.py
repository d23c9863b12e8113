"""Exact top-k by inner product: M-trees of paged nodes, searched best first under triangle-inequality bounds."""

from __future__ import annotations

import heapq
import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chirplake.llm.shared import saved

#: Rows of a tree and queries of a block, at most; trees and blocks of a small table; entries of a page.
TREE, QUERIES, SPREAD, PAGE = 32_768, 16_384, 8, 128
TOP, EVERY = 5, 50


class MTree:
    """Vectors in a metric space, on pages.

    Inner products order like distances once each vector has one more component, the root of the largest square norm
    less its own (a query has 0 there). A node has a routing object, a covering radius and the distance to its parent's
    routing object; a leaf entry has the distance to its own. Node 0 is the root.
    """

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, ids: np.ndarray, ints: np.ndarray) -> MTree:
        x = ints.astype(np.float64)
        square = (x * x).sum(axis=1)
        most = square.max(initial=0.0)
        x = np.hstack([x, np.sqrt(np.maximum(most - square, 0))[:, None]])
        rng = np.random.default_rng(0)
        order, entry = np.empty(len(ids), np.int64), np.empty(len(ids))
        router, radius, up, leaf, start, stop = [], [], [], [], [], []

        def apart(rows: np.ndarray, one: int) -> np.ndarray:
            return np.sqrt(((x[rows] - x[one]) ** 2).sum(axis=1))

        waiting, used = [(np.arange(len(ids)), 0, 0.0)] if len(ids) else [], 0
        nodes = 0
        while nodes < len(waiting):  # breadth first: a node's children stand together
            rows, one, parent = waiting[nodes]
            nodes += 1
            far = apart(rows, one)
            router.append(one), radius.append(far.max()), up.append(parent)
            leaf.append(len(rows) <= PAGE)
            if leaf[-1]:
                order[used : used + len(rows)], entry[used : used + len(rows)] = rows, far
                start.append(used), stop.append(used := used + len(rows))
                continue
            k = min(PAGE, -(-len(rows) // (PAGE // 2)))
            seeds = rng.choice(rows, k, replace=False)
            gaps = (x[rows] ** 2).sum(axis=1)[:, None] - 2 * x[rows] @ x[seeds].T + (x[seeds] ** 2).sum(axis=1)
            nearest = gaps.argmin(axis=1)
            groups = [(rows[nearest == j], seeds[j]) for j in range(k)]
            groups = [(g, s) for g, s in groups if len(g)]
            if len(groups) == 1:  # nothing to tell them apart
                groups = [(g, g[0]) for g in np.array_split(rows, k)]
            start.append(len(waiting)), stop.append(len(waiting) + len(groups))
            waiting += [(g, s, float(apart(np.array([s]), one)[0])) for g, s in groups]
        arrays = {"ids": ids[order], "ints": ints[order], "points": x, "entry": entry, "most": np.array(most)}
        arrays |= {k: np.array(v, t) for k, v, t in (("router", router, np.int64), ("radius", radius, float), ("up", up, float), ("leaf", leaf, bool), ("start", start, np.int64), ("stop", stop, np.int64))}
        arrays["routing"] = x[arrays["router"]]
        del arrays["points"]
        return cls(arrays)

    def to_bytes(self) -> bytes:
        np.savez(out := io.BytesIO(), **self.__dict__)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> MTree:
        return cls(dict(np.load(io.BytesIO(data))))

    def search(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(score, id) of the k best rows but those of ``query_id``, best first, ties to smaller ids."""
        if not len(self.router):
            return []
        q = np.append(query.astype(np.float64), 0.0)
        whole, flat = query.astype(np.int64), q[:-1]
        reach = float(flat @ flat) + float(self.most)
        slack = 1e-7 * (1.0 + reach) ** 0.5  # above the rounding of the added component at any norm
        best: list[tuple[int, int]] = []  # a heap of (score, -id), the worst on top
        limit = np.inf
        d = float(np.sqrt(((q - self.routing[0]) ** 2).sum()))
        heap = [(max(0.0, d - self.radius[0]), 0, d)]
        while heap:
            bound, node, d = heapq.heappop(heap)
            if bound > limit + slack:
                break
            part = slice(self.start[node], self.stop[node])
            if self.leaf[node]:
                rows = np.flatnonzero(np.abs(d - self.entry[part]) <= limit + slack) + self.start[node]
                scores, ids = self.ints[rows] @ whole, self.ids[rows]
                hope = np.flatnonzero((ids != query_id) & (scores >= (best[0][0] if len(best) == k else -np.inf)))
                for s, i in zip(scores[hope].tolist(), ids[hope].tolist(), strict=True):
                    if len(best) < k:
                        heapq.heappush(best, (s, -i))
                    elif (s, -i) > best[0]:
                        heapq.heapreplace(best, (s, -i))
                if len(best) == k:
                    limit = max(0.0, reach - 2.0 * best[0][0]) ** 0.5
                continue
            children = np.arange(part.start, part.stop)
            children = children[np.abs(d - self.up[children]) - self.radius[children] <= limit + slack]
            away = np.sqrt(((self.routing[children] - q) ** 2).sum(axis=1))
            bounds = np.maximum(away - self.radius[children], 0.0)
            for b, c, a in zip(bounds.tolist(), children.tolist(), away.tolist(), strict=True):
                if b <= limit + slack:
                    heapq.heappush(heap, (b, c, a))
        return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1]))


def stack(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return rows["id"].to_numpy(np.int64), np.array(rows["ints"].tolist(), np.int64).reshape(len(rows), -1)


def top_products(table: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", every: int = EVERY, top: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``, the ``top`` best others.

    A component x counts as floor(256 x). All vectors go into M-trees of about TREE rows each, which are written as a
    table; each block of queries meets each tree once, takes its ``top`` best there, and the best of those are the
    answer. Trees and blocks have a size of their own at any size of the table, and what travels is a tree and a block for
    each meeting: it grows with rows times queries, over TREE and over QUERIES.

    Vectors that are null, empty, or hold null or non-finite components take no part, nor do rows with a null id. The
    others meet those of their own length only. Rows of the query's id are its own; repeated rows of other ids are
    candidates as often as they come, and repeated queries are one. Fewer than ``top`` others: all of them. Empty in,
    empty out. A square norm of 2 to the power 62 or more is an error, as scores wouldn't be exact.
    """
    finite = lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))
    ints = F.transform(F.col(vector), lambda x: F.floor(256 * x.cast("double")))
    good = F.col(vec_id).isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False)) & (F.size(vector) > 0)
    x = table.where(good).select(F.col(vec_id).cast("long").alias("id"), ints.alias("ints"))
    x = saved(x.withColumn("dims", F.size("ints")), "mtree-rows")
    square = F.aggregate("ints", F.lit(0.0), lambda s, v: s + v.cast("double") * v)
    rows, most = x.agg(F.count(F.lit(1)), F.max(square)).first()
    if most and most >= 2.0**62:
        raise ValueError("vectors are too long for exact scores")
    queries = x.where(F.pmod("id", F.lit(every)) == 0).distinct()
    several = lambda n, most, least: max(1, -(-n // most), min(SPREAD, n // max(1, least)))
    n_trees, n_blocks = several(rows, TREE, TREE // SPREAD), several(queries.count(), QUERIES, QUERIES // SPREAD // SPREAD)

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"dims": [key[0]], "tree": [key[1]], "pages": [MTree.build(*stack(rows)).to_bytes()]})

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ids, values = stack(rows)
        return pd.DataFrame({"dims": [key[0]], "block": [key[1]], "ids": [ids.tobytes()], "vectors": [values.tobytes()]})

    def meet(key: tuple, trees: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out = []
        for pages in trees["pages"]:
            tree = MTree.from_bytes(pages)
            for ids, vectors in zip(blocks["ids"], blocks["vectors"], strict=True):
                for i, v in zip(np.frombuffer(ids, np.int64).tolist(), np.frombuffer(vectors, np.int64).reshape(-1, key[0]), strict=True):
                    out += [(i, v.tobytes(), other, score) for score, other in tree.search(i, v, top)]
        return pd.DataFrame(out, columns=["query_id", "own", "vec_id", "score"])

    deal = lambda n, salt: F.pmod(F.xxhash64("id", "ints", F.monotonically_increasing_id() if salt == 1 else F.lit(salt)), F.lit(n)).cast("int")
    trees = saved(x.groupBy("dims", deal(n_trees, 1).alias("tree")).applyInPandas(build, "dims int, tree int, pages binary"), "mtree-pages")
    blocks = saved(queries.groupBy("dims", deal(n_blocks, 2).alias("block")).applyInPandas(pack, "dims int, block int, ids binary, vectors binary"), "mtree-queries")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = trees.withColumn("block", numbers(n_blocks)).groupBy("dims", "tree", "block")
    right = blocks.withColumn("tree", numbers(n_trees)).groupBy("dims", "tree", "block")
    met = left.cogroup(right).applyInPandas(meet, "query_id long, own binary, vec_id long, score long")
    best = Window.partitionBy("query_id", "own").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
