import numpy as np
import pytest
from pyspark.sql import functions as F

from chirplake.llm import itq, mtree

INF, NAN = float("inf"), float("nan")
SCHEMA = "vec_id long, embedding array<float>, label int, id string, vector string, dims string, row string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, l, "i", "v", "d", "r") for i, v, l in rows], SCHEMA)


def clustered(n, dims, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dims))
    x = centres[rng.integers(0, 40, n)] + rng.normal(size=(n, dims)) * rng.choice([0.05, 0.25, 0.4, 1.0], (n, 1))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


@pytest.mark.parametrize("n,dims,page", [(700, 16, 8), (400, 64, 128), (60, 3, 4)])
def test_top_products(spark, monkeypatch, n, dims, page):
    monkeypatch.setattr(mtree, "TREE", 200), monkeypatch.setattr(mtree, "PAGE", page), monkeypatch.setattr(mtree, "QUERIES", 5)
    x = clustered(n, dims)
    x[n // 2] = x[0]
    df = table(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)])
    got = {}
    for r in mtree.top_products(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    ints = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    want = {}
    for q in range(0, n, 50):
        s = ints @ ints[q]
        want[q] = [(int(i), int(s[i])) for i in sorted((i for i in range(n) if i != q), key=lambda i: (-s[i], i))[:5]]
    assert got == want


def test_search_skips_pages():
    """Bounds of a clustered tree leave most pages unread, and lose nothing."""
    rng = np.random.default_rng(1)
    x = np.repeat(rng.integers(-200, 200, (60, 8)), 50, axis=0) + rng.integers(-2, 3, (3000, 8))
    tree = mtree.MTree.from_bytes(mtree.MTree.build(np.arange(3000), x).to_bytes())
    assert sorted(tree.ids.tolist()) == list(range(3000))
    for q in range(0, 3000, 300):
        s = x @ x[q]
        best = sorted((i for i in range(3000) if i != q), key=lambda i: (-s[i], i))[:5]
        assert tree.search(q, x[q], 5) == [(int(s[i]), i) for i in best]
    same = mtree.MTree.build(np.arange(1000), np.ones((1000, 4), np.int64))
    assert same.search(0, np.ones(4, np.int64), 3) == [(4, 1), (4, 2), (4, 3)]


def test_top_products_hard_rows(spark):
    good = [1.0, 2.0]
    rows = [(0, good, 1), (0, good, 1), (1, None, 1), (2, [], 1), (3, [1.0, None], 1), (4, [NAN, 1.0], 1), (5, [INF, 1.0], 1), (6, [0.0, 0.0], 1), (7, [1.0], 1), (None, good, 1), (8, good, None)]
    got = [(r.query_id, r.vec_id, r["rank"]) for r in mtree.top_products(table(spark, rows)).orderBy("rank").collect()]
    assert got == [(0, 8, 1), (0, 6, 2)]
    again = [(50, good, 1), (50, good, 1), (1, good, 1), (1, good, 1), (2, [0.5, 0.5], 1)]  # rows of one id are rows
    got = [(r.query_id, r.vec_id, r["rank"]) for r in mtree.top_products(table(spark, again)).orderBy("rank").collect()]
    assert got == [(50, 1, 1), (50, 1, 2), (50, 2, 3)]
    with pytest.raises(ValueError):
        mtree.top_products(table(spark, [(50, [1e8, 1e8], 1)]))
    assert mtree.top_products(table(spark, rows).limit(0)).count() == 0
    assert mtree.top_products(table(spark, [(50, None, 1)])).count() == 0


def brute_links(x, labels):
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    links = (y @ y.T >= itq.COSINE) & (labels[:, None] == labels)
    np.fill_diagonal(links, False)
    return links


def groups(links):
    own = np.arange(len(links))
    while True:
        new = np.array([min(own[i], own[np.flatnonzero(r)].min(initial=own[i])) for i, r in enumerate(links)])
        if (new == own).all():
            return own
        own = new


def test_cells_grow_with_the_rows():
    shapes = [itq.shape(n) for n in (0, 10**6, 10**8, 10**10)]
    assert shapes[0] == (8, 8) and all(a < b for a, b in zip(shapes[1:], shapes[2:], strict=False))
    assert all(n / 2**bits <= itq.CELL_ROWS for n, (_, bits) in zip((10**6, 10**8, 10**10), shapes[1:], strict=True))


@pytest.mark.parametrize("dims,chunk,cell_rows", [(64, 2048, 4096), (64, 20, 4096), (6, 2048, 1), (64, 2048, 0.01)])
def test_near_vectors(spark, monkeypatch, dims, chunk, cell_rows):
    from chirplake.llm import shared

    monkeypatch.setattr(itq, "hot_cells", lambda cells: shared.hot_cells(cells, chunk))
    monkeypatch.setattr(itq, "CELL_ROWS", cell_rows)
    x = clustered(900, dims, 3)
    x[100:130] = x[50]
    labels = np.arange(900) % 3
    labels[100:130] = labels[50]
    links = brute_links(x, labels)
    df = table(spark, [(i, v.tolist(), int(l)) for i, (v, l) in enumerate(zip(x, labels, strict=True))]).repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in itq.near_vectors(df).select("row.vec_id", "n_links", "component_id").collect()}
    n = np.array([got[i][0] for i in range(900)])
    assert (n <= links.sum(axis=1)).all()  # none below the threshold
    assert n.sum() / links.sum() >= 0.97  # recall of links
    own = groups(links)
    assert np.mean([got[i][1] == own[i] for i in range(900)]) >= 0.97


def test_every_length_has_a_rotation(spark, monkeypatch):
    """Vectors of twelve lengths, however few of each: all learned, none linked with another length, recall as for one."""
    monkeypatch.setattr(itq, "CODED", 16)
    rows, expected = [], {}
    for dims in range(8, 20):
        x, first = clustered(60 + dims, dims, dims), len(rows)
        links = brute_links(x, np.zeros(len(x), int))
        expected |= {first + i: int(n) for i, n in enumerate(links.sum(axis=1))}
        rows += [(first + i, v.tolist(), 1) for i, v in enumerate(x)]
    met = []
    plain = itq.fitted
    monkeypatch.setattr(itq, "fitted", lambda *a: met.append(plain(*a)) or met[-1])
    df = table(spark, rows).repartition(3)
    found = itq.near_vectors(df).select("row.vec_id", "n_links").collect()
    got = {r.vec_id: r.n_links for r in found}
    assert all(got[i] <= n for i, n in expected.items()) and sum(got.values()) >= 0.97 * sum(expected.values()) > 0
    assert len(met) == 1 and set(met[0].columns) == {"dims", "centre", "directions"}


@pytest.mark.parametrize("sample", [7, 1000])
def test_rotations_are_learned_where_the_samples_are(spark, sample):
    """A length's model is that of its first vectors in order of their hashes."""
    x = [v.astype(np.float64).tolist() for dims in (5, 9) for v in clustered(90, dims, dims)]
    df = spark.createDataFrame([(len(v), v, 1) for v in x], "dims int, vector array<double>, label long").withColumn("n", F.lit(90).cast("long"))
    order = {d: [r.vector for r in df.where(F.col("dims") == d).orderBy(F.xxhash64("vector")).limit(sample).collect()] for d in (5, 9)}
    got = {r.dims: r for r in itq.fitted(df.repartition(4), sample, 16).collect()}
    for d, vectors in order.items():
        y = np.array(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
        centre, directions = itq.learn(y, 16)
        assert np.allclose(np.frombuffer(got[d].centre), centre) and np.allclose(np.frombuffer(got[d].directions).reshape(d, 16), directions)


@pytest.mark.parametrize("apart", [0.001, 0.005])
def test_links_on_both_sides_of_the_threshold(spark, apart):
    """Pairs at cosines just above and just below: the upper ones link, the lower ones don't."""
    rng, rows, linked = np.random.default_rng(11), [], set()
    for k in range(150):
        u, v = np.linalg.qr(rng.normal(size=(48, 2)))[0].T
        c = itq.COSINE + apart * (1 if k % 2 else -1)
        rows += [(2 * k, u.tolist(), 0), (2 * k + 1, (c * u + np.sqrt(1 - c * c) * v).tolist(), 0)]
        linked |= {2 * k, 2 * k + 1} if k % 2 else set()
    got = {r.vec_id for r in itq.near_vectors(table(spark, rows)).where("n_links > 0").select("row.vec_id").collect()}
    assert got <= linked and len(got) >= 0.9 * len(linked)


def test_near_vectors_hard_rows(spark):
    v = [0.6, 0.8, 0.0]
    rows = [(5, v, 1), (3, [1.2, 1.6, 0.0], 1), (9, v, 2), (8, v, None), (1, None, 1), (2, [0.0, 0.0, 0.0], 1), (4, [NAN, 1.0, 1.0], 1), (6, [1.0, None, 1.0], 1), (7, [INF, 0.0, 0.0], 1), (10, [], 1), (None, v, 1), (5, v, 1), (11, [0.6, 0.8], 1)]
    got = sorted((r.vec_id or -1, r.n_links, r.component_id) for r in itq.near_vectors(table(spark, rows)).select("row.vec_id", "n_links", "component_id").collect())
    assert got == sorted([(5, 3, 3), (5, 3, 3), (-1, 3, 3), (3, 3, 3), (9, 0, 9), (8, 0, 8), (1, 0, 1), (2, 0, 2), (4, 0, 4), (6, 0, 6), (7, 0, 7), (10, 0, 10), (11, 0, 11)])
    assert itq.near_vectors(table(spark, rows).limit(0)).count() == 0
    assert itq.near_vectors(table(spark, [(1, None, 1)])).select("n_links").first()[0] == 0


def test_components_of_long_chains(spark):
    from chirplake.llm.shared import components

    n = 300
    pairs = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000 + i, 1000) for i in range(50)] + [(7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(pairs.orderBy(F.rand(1))).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, **{1000 + i: 1000 for i in range(50)}}
