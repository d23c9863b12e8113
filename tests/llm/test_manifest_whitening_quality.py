"""Merkle manifests, whitening and compression quality against plain versions."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from chirplake.llm import merkle, quality, whitening

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    texts = [None if v is None else str(v) for v in row]
    return sha("".join("-" if t is None else f"{len(t.encode())}:{t}" for t in texts))


def plain_tree(leaves):
    """(root, a list of (before, after) for each leaf)."""
    proofs, owners, level = [[] for _ in leaves], [[i] for i in range(len(leaves))], list(leaves)
    while len(level) > 1:
        after, owned = [], []
        for i in range(0, len(level), 3):
            run = level[i : i + 3]
            for k in range(len(run)):
                for leaf in owners[i + k]:
                    proofs[leaf].append((run[:k], run[k + 1 :]))
            after.append(sha("".join(run)))
            owned.append([x for o in owners[i : i + 3] for x in o])
        level, owners = after, owned
    return level[0], proofs


def plain_manifest(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for source in order:
        own = sorted(groups[source], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees.append((own, *plain_tree([plain_leaf(r) for r in own])))
    root, tops = plain_tree([t[1] for t in trees])
    out = []
    for (own, subroot, proofs), upper in zip(trees, tops, strict=True):
        for row, proof in zip(own, proofs, strict=True):
            whole = proof + upper
            at = plain_leaf(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
                at = plain_leaf((*row[:4], row[4].replace("\n", "")))
            for left, right in whole:
                at = sha("".join([*left, at, *right]))
            digests = "".join("".join(left + right) for left, right in whole)
            out.append((row[0], plain_leaf(row), subroot, root, sha(digests), at, at == root))
    return sorted(out, key=str)


def proved(spark, rows, folder):
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    got = entry.queries()["op11_merkle_manifest"](spark, str(folder)).collect()
    return sorted((tuple(r) for r in got), key=str)


def test_manifest_hard_rows(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "b", "é", "", None]), "en", 3, rng.choice(["x\ny", "", "é" * 40000 + "\n", "plain", None])) for i in range(60)]
    rows += [(100, "lone", None, None, None), (None, "a", "en", 1, "no id\n"), (None, "a", "en", 1, "no id\n"), (7, "b", "de", 2, "again\n"), *[(9, "many", "en", 1, "same\n")] * 28]
    assert proved(spark, rows, tmp_path) == plain_manifest(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4])
def test_small_manifests(spark, tmp_path, n):
    rows = [(i, "s", "en", 1, f"t{i}\n") for i in range(n)]
    assert proved(spark, rows, tmp_path) == (plain_manifest(rows) if n else [])


def test_each_row_is_a_source_of_its_own(spark, tmp_path):
    rows = [(i, f"s{i}", "en", 1, "t\nt") for i in range(40)]
    assert proved(spark, rows, tmp_path) == plain_manifest(rows)


def test_manifest_names_may_clash(spark):
    df = spark.createDataFrame([(1, "s", 2, 3), (2, "s", 5, 6)], "doc_id long, source string, row long, hash long")
    got = merkle.manifest(df, merkle.leaf(F.col("row"), F.col("hash")), {"row": F.col("row"), "tree": F.col("hash"), "doc_id": F.col("doc_id")})
    assert sorted((r.row.doc_id, r.row.row, r.row.tree, r.leaf) for r in got.collect()) == [(1, 2, 3, plain_leaf((2, 3))), (2, 5, 6, plain_leaf((5, 6)))]


# whitening


def plain_whitening(vectors):
    """(n, deviations, covariance) by fractions."""
    x = [[int(np.floor(np.float64(1024) * np.float64(c))) + 100000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    deviations = [sum((n * r[j] - sums[j]) ** 2 for j in range(d)) for r in x]
    mean = [Fraction(s, n) for s in sums]
    cov = [[float(sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in x) / n) for j in range(d)] for i in range(d)]
    return x, deviations, np.array(cov), np.array([float(m) for m in mean])


def test_whitening(spark):
    rng = np.random.RandomState(3)
    mix = rng.randn(12, 12)
    vectors = (rng.randn(300, 12) @ mix * 0.3).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(vectors)]
    bad = [(900, None), (901, [1.0, None] + [0.0] * 10), (902, [float("nan")] * 12), (903, [float("inf")] + [0.0] * 11), (904, []), (905, [1e300] * 12)]
    df = spark.createDataFrame(rows + rows[:5] + bad, "vec_id long, embedding array<float>").repartition(3)
    got = whitening.whiten(df).select("row.vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error").collect()
    every = np.concatenate([vectors, vectors[:5]])
    x, deviations, cov, mean = plain_whitening(every)
    values, rotation = np.linalg.eigh(cov)
    assert len(got) == 8 * 305 and {r.n for r in got} == {305} and {r.vec_id for r in got} == set(range(300))
    z = np.zeros((300, 8))
    for r in got:
        assert r.deviation == deviations[r.vec_id] and r.explained == pytest.approx(values[::-1][r.component - 1] / np.trace(cov), rel=1e-9)
        z[r.vec_id, r.component - 1] = r.whitened
    want = (np.array(x, float)[:300] - mean) @ rotation[:, ::-1][:, :8] / np.sqrt(values[::-1][:8])
    np.testing.assert_allclose(np.abs(z), np.abs(want), atol=1e-6)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    both = np.concatenate([z, z[:5]])
    assert np.abs(np.cov(both.T, bias=True) - np.eye(8)).max() < 1e-6


def test_limbs_are_exact():
    rng = np.random.RandomState(1)
    for bits in (5, 18, 19, 37, 55, 62):
        y = rng.randint(-(2**bits) + 1, 2**bits, size=(500, 6), dtype=np.int64)
        exact = y.astype(object).T @ y.astype(object)
        assert (whitening.joined(whitening.products(y, bits)) == exact).all()
    wide = y.astype(object) * (1 << 40) - 17
    assert (whitening.joined(whitening.products(wide, 103)) == wide.T @ wide).all()
    x = rng.randint(-(2**40), 2**40, size=(50, 3), dtype=np.int64)
    sums = [int(s) for s in x.sum(axis=0)]
    for n, bits in ((10**6, 62), (10**12, 90)):
        assert (whitening.centred(x, n, sums, bits).astype(object) == x.astype(object) * n - np.array(sums, object)).all()


def test_whitening_hard_rows(spark):
    """Nothing varies; fewer dimensions than components; lengths that differ; clashing names; no rows."""
    kinds = "vec_id long, embedding array<double>, row string, component int, d int"
    rows = [(1, [1.0, 2.0, 3.0], "r", 5, 6), (2, [1.0, 4.0, 3.0], "r", 5, 6), (3, [0.5], "q", 1, 2), (4, [0.5], "q", 1, 2)]
    got = {(r.row.vec_id, r.component): r for r in whitening.whiten(spark.createDataFrame(rows, kinds)).collect()}
    assert sorted(got) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (3, 1), (4, 1)]
    assert abs(got[1, 1].whitened) == pytest.approx(1) and got[1, 1].explained == pytest.approx(1) and got[1, 2].whitened is None
    assert got[3, 1].whitened is None and got[3, 1].explained is None and got[3, 1].deviation == 0 and got[3, 1].identity_error is None
    assert got[1, 1].identity_error < 1e-9 and got[1, 1].row.row == "r" and got[1, 1].n == 2
    huge = whitening.whiten(spark.createDataFrame([(1, [1e12]), (2, [-1e12]), (3, [5.0])], "vec_id long, embedding array<double>")).collect()
    assert {r.row.vec_id: r.deviation is None for r in huge} == {1: True, 2: True, 3: False}
    assert huge[0].identity_error < 1e-6
    assert whitening.whiten(spark.createDataFrame([], kinds)).count() == 0


def test_registered_whitening(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    usable = [r.embedding for r in table.collect() if r.embedding is not None and all(c is not None and np.isfinite(c) for c in r.embedding)]
    got = entry.queries()["op12_embedding_whitening"](spark, SF).collect()
    assert len(got) == 8 * len(usable) and {r.n for r in got} == {len(usable)}
    _, deviations, cov, _ = plain_whitening(usable)
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(deviations)
    first = {r.component: r.explained for r in got}
    want = np.linalg.eigvalsh(cov)[::-1][:8] / np.trace(cov)
    assert [first[i + 1] for i in range(8)] == pytest.approx(list(want), rel=1e-4) and got[0].identity_error < 1e-4


# quality


def test_quality_on_held_out_rows(spark):
    """Rows held out of sf0.1: an accuracy that a change must not lower."""
    big = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in entry.queries()["op13_quality_score"](spark, big).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    held = [(got[i].predicted, q) for i, q in labels.items() if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert len(got) == 10000 and len(held) > 500 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    bad, good = [p for p, q in held if q == 0], [p for p, q in held if q == 1]
    assert sum(bad) <= 0.1 * len(bad) and sum(good) >= 0.98 * len(good)


def plain_sizes(text, model):
    import zstandard

    data = (text or "").encode()
    out = [len(data)]
    for d in model.dictionaries:
        c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
        out.append(sum(len(c.compress(data[i : i + 1024])) for i in range(0, len(data), 1024)))
    return out


def words(seed, n, bad):
    rng = random.Random(seed)
    plain = [rng.choice(["stone", "river", "meadow", "lantern", "harbour", "winter"]) for _ in range(n)]
    return " ".join(f"{w}$$$" if bad else w for w in plain)


def small(spark):
    docs = [(i, words(i, 120, i % 3 == 0)) for i in range(400)]
    labels = [(i, int(i % 3 != 0)) for i in range(400)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_quality_is_the_plain_score_of_sizes(spark):
    docs, labels = small(spark)
    model = quality.learn(docs, labels)
    hard = [(1, None, "r"), (2, "", "r"), (3, words(1, 60000, True), "r"), (3, words(1, 60000, True), "r"), (4, words(2, 30, False), None)]
    got = quality.quality(spark.createDataFrame(hard, "doc_id long, text string, row string"), model).collect()
    assert sorted(r.row.doc_id for r in got) == [1, 2, 3, 3, 4]
    for r in got:
        text = next(t for i, t, _ in hard if i == r.row.doc_id)
        assert r.score == pytest.approx(float(model.score(np.array([plain_sizes(text, model)]))[0]))
    score = {r.row.doc_id: r.score for r in got}
    assert score[1] == score[2] and score[3] < 0.3 < score[4]
    assert quality.quality(docs.limit(0), model).count() == 0


def test_held_out_labels_are_not_learned_from(spark):
    docs, labels = small(spark)
    other = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.learn(docs, labels), quality.learn(docs, other)
    assert a.dictionaries == b.dictionaries and (a.weights == b.weights).all()


def test_learning_without_a_class(spark):
    docs, labels = small(spark)
    for chosen, low, high in ((labels.where("quality = 1"), 0.9, 1), (labels.where("quality = 0"), 0, 0.1), (labels.limit(0), 0.5, 0.5)):
        model = quality.learn(docs, chosen.union(spark.createDataFrame([(None, 1), (5, None)], "doc_id long, quality int")))
        scores = {r.score for r in quality.quality(docs, model).collect()}
        assert len(scores) == 1 and low <= scores.pop() <= high
