"""The pipeline's near dedup: Jaccard similarity 0.8 of five-word shingles by SimHash candidates, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chirplake.llm import shared, simhash

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_set(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else frozenset()


def brute(texts):
    """The first of each group of texts, by its place."""
    sets, group = [plain_set(t) for t in texts], list(range(len(texts)))
    links = [(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if a == b or 5 * len(a & b) >= 4 * len(a | b) > 0]
    while True:
        before = group.copy()
        for i, j in links:
            group[i] = group[j] = min(group[i], group[j])
        if group == before:
            return group


def copies(seed):
    """Texts with near copies on both sides of the similarity, some around a passage that many have."""
    rng = random.Random(seed)
    words, passage = [f"w{i}" for i in range(400)], [f"p{i}" for i in range(30)]
    texts = ["", " ", "one two", "One  two", "one two three"]
    for _ in range(25):
        base = rng.choices(words, k=rng.choice([6, 40, 150, 400])) + rng.choice([[], passage])
        for _ in range(rng.randint(1, 7)):
            own = base.copy()
            for _ in range(rng.randint(0, max(1, len(own) // 40))):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own))
    rng.shuffle(texts)
    return texts


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], COLUMNS).repartition(5)


@pytest.mark.parametrize("seed", [1])
def test_stage_keeps_one_of_each_group(spark, seed):
    texts = copies(seed)
    kept = {r.doc_id for r in corpus_pipeline.keep_one(spark, documents(spark, enumerate(texts)), "").collect()}
    want = set(brute(texts))
    assert want <= kept  # nothing links below the similarity
    assert len(kept - want) <= 0.03 * (len(texts) - len(want))  # and hardly a copy is missed


def test_share_of_pairs_found(spark):
    """Pairs of their own at similarities from 0.8: no chain leads from one to the other but their own link."""
    rng = random.Random(9)
    texts, pairs = [], 0
    for _ in range(300):
        a = [f"w{rng.randrange(100_000)}" for _ in range(rng.choice([30, 100, 300, 900]))]
        b = a.copy()
        for i in rng.sample(range(len(b)), max(1, len(b) // rng.choice([45, 60, 90]))):
            b[i] = "x"
        x, y = plain_set(" ".join(a)), plain_set(" ".join(b))
        pairs += 5 * len(x & y) >= 4 * len(x | y)
        texts += [" ".join(a), " ".join(b)]
    kept = corpus_pipeline.keep_one(spark, documents(spark, enumerate(texts)), "").count()
    assert pairs > 150 and len(texts) - pairs <= kept <= len(texts) - 0.93 * pairs


def test_grids_follow_the_number_of_nodes():
    sizes = [len(simhash.wide_grids(n)[0]) for n in (10, 10**6, 10**8, 10**10)]
    assert sizes[0] == 8 and sizes == sorted(sizes) and sizes[-1] > sizes[0]
    assert len({x for g in simhash.wide_grids(10) for x in g}) == simhash.WIDE_SEGMENTS


def test_far_fingerprints_of_similar_texts(spark):
    """Similar texts whose fingerprints differ in more than four bits are near duplicates too."""
    rng = random.Random(0)
    base = [f"w{rng.randrange(10_000)}" for _ in range(120)]
    texts = [" ".join(base)] + [" ".join([*base[:i], "x", *base[i + 1 :]]) for i in (20, 60)]
    prints = [simhash.fingerprint(t) for t in texts]
    assert all((prints[0] ^ p).bit_count() > 4 for p in prints[1:])
    assert [r.doc_id for r in corpus_pipeline.keep_one(spark, documents(spark, enumerate(texts)), "").collect()] == [0]


def test_cells_in_chunks(spark, monkeypatch):
    """Hot cells in parts give the same groups."""
    texts = copies(3)

    def groups():
        got = {}
        df = documents(spark, enumerate(texts)).withColumn("h", F.xxhash64("doc_id")).withColumn("g", F.lit(0))
        for r in simhash.similar_documents(df).select("row.doc_id", "root").collect():
            got.setdefault(r.root, []).append(r.doc_id)
        return sorted(map(sorted, got.values()))

    whole = groups()
    monkeypatch.setattr(simhash, "hot_cells", lambda *a, **k: shared.hot_cells(*a, **(k | {"chunk": 3})))
    assert groups() == whole


def test_rows_alike_in_all_columns(spark):
    assert corpus_pipeline.keep_one(spark, documents(spark, [(1, "one two three")] * 5 + [(2, "four five six")]), "").count() == 2


def test_groups_without_ids(spark):
    """One row stays of near copies that all have null ids, though their fingerprints differ."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(10_000)}" for _ in range(1500)]
    texts = [" ".join([*base[:i], "x", *base[i + 1 :]]) for i in (100, 700, 1300)]
    prints = [simhash.fingerprint(t) for t in texts]
    assert len(set(prints)) == 3 and max((prints[0] ^ p).bit_count() for p in prints) <= 4
    assert corpus_pipeline.keep_one(spark, documents(spark, [(None, t) for t in texts]), "").count() == 1


def test_no_rows(spark):
    assert corpus_pipeline.keep_one(spark, documents(spark, [(1, "")]).limit(0), "").count() == 0


def test_stage_on_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    want = {rows[i][0] for i in set(brute([t for _, t in rows]))}
    kept = {r.doc_id for r in corpus_pipeline.keep_one(spark, docs, "").collect()}
    assert want <= kept and len(kept - want) <= 0.05 * (len(rows) - len(want))
