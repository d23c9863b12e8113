"""The registered queries and the pipeline, against SQL where there is some, else against brute force."""

import os
import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from chirplake.llm import licenses, queries, suffixpieces, tokenrecords, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{SF}/{name}')")
    return c


def rows(df):
    return sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_same_as_sql(spark, db, name):
    result = db.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    df = entry.queries()[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    assert rows(df) == sorted(tuple(str(r[names.index(c)]) for c in sorted(names)) for r in result.fetchall())


def test_all_are_registered():
    got = [n for n in entry.queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in got] == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", ["op3_html_text", "op13_quality_score"])
def test_whole_tables(spark, db, name):
    """Their values are tested where the operators are."""
    (n,) = db.execute(f"select count(*) from {'pages' if name.startswith('op3') else 'documents'}").fetchone()
    assert entry.queries()[name](spark, SF).count() == n


@pytest.fixture(scope="module")
def texts(db):
    return db.execute("select doc_id, text from documents order by doc_id").fetchall()


def found(spark, name, *columns):
    return sorted(tuple(r[c] for c in columns) for r in entry.queries()[name](spark, SF).collect())


def test_registered_simhash(spark, texts):
    from test_text_operators import brute_groups, plain_print

    prints = [plain_print(t) for _, t in texts]
    want = [(d, f"{p:016x}", texts[g][0]) for (d, _), p, g in zip(texts, prints, brute_groups(prints), strict=True)]
    assert found(spark, "op4_simhash_dedup", "doc_id", "fingerprint", "component_id") == want


def test_registered_records(spark, texts):
    from tokenizers import Tokenizer

    whole, want, start = Tokenizer.from_file(tokenrecords.default_tokenizer()), [], 0
    for d, t in texts:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert found(spark, "op5_token_records", "doc_id", "start", "n_tokens", "ids_crc32") == want


def test_registered_pieces(spark, texts):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=suffixpieces.default_model())
    ids = {d: lib.encode(t or "") for d, t in texts}
    want = [(d, x, len(x), zlib.crc32(np.array(x, "<u4").tobytes()), True) for d, x in ids.items()]
    assert found(spark, "op6_sentencepiece", "doc_id", "ids", "n_ids", "ids_crc32", "same") == want


def test_registered_vectors(spark, db):
    from test_vectors import brute_links, groups

    ids, x, labels = zip(*db.execute("select vec_id, embedding, label from embeddings order by vec_id").fetchall(), strict=True)
    links = brute_links(np.array(x), np.array(labels))
    own = [ids[g] for g in groups(links)]
    want = [(i, int(n), o, i == o) for i, n, o in zip(ids, links.sum(axis=1), own, strict=True)]
    assert found(spark, "op7_itq_dedup", "vec_id", "n_links", "component_id", "kept") == want


def test_registered_licenses(spark, texts):
    """Every text scanned whole, as the scanner does it alone; that is held against brute force where the operators are."""
    known = licenses.Templates()
    want = []
    for d, t in texts:
        hits = known.scan(t or "")
        want.append((d, len(hits), ",".join(sorted({h[0] for h in hits})), max((h[1] for h in hits), default=None)))
    assert found(spark, "op8_license_scan", "doc_id", "n_found", "licenses", "coverage") == want


def test_registered_toxicity(spark, texts):
    """Scores of a plain matcher that tries all terms at all places, with the lexicon that is learned here."""
    from test_text_operators import plain_rate

    lexicon = toxicity.learn(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    scores = toxicity.score(np.array([plain_rate(t or "", lexicon) for _, t in texts]), lexicon)
    got = found(spark, "op9_toxicity", "doc_id", "held_out", "score", "predicted")
    assert [(d, h, p) for d, h, _, p in got] == [(d, zlib.crc32(str(d).encode()) % 4 == 2, int(s >= 0.3)) for (d, _), s in zip(texts, scores, strict=True)]
    assert [s for _, _, s, _ in got] == pytest.approx(scores.tolist())


def test_pipeline(spark, db):
    """Each stage on its own input, against brute force over the rows it got."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns = docs.columns
    inputs = []
    for _, stage in corpus_pipeline.STAGES:
        inputs.append(docs.toPandas())
        from chirplake.llm.shared import saved

        docs = saved(stage(spark, docs, SF), "test")
    first, lined, near, mixed, encoded = inputs
    for frame in (lined, near, mixed, encoded):
        assert list(frame.columns) == columns
    # toxicity
    automaton = (lexicon := toxicity.learn(spark.read.parquet(f"{SF}/documents.parquet"), labels)).automaton()
    good = toxicity.score(np.array([toxicity.rate(t, automaton) for t in first.text]), lexicon) < toxicity.THRESHOLD
    assert sorted(first.doc_id[good]) == sorted(lined.doc_id)
    # line dedup
    from test_text_operators import brute_lines

    by_id = lined.sort_values("doc_id")
    assert near.sort_values("doc_id").text.tolist() == brute_lines(list(zip(by_id.doc_id, by_id.text, strict=True)))
    # near dedup
    from test_similar import brute

    by_id = near.sort_values("doc_id").reset_index(drop=True)
    want = set(by_id.doc_id[sorted(set(brute(by_id.text.tolist())))])
    kept = set(mixed.doc_id)
    assert want <= kept and len(kept - want) <= 0.05 * (len(by_id) - len(want))
    # mix
    words = mixed.text.map(lambda t: len(t.split())).groupby(mixed.source).sum()
    taken = encoded.text.map(lambda t: len(t.split())).groupby(encoded.source).sum()
    assert encoded.groupby("doc_id").size().max() <= 2
    from test_text_operators import brute_targets

    longest = mixed.text.map(lambda t: len(t.split())).groupby(mixed.source).max()
    for source, target in brute_targets(words.to_dict()).items():
        assert abs(taken.get(source, 0) - target) <= longest[source]
    # encoding
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=suffixpieces.default_model())
    got = docs.toPandas()
    want = sorted((d, zlib.crc32(np.array(lib.encode(t), "<u4").tobytes())) for d, t in zip(encoded.doc_id, encoded.text, strict=True))
    assert sorted(zip(got.doc_id, got.ids_crc32, strict=True)) == want and got.same.all()
