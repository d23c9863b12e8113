"""Stages of the pipeline on hard rows: nulls, empty and very long texts, repeats, ties, clashing columns, no rows."""

from collections import Counter

import pytest
from test_text_operators import HARD, brute_lines

import corpus_pipeline
from chirplake.llm import mixing

SF = "/root/testdata/sf0.001"
DOCUMENT = "doc_id long, source string, lang string, n_chars long, text string"
#: Names that the operators give columns of their own.
CLASHING = "row string, mix string, size string, id string, tie string, label string, node string, h string, g string, score string, removed string, root string, ids string, toxic int"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, s, None if k % 3 == 0 else "en", None if t is None else len(t), t, *"rmsitlnhgeaoz", 1) for k, (i, t, s) in enumerate(HARD)]
    return spark.createDataFrame(rows, f"{DOCUMENT}, {CLASHING}").repartition(3)


def plain(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", STAGES)
def test_no_rows(spark, docs, name):
    assert STAGES[name](spark, docs.limit(0), SF).collect() == []


@pytest.mark.parametrize("name", [n for n in STAGES if n != "sentencepiece"])
def test_columns_stay(spark, docs, name):
    out = STAGES[name](spark, docs, SF)
    assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)


def test_clean_rows_stay(spark, docs):
    """No text here is toxic: every row stays as it is, repeats too."""
    assert plain(STAGES["toxicity"](spark, docs, SF)) == plain(docs)


def test_passages_go(spark, docs):
    """A null text stays null; the second and third of three rows alike are one document, later than the first."""
    out = STAGES["line dedup"](spark, docs, SF).collect()
    assert len(out) == len(HARD)
    first = HARD[0][1]
    texts = dict(zip([(i, t) for i, t, _ in HARD if t is not None], brute_lines([(1, first), (5, first)]) + [None] * len(HARD), strict=False))
    assert [r.text for r in out if r.doc_id == 1] == [texts[1, first]] and [r.text for r in out if r.doc_id == 5] == ["", ""]
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out)
    rest = Counter((i, t) for i, t, _ in HARD if i not in (1, 5))
    assert Counter((r.doc_id, r.text) for r in out if r.doc_id not in (1, 5)) == rest


def test_one_of_each_group_stays(spark, docs):
    """Texts without words are one group, null and blank ones too; of equal texts the least id stays, null ids come last."""
    out = STAGES["near dedup"](spark, docs, SF).collect()
    groups = {}
    for i, t, _ in HARD:
        key = " ".join((t or "").split())
        groups[key] = min(groups.get(key, (True, 0)), (i is None, i or 0))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == sorted(groups.values())


def test_mix_takes_documents_with_words(spark, docs):
    out = STAGES["source mix"](spark, docs, SF)
    given, taken = plain(docs), plain(out)
    text = docs.columns.index("text")
    assert set(taken) <= set(given) and all(r[text] and r[text].split() for r in taken)
    assert all(n <= mixing.REPEATS * given[r] for r, n in taken.items()) and taken
    assert plain(STAGES["source mix"](spark, docs.repartition(5), SF)) == taken  # reruns agree, however rows are dealt


def test_pieces_of_hard_rows(spark, docs):
    out = STAGES["sentencepiece"](spark, docs, SF).collect()
    assert Counter((r.doc_id, r.source) for r in out) == Counter((i, s) for i, _, s in HARD)
    assert all(r.same and len(r.ids) == r.n_ids for r in out)
    assert [r.n_ids for r in out if r.doc_id in (2, 3)] == [0, 0]
