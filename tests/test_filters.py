import json
import sqlite3

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from chirplake.operators.filters import Compiler, find, in_group

VALUES = [1, 7, 7.5, -2, 0, True, False, "7", "abc", "", "Z", "it's", None, [1, 2], {"a": 1}]
ROWS = [(i, json.dumps({"k": v, "n": {"x": i}})) for i, v in enumerate(VALUES)] + [(99, json.dumps({"other": 1})), (100, "{}")]


@pytest.fixture(scope="module")
def media(spark):
    return spark.createDataFrame(ROWS, "orid long, metadata string").cache()


def chosen(df, query):
    return sorted(r.orid for r in find(df, query).collect())


def sql_chosen(condition, params=()):
    db = sqlite3.connect(":memory:")
    db.execute("create table parsed (orid integer, metadata text)")
    db.executemany("insert into parsed values (?, ?)", ROWS)
    return sorted(r[0] for r in db.execute(f"select orid from parsed where {condition}", params))


OPS = {"$ne": "<>", "$gt": ">", "$lt": "<", "$gte": ">=", "$lte": "<=", "$eq": "="}


@pytest.mark.parametrize("op", OPS)
@pytest.mark.parametrize("value", [7, 7.5, 0, "7", "abc", "it's", True])
def test_json_comparisons_follow_sqlite(media, op, value):
    assert chosen(media, {"metadata.k": {op: value}}) == sql_chosen(f"json_extract(metadata, '$.k') {OPS[op]} ?", [value])


leaf = st.tuples(st.sampled_from(list(OPS)), st.sampled_from([7, 0, "7", "abc", 1]))
trees = st.recursive(leaf, lambda t: st.one_of(st.tuples(st.just("$and"), st.lists(t, min_size=1, max_size=3)), st.tuples(st.just("$or"), st.lists(t, min_size=1, max_size=3)), st.tuples(st.just("$not"), t)), max_leaves=5)


def both(tree):
    kind, value = tree
    if kind in ("$and", "$or"):
        parts = [both(t) for t in value]
        return {kind: [p[0] for p in parts]}, "(" + f" {kind[1:]} ".join(p[1] for p in parts) + ")"
    if kind == "$not":
        q, s = both(value)
        return {"$not": q}, f"(not {s})"
    literal = f"'{value}'" if isinstance(value, str) else str(value)
    return {"metadata.k": {kind: value}}, f"(json_extract(metadata, '$.k') {OPS[kind]} {literal})"


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(trees)
def test_trees_follow_sqlite(media, tree):
    query, sql = both(tree)
    assert chosen(media, query) == sql_chosen(sql)


def test_several_operators_and_keys_all_hold(media):
    assert chosen(media, {"metadata.k": {"$gte": 0, "$lt": 7.5}, "orid": {"$lte": 3}}) == [0, 1]
    assert chosen(media, {"metadata.n.x": 3}) == [3]


def test_in_none_and_empty(media):
    everything = sorted(r[0] for r in ROWS)
    assert chosen(media, None) == chosen(media, {}) == everything
    assert chosen(media, {"orid": {"$in": []}}) == []
    assert chosen(media, {"orid": {"$in": [4]}}) == [4]
    assert chosen(media, {"metadata.k": None}) == [12, 99, 100]
    assert chosen(media, {"orid": "3"}) == [3]  # plain columns take the literal's type
    assert chosen(media, {"orid": {"$lt": "abc"}}) == everything


def test_arrays_and_structs(spark):
    df = spark.createDataFrame([(1, [[0.5, 1.0], [2.0, 3.0]], (44100,)), (2, [], (22050,))], "orid long, verts array<array<double>>, media_info struct<samplerate:int>")
    assert chosen(df, {"verts": {"$size": 2}}) == [1]
    assert chosen(df, {"verts[1][0]": {"$gt": 1}}) == [1]
    assert chosen(df, {"media_info.samplerate": {"$lt": 30000}}) == [2]


@pytest.mark.parametrize("query", [{"orid": {"$regex": "x"}}, {"$nor": []}, {"orid": {"$in": 3}}, {"orid": {}}, {"nothing": 1}, {"orid": {"$size": 1}}, {"$and": []}])
def test_what_is_not_supported_is_an_error(media, query):
    with pytest.raises(ValueError):
        Compiler(media.schema).compile(query)


def test_promoted_paths_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, "{}", 5), (2, "{}", 9)], "orid long, metadata string, k int").write.parquet(str(tmp_path / "t"))
    df = find(spark.read.parquet(str(tmp_path / "t")), {"metadata.k": {"$gt": 6}}, promoted={"metadata.k": "k"})
    assert "GreaterThan(k,6)" in df._jdf.queryExecution().executedPlan().toString()
    assert chosen(df, None) == [2]


def test_group_null_is_a_value(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "orid long, g string")
    assert [r.orid for r in in_group(df, {"g": None}).collect()] == [2]
