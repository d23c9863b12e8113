"""Stored catalogues: buckets, snapshots, filters of md5s, typed columns."""

import json
import re
import shutil

import pytest
from pyspark.sql import functions as F

from chirplake.operators import ingest
from chirplake.plans.collection import Collection, TimedCollection
from chirplake.schema import TABLES
from chirplake.sources import readers
from chirplake.sources.store import KEYS, Conflict, Store, leaves


def media_of(spark, first, n):
    rows = spark.range(first, first + n)
    return rows.select(
        F.concat(F.lit("/r/"), "id").alias("path"), F.md5(F.col("id").cast("string")).alias("md5"), F.lit(100).cast("long").alias("filesize"),
        *[F.lit(v).alias(k) for k, v in (("samplerate", 8000), ("sampwidth", 2), ("nchannels", 1))], F.lit(8000).cast("long").alias("nframes"),
    )


def records_of(spark, first, n, parts=4):
    meta = F.to_json(F.struct(F.concat(F.lit("/r/"), "id").alias("path"), F.lit(1.0).alias("timeexp"), F.struct((F.col("id") % 10).alias("id"), F.when(F.col("id") % 3 == 0, "x").alias("name")).alias("site")))
    store = F.struct(*[F.lit(v).alias(k) for k, v in (("hash", "h"), ("type", "direct"), ("conf", "{}"), ("metadata", "{}"))])
    rows = spark.range(first, first + n, 1, parts)
    return rows.select(store.alias("datastore"), F.struct(F.format_string("%09d", "id").alias("fkey")).alias("source"), meta.alias("metadata"))


def versions(store, name):
    return {(v, b) for v, bs in store.snapshot["tables"][name] for b in bs}


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("store") / "c"
    Collection(spark, "c", str(path), buckets=8).insert_media(records_of(spark, 0, 2000), media_of(spark, 0, 2000))
    return path


@pytest.fixture
def col(spark, made, tmp_path):
    """A store of its own for each test; folders in it are named by what is below it."""
    shutil.copytree(made, tmp_path / "c")
    return Collection(spark, "c", str(tmp_path / "c"))


def test_insert_is_kept(spark, col):
    again = Collection(spark, "c", col.path)
    assert again.get_size() == 2000 and again.tables["original"].count() == 2000 and again.tables["datastores"].count() == 1
    assert sorted(r.orid for r in again.tables["parsed"].select("orid").collect()) == list(range(1, 2001))
    with pytest.raises(ValueError):
        Collection(spark, "other", col.path)


def test_new_ids_follow(spark, col):
    col.insert_media(records_of(spark, 2000, 50), media_of(spark, 2000, 50))
    assert col.tables["parsed"].agg(F.max("orid"), F.count("*")).first() == (2050, 2050)
    assert col.tables["datastores"].count() == 1 and col.rejects.count() == 0


def test_a_change_writes_its_bucket(spark, col):
    """One recording of many: one bucket of one table is written anew."""
    before = {n: versions(col.store, n) for n in KEYS}
    old = Store(spark, col.path).table("parsed").where("orid = 77").first()
    col.update_field("path", "moved", orid=77)
    after = {n: versions(col.store, n) for n in KEYS}
    assert len(after["parsed"] - before["parsed"]) == 1 and len(after["parsed"]) == len(before["parsed"])
    assert all(after[n] == before[n] for n in KEYS if n != "parsed")
    again = Collection(spark, "c", col.path)
    assert again.tables["parsed"].where("path = 'moved'").select("orid").collect() == [(77,)] and again.get_size() == 2000
    assert old.path == "/r/76"


def test_changes_are_those_of_a_session(spark, col):
    """The same changes on a store and in a session give the same tables."""
    plain = Collection(spark, "p").insert_media(records_of(spark, 0, 2000), media_of(spark, 0, 2000))
    ingest.register_parser("mark", lambda d, value: {**d, "mark": value})
    notes = spark.range(1, 400).select(F.lit("weak").alias("notetype"), F.col("id").alias("orid"), *[F.lit(1.0).alias(c) for c in ("start_time", "end_time", "duration")], *[F.lit("{}").alias(c) for c in ("label", "groups", "metadata")])
    for c in (plain, col):
        c.annotate(notes)
        c.transform_metadata([{"function": "mark", "kwargs": {"value": 4}}], query={"metadata.site.id": 3})
        c.drop_media({"metadata.site.id": {"$in": [5, 6]}})
        c.transform_metadata([{"function": "mark", "kwargs": {"value": 5}}], "overwrite", {"orid": {"$lt": 20}})
        c.insert_media(records_of(spark, 1990, 40), media_of(spark, 1990, 40))
    for name in TABLES:
        a, b = (sorted(map(str, c.tables[name].collect())) for c in (plain, Collection(spark, "c", col.path)))
        assert a == b and a
    assert sorted(r.reason for r in plain.rejects.collect()) == sorted(r.reason for r in col.rejects.collect()) == ["md5 is there already"] * 8


def test_a_crash_leaves_the_snapshot(spark, col, monkeypatch):
    monkeypatch.setattr(Store, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        col.update_field("path", "moved", {"metadata.site.id": 1})
    monkeypatch.undo()
    again = Collection(spark, "c", col.path)
    assert again.get_size() == 2000 and again.tables["parsed"].where("path = 'moved'").count() == 0
    assert again.vacuum() > 0 and again.get_size() == 2000  # what the crash left behind goes
    again.update_field("path", "moved", {"metadata.site.id": 1})
    assert Collection(spark, "c", col.path).tables["parsed"].where("path = 'moved'").count() == 200


def test_two_writers(spark, col):
    other = Collection(spark, "c", col.path)
    col.update_field("path", "first", orid=5)
    with pytest.raises(Conflict):
        other.update_field("path", "second", orid=6)
    other.refresh().update_field("path", "second", orid=6)
    assert {(r.orid, r.path) for r in Collection(spark, "c", col.path).tables["parsed"].where("orid IN (5, 6)").collect()} == {(5, "first"), (6, "second")}


def test_filters_rule_buckets_out(spark, col):
    """An insert opens only parts of buckets that may hold one of its md5s."""
    col.insert_media(records_of(spark, 5000, 30), media_of(spark, 5000, 30))
    assert col.rejects.count() == 0 and len(col.store.scanned) <= 1
    col.insert_media(records_of(spark, 123, 1), media_of(spark, 123, 1))
    assert [r.reason for r in col.rejects.collect()] == ["md5 is there already"] and 1 <= len(col.store.scanned) <= 2
    wanted = spark.range(0, 6000).select(F.md5(F.col("id").cast("string")).alias("md5"))
    assert col.store.known(wanted).count() == 2030 and col.store.known(wanted.where("md5 IS NULL")).count() == 0


def test_removed_md5s_can_come_back(spark, col):
    col.drop_media({"metadata.site.id": 4})
    assert col.get_size() == 1800
    col.insert_media(records_of(spark, 0, 2000), media_of(spark, 0, 2000))
    assert col.get_size() == 2000 and col.rejects.count() == 1800


def test_one_md5_in_half_of_the_records(spark, col):
    """Ranks by task first: no task of the second ranking gets more of an md5 than there are tasks."""
    media = media_of(spark, 9000, 400).withColumn("md5", F.when(F.substring("path", -1, 1).cast("int") % 2 == 0, F.lit("f" * 32)).otherwise(F.col("md5")))
    screened = ingest.screen(records_of(spark, 9000, 400, 8), media, col.store.known)
    assert screened.where("reason IS NULL").count() == 201 and ingest.rejected(screened).count() == 199
    first = screened.where(F.col("reason").isNull() & (F.col("md5") == "f" * 32)).first()
    assert first.path == "/r/9000"
    same = records_of(spark, 9001, 1).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(300)))).drop("k").repartition(6)
    assert ingest.screen(same, media, col.store.known).where("reason IS NULL").count() == 1


def test_parts_are_brought_together(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), 4)
    for i in range(5):
        rows = spark.createDataFrame([(i * 10 + k, None, f"m{i}{k}") for k in range(10)], "id long, source string, metadata string")
        store.append({"original": rows})
    assert len(store.snapshot["tables"]["original"]) == 5 and store.snapshot["tops"]["original"] == 49
    store.compact(3)
    assert len(store.snapshot["tables"]["original"]) == 1 and store.table("original").count() == 50
    assert store.vacuum() == 5 and Store(spark, str(tmp_path / "s")).table("original").count() == 50


QUERIES = [
    {"metadata.site.id": 3}, {"metadata.site.id": {"$gt": 3, "$lte": 7}}, {"$not": {"metadata.site.id": {"$gt": 3}}}, {"metadata.site.id": {"$gt": "a"}}, {"metadata.site.id": {"$lt": "a"}},
    {"metadata.v": 7}, {"metadata.v": "7"}, {"metadata.v": {"$ne": 7}}, {"$not": {"metadata.v": 7}}, {"$not": {"metadata.v": {"$in": [7, "x"]}}}, {"metadata.v": None}, {"metadata.v": {"$ne": None}},
    {"$not": {"metadata.v": None}}, {"metadata.v": {"$gte": 1}}, {"metadata.v": {"$lt": "8"}}, {"metadata.v": True}, {"$or": [{"metadata.v": {"$gt": "x"}}, {"$not": {"$and": [{"metadata.site.id": {"$gte": 2}}, {"metadata.v": {"$ne": 1}}]}}]},
]


def test_typed_columns_hold_for_the_same_rows(spark, tmp_path):
    values = [7, "7", "x", True, False, None, 1.5, [1], {"a": 1}, "", -3]
    rows = [{"path": f"/r/{i}", "timeexp": 1.0, "site": {"id": i % 9}, **({} if i % 12 == 11 else {"v": values[i % 12]})} for i in range(120)]
    col = Collection(spark, "t", str(tmp_path / "t"), buckets=4).insert_media(readers.direct(spark, {"data": rows}), media_of(spark, 0, 120))
    plain = [sorted(r.orid for r in col.get_media(q).collect()) for q in QUERIES]
    assert sorted(col.shred()) == ["metadata.path", "metadata.site.id", "metadata.timeexp", "metadata.v"]
    assert [sorted(r.orid for r in col.get_media(q).collect()) for q in QUERIES] == plain and any(plain)
    again = Collection(spark, "t", col.path)
    assert [sorted(r.orid for r in again.get_media(q).collect()) for q in QUERIES] == plain
    again.insert_media(readers.direct(spark, {"data": [{"path": "/r/500", "timeexp": 1.0, "v": 7}]}), media_of(spark, 500, 1))
    assert len(again.get_media({"metadata.v": 7}).collect()) == len(plain[5]) + 1
    assert again.tables["parsed"].columns == TABLES["parsed"].fieldNames()


def test_predicates_reach_the_scan(spark, col):
    col.shred(["metadata.site.id"])
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = col.get_media({"metadata.site.id": {"$gt": 3, "$lte": 7}})._jdf.queryExecution().explainString(mode)
    (pushed,) = re.findall(r"PushedFilters: \[(.*)\]", plan)
    assert "GreaterThan(_number0,3.0)" in pushed and "LessThanOrEqual(_number0,7.0)" in pushed
    assert "parse_json" not in plan


def test_leaves_of_a_type():
    assert leaves("OBJECT<a: BIGINT, b: OBJECT<c: STRING, d: ARRAY<BIGINT>>, e: DECIMAL(3,1)>") == [("a",), ("b", "c"), ("b", "d"), ("e",)]
    assert leaves("VOID") == leaves("OBJECT<>") == []


def test_timed_store(spark, tmp_path):
    rows = [{"path": f"/r/{i}", "timeexp": 1.0, "datetime": f"0{i + 1}-02-2020 04:05:06", "timezone": "UTC"} for i in range(5)]
    TimedCollection(spark, "t", str(tmp_path / "t"), buckets=3).insert_media(rows, media_of(spark, 0, 5))
    again = TimedCollection(spark, "t", str(tmp_path / "t")).build_time()
    assert all("absStart" in json.loads(r.metadata) for r in again.get_metadata().collect())
