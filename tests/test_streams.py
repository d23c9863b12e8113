"""Lookups of ids by batches, and streams into stored collections."""

import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from chirplake.functions import dsp
from chirplake.plans.collection import Collection
from chirplake.sources import readers
from chirplake.sources.store import Store
from chirplake.streaming import ingest as streams


def test_ids_are_looked_up_in_batches(spark, tmp_path):
    def fetch(some):
        """A source that knows even keys, and fails if it is asked for too many at once."""
        assert len(some) <= 500
        return ({"_id": s, "value": int(s) * 2} for s in some if int(s) % 2 == 0)

    conf = {"host": "h", "dbname": "d", "collection": "c", "ukey": "_id", "fetch": fetch, "batch": 500}
    got = readers.pull(spark, "mongodb", {**conf, "ids": spark.range(200_000)})
    assert got.count() == 100_000 and got.agg(F.countDistinct("source.fkey")).first()[0] == 100_000
    row = got.where("source.fkey = '42'").first()
    assert row.metadata == '{"_id": "42", "value": 84}' and row.datastore.type == "mongodb" and "fetch" not in row.datastore.conf
    assert len(got._jdf.queryExecution().toString()) < 20_000  # no list of ids in the plan
    listed = readers.pull(spark, "mongodb", {**conf, "filter": [1, 2, 2, 4, None]})
    assert sorted(r.source.fkey for r in listed.select("source").collect()) == ["2", "4"]
    (tmp_path / "ids.txt").write_text("6\n7\n8\n")
    assert readers.pull(spark, "mongodb", {**conf, "ids": str(tmp_path / "ids.txt")}).count() == 2
    many = readers.id_table(spark, list(range(1_000_000)))
    assert many.count() == 1_000_000 and len(many._jdf.queryExecution().toString()) < 20_000


@pytest.fixture
def inbox(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.wav").write_bytes(dsp.encode(np.full((1, 800), i / 10), 8000))
    return folder


def test_streams_into_a_store(spark, inbox, tmp_path):
    col = Collection(spark, "s", str(tmp_path / "s"), buckets=2)
    run = lambda c=col: streams.insert(streams.files(spark, str(inbox)), c, "field", str(tmp_path / "ck"), str(tmp_path / "rejects")).awaitTermination(120)
    run()
    assert col.get_size() == 3
    shutil.copy(inbox / "0.wav", inbox / "copy.wav")
    (inbox / "new.wav").write_bytes(dsp.encode(np.full((1, 800), 0.9), 8000))
    (inbox / "broken.wav").write_bytes(b"nothing")
    run()
    again = Collection(spark, "s", str(tmp_path / "s"))
    assert again.get_size() == 4 and again.tables["datastores"].count() == 1
    rejects = {r.reason: r.batch for r in spark.read.parquet(str(tmp_path / "rejects")).collect()}
    assert set(rejects) == {"md5 is there already", "file can't be read"} and set(rejects.values()) == {1}
    assert Store(spark, str(tmp_path / "s")).snapshot["streams"] == {"field": 1}


def test_a_replayed_batch_adds_nothing(spark, inbox, tmp_path):
    """The stream's own checkpoint is lost: it sends all files again, under numbers that the store has."""
    col = Collection(spark, "s", str(tmp_path / "s"), buckets=2)
    args = (col, "field")
    streams.insert(streams.files(spark, str(inbox)), *args, str(tmp_path / "ck"), str(tmp_path / "rejects")).awaitTermination(120)
    before = col.store.snapshot["number"]
    streams.insert(streams.files(spark, str(inbox)), *args, str(tmp_path / "other"), str(tmp_path / "rejects")).awaitTermination(120)
    assert col.get_size() == 3 and col.store.snapshot["number"] == before
    assert spark.read.parquet(str(tmp_path / "rejects")).count() == 0  # those of the first time stay
    with pytest.raises(ValueError):
        streams.insert(streams.files(spark, str(inbox)), Collection(spark, "plain"), "field", str(tmp_path / "x"), str(tmp_path / "y"))


def test_a_batch_of_small_files_is_few_tasks(spark, tmp_path, monkeypatch):
    """Neither looking up the files of a batch nor reading them takes a task for each few; the session's settings stay."""
    import chirplake.operators.ingest as changes

    folder, sizes = tmp_path / "many", []
    folder.mkdir()
    for i in range(200):
        (folder / f"{i}.wav").write_bytes(dsp.encode(np.full((1, 80), i / 200), 8000))
    kept = changes.stored
    monkeypatch.setattr(changes, "stored", lambda df: sizes.append(df.rdd.getNumPartitions()) or kept(df) if "md5" in df.columns and "reason" not in df.columns else kept(df))
    before = {k: spark.conf.get(k) for k in streams.SMALL_FILES}
    col = Collection(spark, "s", str(tmp_path / "s"), buckets=2)
    for place in ("ck", "other"):
        query = streams.insert(streams.files(spark, str(folder)), col, "field", str(tmp_path / place), str(tmp_path / "rejects"))
        query.awaitTermination(120)
        assert query.exception() is None
    assert col.get_size() == 200 and {k: spark.conf.get(k) for k in streams.SMALL_FILES} == before
    assert max(sizes) <= spark.sparkContext.defaultParallelism and len(sizes) == 1  # the second time no file is read
