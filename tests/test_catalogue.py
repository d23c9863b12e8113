import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from chirplake.functions import dsp
from chirplake.operators import ingest
from chirplake.plans.collection import Collection, TimedCollection
from chirplake.plans.dataset import Dataset
from chirplake.plans.soundscape import Soundscape, audio_splits, mixed_model_formula
from chirplake.schema import TABLES
from chirplake.sources import readers, writers
from chirplake.streaming import ingest as streams


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("wav")
    for name, freqs, rate, seconds in (("a", [1000], 22050, 120), ("b", [1000, 4000], 44100, 95), ("c", [500], 8000, 10)):
        t = np.arange(rate * seconds) / rate
        (path / f"{name}.wav").write_bytes(dsp.encode(np.stack([0.5 * np.sin(2 * np.pi * f * t) for f in freqs]), rate))
    (path / "d.wav").write_bytes((path / "a.wav").read_bytes())
    (path / "e.wav").write_bytes(b"no header")
    return path


@pytest.fixture(scope="module")
def col(spark, folder):
    media = readers.wav_files(spark, str(folder))
    names = {r.path.rsplit("/", 1)[-1]: r.path for r in media.collect()}
    records = [{"path": names[f"{n}.wav"], "timeexp": 1.0, "datetime": f"0{i + 1}-02-2020 04:05:06", "timezone": "UTC", "site": {"id": i}} for i, n in enumerate("abcde")]
    records += [{"timeexp": 1.0}, {"path": "/nowhere.wav"}]
    ingest.register_parser("mark", lambda d, value: {**d, "mark": value})
    return TimedCollection(spark, "field").insert_media(records, media, [{"function": "mark", "kwargs": {"value": 3}}])


def test_dense_ids_without_a_folder(tmp_path):
    """In a session of its own that has no checkpoint folder, with many wide rows in several partitions."""
    import os
    import subprocess
    import sys

    code = """
from pyspark.sql import SparkSession, functions as F
from chirplake.operators import ingest
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "7").getOrCreate()
type(spark.sparkContext).getCheckpointDir = lambda self: None  # as where no setting of the machine names one
rows = spark.range(0, 300_000, 1, 16).select("id", F.md5(F.col("id").cast("string")).alias("k"), F.repeat(F.lit("x"), 50).alias("wide"))
x = ingest.dense_ids(rows, "n", ["k"]).agg(F.count("n"), F.countDistinct("n"), F.min("n"), F.max("n"), F.countDistinct("id")).first()
assert list(x) == [300_000, 300_000, 1, 300_000, 300_000], x
"""
    env = {**os.environ, "TMPDIR": str(tmp_path)}
    subprocess.run([sys.executable, "-c", code], check=True, env=env, timeout=300)


def test_splits_carry_dotted_fields(spark, col):
    from chirplake.plans.soundscape import Config

    fragment = readers.with_content(col.get_media()).select("orid", "content", F.col("media_info.duration").alias("fileDuration"), F.lit(7).alias("site.id"))
    splits = audio_splits(fragment, Config().merged({"energyParams": {"tStep": 60}}))
    assert {r["site.id"] for r in splits.collect()} == {7}


def test_insert(col):
    rows = {r.path.rsplit("/", 1)[-1]: r for r in col.get_media().collect()}
    assert sorted(rows) == ["a.wav", "b.wav", "c.wav"]
    assert sorted(r.reason for r in col.rejects.collect()) == ["file can't be read", "md5 is there already", "no path", "no timeexp"]
    assert rows["b.wav"].media_info.nchannels == 2 and rows["b.wav"].media_info.duration == pytest.approx(95)
    meta = json.loads(rows["a.wav"].metadata)
    assert meta["mark"] == 3 and meta["absStop"] - meta["absStart"] == pytest.approx(120) and meta["site"] == {"id": 0}
    assert sorted(r.orid for r in rows.values()) == [1, 2, 3]
    assert col.get_size({"metadata.site.id": {"$lt": 2}}) == 2
    assert col.tables["original"].count() == 3 and col.tables["datastores"].count() == 1


def test_annotations(spark, col):
    notes = spark.createDataFrame(
        [("bbox", 1, 0.0, 1.0, 1.0, 2000.0, 10.0, "x"), ("bbox", 1, 0.0, 1.0, 1.0, None, 1.0, "x"), ("blob", 1, 0.0, 1.0, 1.0, None, None, None), ("weak", None, 0.0, 1.0, 1.0, None, None, None)],
        "notetype string, orid long, start_time double, end_time double, duration double, max_freq double, min_freq double, wkt string",
    ).select("*", *[F.lit("{}").alias(c) for c in ("label", "groups", "metadata")])
    tables, rejects = ingest.annotate(col.tables, notes)
    assert tables["annotations"].count() == 2 and rejects.count() == 2


def test_changes(spark, col):
    tables, gone = ingest.remove(col.tables, {"metadata.site.id": 1})
    assert gone.count() == 1 and tables["parsed"].count() == tables["original"].count() == 2
    with pytest.raises(ValueError):
        ingest.remove(col.tables)
    again = ingest.transform_metadata(col.tables, [{"function": "mark", "kwargs": {"value": 9}}], "overwrite", {"orid": 1}, col.timed)
    rows = {r.orid: (json.loads(r.metadata), len(r.parse_seq)) for r in again["parsed"].collect()}
    assert rows[1][0]["mark"] == 9 and "absStart" in rows[1][0] and rows[2][0]["mark"] == 3 and rows[1][1] == 1
    appended = ingest.transform_metadata(col.tables, [{"function": "mark", "kwargs": {"value": 9}}])
    assert {len(r.parse_seq) for r in appended["parsed"].collect()} == {2}
    merged = ingest.merge(tables, col.tables)
    assert merged["parsed"].count() == 3 and merged["parsed"].select("orid").distinct().count() == 3
    assert merged["original"].where(F.get_json_object("source", "$.source_id") == "1").count() == 3


def test_disk(spark, col, tmp_path):
    plain = Collection(spark, "kept")
    plain.tables = col.tables
    plain.to_disk(str(tmp_path / "col"))
    assert Collection(spark, "kept", str(tmp_path / "col")).get_size() == 3
    with pytest.raises(ValueError):
        Collection(spark, "other", str(tmp_path / "col"))
    plain.doggy_bag(str(tmp_path / "bag"))
    assert spark.read.csv(str(tmp_path / "bag" / "metadata.csv"), sep="|", header=True).count() == 3
    assert len(list((tmp_path / "bag" / "media").glob("*.wav"))) == 3
    files = plain.write_chunks(str(tmp_path / "chunks"), chop=60.0)
    assert files.count() == 5


def test_own_media_files_go(spark, col, tmp_path):
    own = Collection(spark, "own")
    own.tables = col.tables
    own.to_disk(str(tmp_path / "own"))
    own.materialize(str(tmp_path / "own" / "media"))
    assert len(list((tmp_path / "own" / "media").glob("*.wav"))) == 3
    gone = own.drop_media({"metadata.site.id": 1})
    assert gone.count() == 1 and own.get_size() == 2
    assert sorted(f.stem for f in (tmp_path / "own" / "media").glob("*.wav")) == sorted(r.md5 for r in own.get_media().collect())
    before = len(list((tmp_path / "own" / "media").glob("*.wav")))
    col_files = {r.path for r in col.get_media().collect()}
    assert before == 2 and len(col_files) == 3  # the originals are elsewhere


def test_select_and_parsers(spark, col, tmp_path):
    assert col.select("count(*) AS n, max(p.orid) AS top FROM {parsed} p JOIN {original} o ON p.orid = o.id").first() == (3, 3)
    (parser,) = col.get_parsers().collect()
    assert (parser["function"], json.loads(parser["kwargs"]), parser["count"]) == ("mark", {"value": 3}, 3)
    col.dump(str(tmp_path / "copy"))
    assert spark.read.parquet(str(tmp_path / "copy" / "parsers.parquet")).count() == 1


def test_dataset(spark, col, tmp_path):
    config = {"globalParams": {"collectionFilter": {"metadata.site.id": {"$lt": 2}}, "groupingFields": ["site.id"]}, "splittingParams": {"folds": 2}}
    d = Dataset(col, "d", str(tmp_path), config)
    rows = d.get_media().collect()
    assert sorted((r.orid, r["site.id"]) for r in rows) == [(r.orid, str(r.orid - 1)) for r in sorted(rows, key=lambda r: r.orid)] and len(rows) == 2
    assert {r.split for r in rows} <= {"train", "test", "validation"} and {r.fold for r in rows} <= {0, 1}
    assert sum(d.get_media(split=s).count() for s in ("train", "test", "validation")) == sum(d.get_media(fold=f).count() for f in (0, 1)) == 2
    assert Dataset(col, "d", str(tmp_path)).config == d.config
    with pytest.raises(ValueError):
        Dataset(Collection(spark, "other"), "d", str(tmp_path))
    for wrong in ({"globalParams": {"collectionFilter": {"metadata.site.id": 99}}}, {"splittingParams": {"splits": {"a": 99}}}, {"splittingParams": {"none": 1}}):
        with pytest.raises(ValueError):
            d.set_config(wrong)


def test_masks(col):
    one = {"metadata.site.id": 1}
    whole, part = (col.get_signals(one, channel=1, mask=m).first().signal for m in (None, (2.0, 3.5)))
    assert len(part) == 66150 and part == whole[88200 : 88200 + 66150]
    assert dsp.masked((2.0, 4.0), 10.0) == (0.2, 0.2) and dsp.masked(None, 10.0) == (0.0, None)
    assert len(col.get_specs(one, mask=(0.0, 1.0)).first().spec[0]) == len(dsp.spectrogram(np.zeros(44100))[0])
    with pytest.raises(ValueError):
        dsp.masked((3.0, 2.0), 1.0)


def test_signals_and_specs(col):
    rows = {r.orid: r for r in col.get_specs({"media_info.duration": {"$lt": 50}}).collect()}
    (row,) = rows.values()
    assert len(row.freqs) == len(row.spec) == 513
    assert col.get_signals({"media_info.duration": {"$lt": 50}}).select(F.size("signal")).first()[0] == 80000


def test_annotation_matrices(spark, col):
    notes = spark.createDataFrame([("bbox", 1, 2.0, 3.0, 1.0, 1500.0, 500.0, "x"), ("weak", 1, 0.0, 120.0, 120.0, None, None, None)], "notetype string, orid long, start_time double, end_time double, duration double, max_freq double, min_freq double, wkt string")
    noted = TimedCollection(spark, "noted")
    noted.tables = col.tables
    noted.annotate(notes.select("*", *[F.lit("{}").alias(c) for c in ("label", "groups", "metadata")]))
    weak, box = noted.get_annotation_matrices(window=(2.0, None)).orderBy("start").collect()
    spec, mask = np.array(box.spec), np.array(box.mask)
    assert spec.shape == mask.shape and abs(spec.shape[1] - 2 * 22050 / 512) < 2 and mask.any() and not mask.all()
    assert spec.mean(axis=1).argmax() == pytest.approx((1000 - 500) / (22050 / 1024), abs=2)
    assert len(weak.mask) == 513
    assert all(r.spec is None for r in noted.get_annotation_matrices(masks="whole").collect())
    assert all(len(r.mask) == 1 for r in noted.get_annotation_matrices(masks="time").collect())
    short = {"media_info.duration": {"$lt": 50}}
    assert len(col.get_mfcc(short).first().mfcc) == 20 and col.get_zcr(short).first().zcr[5] == pytest.approx(2 * 500 / 8000, rel=0.1)


def test_audio_soundscape(col, tmp_path):
    fragment = readers.with_content(col.get_media()).select("orid", "content", F.col("media_info.duration").alias("fileDuration"), F.lit(1.5e9).alias("absStart"), F.lit(1.0).alias("timeexp"))
    config = {"cronoParams": {"startDate": "01-01-2017 00:00:00", "timeZone": "UTC"}, "globalParams": {"npartitions": 2}}
    s = Soundscape("s", fragment, config, str(tmp_path), audio_splits)
    rows = s.get_splits(keep=True).collect()
    assert sorted((r.orid, r.channel) for r in rows) == [(1, 0), (1, 0), (2, 0), (2, 0), (2, 1), (2, 1)]  # the short file has none
    for r in rows:
        energies = [r[f"e_{i}"] for i in range(10)]
        if r.chunkWeight >= 0.5:
            assert energies.index(max(energies)) in ((0, 1) if r.channel == 0 else (3, 4))
    assert s.get_counts().first()["count"] == 6
    assert s.matrix().count() == 240 and s.by_percentile((0, 100), top=3).count() == 3
    assert {r.level for r in s.matrix(freq_limits=(1000, 4000)).select("level").distinct().collect()} == {"e_1", "e_2", "e_3", "e_4"}
    with pytest.raises(ValueError):
        s.matrix(freq_limits=(1000, 1100))
    before = s.config.fingerprint()
    s.set_node("doubled", lambda f: f.select("orid").union(f.select("orid")), "fragment")
    s.set_config({"energyParams": {"tStep": 30}, "cronoParams": {"modulo": 12}})
    assert s.config.fingerprint() != before and s.get_node("doubled").count() == 6 and s.matrix().count() == 120
    assert s.get_splits().count() > 6
    with pytest.raises(ValueError):
        Soundscape("s", fragment, {"energyParams": {"nothing": 1}})
    with pytest.raises(ValueError):
        s.get_node("nothing")


def test_sources(spark, folder, tmp_path):
    head = bytearray(b"x" * 200)
    for place, text in ((68, "20:00:00 01/01/2020"), (89, "UTC"), (107, "0123456789ABCDEF"), (140, "2"), (166, "4.2")):
        head[place : place + len(text)] = text.encode()
    (tmp_path / "m.WAV").write_bytes(bytes(head))
    (row,) = readers.pull(spark, "audioMoth", {"path": str(tmp_path)}).collect()
    meta = json.loads(row.metadata)
    assert (meta["time"], meta["tZone"], meta["device_id"], meta["gain"], meta["battery"]) == ("20:00:00 01/01/2020", "UTC", "0123456789ABCDEF", 2.0, 4.2)
    (tmp_path / "t.csv").write_text("k,v\n1,a\n2,\n")
    rows = readers.pull(spark, "csv", {"path": str(tmp_path / "t.csv"), "ukey": "k"}).collect()
    assert [r.source.fkey for r in rows] == ["1", "2"] and json.loads(rows[1].metadata) == {"k": "2", "v": None}
    spec = readers.descriptor("postgresql", {"host": "h", "password": "p"})
    assert "***" in spec["conf"] and spec["hash"] == readers.hash_dict({"host": "h", "password": "***"})
    with pytest.raises(ValueError):
        readers.pull(spark, "nothing", {})


def test_json_files(spark, tmp_path):
    writers.save_json(spark, str(tmp_path / "x.json"), {"a": [1, "é"]})
    assert writers.load_json(spark, str(tmp_path / "x.json")) == {"a": [1, "é"]}


def test_streams(spark, folder, tmp_path):
    q = streams.append(streams.recordings(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4  # d is a copy of a


def test_dense_ids_and_formula(spark):
    df = ingest.dense_ids(spark.range(1000).select((F.col("id") * 3 % 1000).alias("v")), "id", ["v"], 5)
    assert [r.id for r in df.orderBy("v").collect()] == list(range(6, 1006))
    assert mixed_model_formula("y", ["a", "b"], ["g"], [("a", "h")]) == "y ~ a+b+(1|g)+(1+a|h)"


@pytest.mark.parametrize("few", [100, 1])
def test_rows_of_one_datastore_stay_spread(spark, few):
    """Nearly all rows have one datastore: they don't meet it in one task, whether there are few datastores or many."""
    rows = spark.range(20_000, numPartitions=8).select(F.col("id").alias("orid"), F.when(F.col("id") < 19_990, 7).when(F.col("id") < 19_998, F.col("id")).when(F.col("id") < 19_999, -1).alias("key"))
    stores = ingest.dense_ids(rows.where("key >= 0").select("key").distinct(), "source_id", ["key"])
    got = ingest.with_store(rows, stores, "key", "left", few).select("*", F.spark_partition_id().alias("task")).collect()
    assert sorted(r.orid for r in got) == list(range(20_000))
    assert {(r.key, r.source_id) for r in got} == {(7, 1), *[(19_990 + i, 2 + i) for i in range(8)], (-1, None), (None, None)}
    tasks = [r.task for r in got]
    assert max(tasks.count(t) for t in set(tasks)) <= 5_000
    assert ingest.with_store(rows, stores, "key", few=few).count() == 19_998


def test_an_insert_of_one_datastore_is_many_tasks(spark):
    """What an insert adds isn't in one partition, though all of it is of one datastore."""
    store = F.struct(*[F.lit(v).alias(k) for k, v in (("hash", "h"), ("type", "direct"), ("conf", "{}"), ("metadata", "{}"))])
    path = F.concat(F.lit("/e/"), F.col("id").cast("string"))
    rows = spark.range(4_000, numPartitions=4)
    records = rows.select(store.alias("datastore"), F.struct(F.lpad(F.col("id").cast("string"), 12, "0").alias("fkey")).alias("source"), F.to_json(F.struct(path.alias("path"), F.lit(1.0).alias("timeexp"))).alias("metadata"))
    media = rows.select(path.alias("path"), F.md5(path).alias("md5"), F.lit(1).cast("long").alias("filesize"), *[F.lit(v).alias(k) for k, v in (("samplerate", 8000), ("sampwidth", 2), ("nchannels", 1), ("nframes", 16000))])
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        added, _ = ingest.inserted({n: spark.createDataFrame([], s) for n, s in TABLES.items()}, records, media)
        sizes = [r["count"] for r in added["parsed"].groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sum(sizes) == 4_000 and max(sizes) <= 2_000
