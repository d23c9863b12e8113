"""The media source, range reads and audio splits that move no bytes."""

import hashlib
import json
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chirplake.functions import dsp
from chirplake.operators.aggregates import dealt
from chirplake.plans.collection import Collection
from chirplake.plans.soundscape import Config, audio_splits
from chirplake.sources import media, readers

RATE = 8000


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("media")
    rng = np.random.RandomState(2)
    for name, channels, seconds in (("short", 1, 20), ("long", 2, 400), ("odd", 1, 61.37), ("tiny", 1, 2)):
        (path / f"{name}.wav").write_bytes(dsp.encode(rng.uniform(-0.9, 0.9, (channels, int(RATE * seconds))), RATE))
    (path / "broken.wav").write_bytes(b"RIFFxx")
    (path / "sub").mkdir()
    (path / "sub" / "below.WAV").write_bytes((path / "tiny.wav").read_bytes())
    (path / "notes.txt").write_text("no media")
    return path


def by_name(df):
    return {r.path.rsplit("/", 1)[-1]: r for r in df.collect()}


def test_only_asked_columns_are_read(spark, folder):
    nothing = by_name(media.media_files(spark, str(folder), ["path", "filesize", "bytes_read"]))
    assert sorted(nothing) == ["below.WAV", "broken.wav", "long.wav", "odd.wav", "short.wav", "tiny.wav"] and all(r.bytes_read == 0 for r in nothing.values())
    head = by_name(media.media_files(spark, str(folder), ["path", "head", "bytes_read"], headBytes=50))
    assert all(r.bytes_read == len(r.head) == min(50, nothing[n].filesize) for n, r in head.items())
    fields = by_name(media.media_files(spark, str(folder), ["path", "nframes", "nchannels", "samplerate", "bytes_read"]))
    assert fields["long.wav"].nframes == 400 * RATE and fields["long.wav"].nchannels == 2 and max(r.bytes_read for r in fields.values()) < 100
    assert fields["broken.wav"].nframes is None
    whole = by_name(media.media_files(spark, str(folder), ["path", "md5", "content", "bytes_read"]))
    assert all(r.md5 == hashlib.md5(bytes(r.content)).hexdigest() and r.bytes_read == nothing[n].filesize for n, r in whole.items())
    assert set(by_name(media.media_files(spark, str(folder), ["path"], recursiveFileLookup="false"))) == set(nothing) - {"below.WAV"}
    with pytest.raises(Exception, match="media files have no"):
        spark.read.format("media").schema("path string, colour int").load(str(folder)).collect()


def test_filters_reach_the_listing(spark, folder):
    files = media.media_files(spark, str(folder), ["path", "filesize", "samplerate"])
    assert set(by_name(files.where(F.col("filesize") > 1_000_000).where(F.col("samplerate") == RATE))) == {"long.wav"}
    reader = media.MediaReader(media.COLUMNS, {"path": str(folder)})
    kept = list(reader.pushFilters([media.GreaterThan(("filesize",), 1_000_000), media.EqualTo(("samplerate",), RATE)]))
    assert [f.attribute for f in kept] == [("samplerate",)] and [len(p.files) for p in reader.partitions()] == [1]


def test_packs_by_what_is_read(folder):
    every = media.MediaReader(media.COLUMNS, {"path": str(folder), "partitionBytes": "1000000"})
    light = media.MediaReader(T.StructType([media.COLUMNS[c] for c in ("path", "samplerate")]), {"path": str(folder), "partitionBytes": "1000000"})
    assert len(every.partitions()) > 1 and len(light.partitions()) == 1
    assert sorted(f for p in every.partitions() for f in p.files) == sorted(f for p in light.partitions() for f in p.files)


def test_windows_read_their_frames_only(folder):
    path = str(folder / "long.wav")
    with media.RangedFile(path) as file:
        x, rate = media.window(file, 100.0, 1.5)
        assert x.shape == (2, 12000) and rate == RATE and file.read < 12000 * 4 + 100
    whole, _ = dsp.decode((folder / "long.wav").read_bytes())
    assert (x == whole[:, 800_000:812_000]).all()
    assert media.path_window(path, 399.5, 10.0)[0].shape == (2, 4000) and media.path_window(path, 500.0, 1.0)[0].shape == (2, 0)


@pytest.mark.parametrize(("tag", "bits", "kind"), [(1, 8, "u1"), (1, 16, "<i2"), (1, 24, None), (1, 32, "<i4"), (3, 32, "<f4"), (3, 64, "<f8"), (0xFFFE, 16, "<i2")])
def test_formats(tag, bits, kind):
    x = np.array([[-0.5, 0.0, 0.25, 0.5], [0.5, 0.25, 0.0, -0.5]])
    if tag == 3:
        data = x.T.astype(kind).tobytes()
    elif bits == 24:
        data = b"".join(int(v * 2**23).to_bytes(3, "little", signed=True) for v in x.T.ravel())
    else:
        data = (x.T * 2 ** (bits - 1) + (128 if bits == 8 else 0)).astype(kind).tobytes()
    form = struct.pack("<HHIIHH", tag, 2, RATE, RATE * bits // 4, bits // 4, bits) + (struct.pack("<HHIH", 22, bits, 0, 1) + b"\0" * 14 if tag == 0xFFFE else b"")
    body = b"WAVE" + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"fmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(data)) + data
    content = b"RIFF" + struct.pack("<I", len(body)) + body
    np.testing.assert_array_equal(dsp.decode(content)[0], x)
    cut = dsp.decode(content[:-bits // 4])[0]  # the last frame is missing
    np.testing.assert_array_equal(cut, x[:, :3])


def test_padding_is_numpy_s():
    rng = np.random.RandomState(0)
    for n, pad in ((50, 8), (9, 8), (8, 8), (3, 8), (1, 4)):
        x = rng.randn(n)
        want = np.pad(x, pad, "reflect" if n > pad else "constant")
        for start, stop in ((-pad, n + pad), (-pad, -pad + 5), (n + pad - 5, n + pad), (0, n)):
            got = media.padded(lambda a, k, x=x: x[a : a + k], n, start, stop, pad)
            np.testing.assert_array_equal(got, want[start + pad : stop + pad])


def fragment(spark, folder, **more):
    files = readers.wav_files(spark, str(folder)).where("samplerate IS NOT NULL")
    info = F.struct("path", "filesize", F.lit(1.0).alias("timeexp"))
    duration = F.col("nframes") / F.col("samplerate")
    return files.select(F.abs(F.xxhash64("path")).alias("orid"), info.alias("media_info"), duration.alias("fileDuration"), F.lit(1e9).alias("absStart"), *[c.alias(k) for k, c in more.items()])


def plain_rows(content, config, duration):
    """Energies by a spectrogram of the whole recording."""
    e = config.energyParams
    x, rate = dsp.decode(content, sr=e.readSr)
    out = []
    for channel in range(len(x)):
        spec = dsp.spectrogram(x[channel], e.n_fft, e.hop_length)
        size = int(round((rate * e.tStep - e.n_fft) / e.hop_length) + 1)
        cuts = dsp.frequency_bands(dsp.frequencies(rate, e.n_fft), e.fLimits, e.fBins)
        for k in range(round(duration / e.tStep)):
            n, weight, values = dsp.slice_energy(spec, duration, k * e.tStep, size, cuts, e.aggr)
            out.append((channel, k * e.tStep, n, weight, *values))
    return out


@pytest.mark.parametrize("changes", [{"tStep": 7}, {"tStep": 7, "n_fft": 513, "hop_length": 200}, {"tStep": 20, "readSr": 4000}, {"tStep": 30, "aggr": "max"}])
def test_splits_are_those_of_whole_files(spark, folder, monkeypatch, changes):
    """Long files are cut into many pieces; the values don't change."""
    monkeypatch.setattr(dsp, "PIECE_BYTES", 400_000)
    monkeypatch.setattr(dsp, "TASK_BYTES", 1_000_000)
    config = Config().merged({"energyParams": {"fLimits": (0, 2000), **changes}, "globalParams": {"npartitions": 3}})
    rows = fragment(spark, folder)
    got = audio_splits(rows, config).collect()
    names = config.energyParams.columns()
    count = 0
    for r in rows.collect():
        want = plain_rows(open(r.media_info.path.removeprefix("file://"), "rb").read(), config, r.fileDuration)
        own = sorted((g.channel, g.chunkFileStart, g.chunkTbins, g.chunkWeight, *[g[n] for n in names]) for g in got if g.orid == r.orid)
        assert len(own) == len(want)
        if want:
            np.testing.assert_allclose(np.array(own, float), np.array(sorted(want), float), rtol=1e-9)
        count += len(want)
    assert len(got) == count > 0


def test_no_bytes_are_shuffled(spark, folder, monkeypatch):
    monkeypatch.setattr(dsp, "PIECE_BYTES", 400_000)
    monkeypatch.setattr(dsp, "TASK_BYTES", 1_000_000)
    config = Config().merged({"energyParams": {"tStep": 10}, "globalParams": {"npartitions": 2}})
    splits = audio_splits(fragment(spark, folder), config)
    assert not re.search("content|binary", splits._jdf.queryExecution().toString())
    pieces = dsp.pieces(fragment(spark, folder).select("*", "media_info.*").drop("media_info"), config.energyParams, 2)
    placed = pieces.withColumn("task", F.spark_partition_id()).collect()
    tasks = {r.task for r in placed if "long" in r.path}
    assert len(tasks) > 3 and len([r for r in placed if "long" in r.path]) > 10  # a file of many times the mean lies in several tasks
    weights = {}
    for r in placed:
        weights[r.task] = weights.get(r.task, 0) + (r._until - r._from)
    assert max(weights.values()) <= 2.5 * (sum(weights.values()) / len(weights))
    assert not any("tiny" in r.path for r in placed)  # no whole chunk: never opened


def test_dealt_by_weight(spark):
    rows = spark.range(1000).withColumn("w", F.when(F.col("id") % 100 == 0, 50.0).otherwise(1.0))
    parts = dealt(rows, "w", ["id"], 100).withColumn("p", F.spark_partition_id()).collect()
    sums = {}
    for r in parts:
        sums[r.p] = sums.get(r.p, 0) + r.w
    assert len(parts) == 1000 and len(sums) == 15 and max(sums.values()) <= 150
    assert [r.id for r in parts] == list(range(1000))
    assert dealt(rows.limit(0), "w", ["id"], 100, 4).count() == 0


def test_numbered_shares_are_few_partitions(spark, monkeypatch):
    """Shares are the same whether each is a partition or not; partitions have runs of them, in order."""
    from chirplake.operators import aggregates

    rows = spark.range(1000).withColumn("w", F.when(F.col("id") % 100 == 0, 50.0).otherwise(1.0))
    each = {r.id: r.p for r in dealt(rows, "w", ["id"], 100).withColumn("p", F.spark_partition_id()).collect()}
    for limit, partitions in ((1000, 15), (15, 15), (14, 8), (4, 4), (1, 1)):
        monkeypatch.setattr(aggregates, "DEALT_PARTITIONS", limit)
        numbered = dealt(rows, "w", ["id"], 100, number="share")
        got = numbered.withColumn("p", F.spark_partition_id()).collect()
        assert {r.id: r.share for r in got} == each and [r.id for r in got] == list(range(1000))
        assert numbered.rdd.getNumPartitions() == partitions and len({(r.share, r.p) for r in got}) == 15
    assert dealt(rows.limit(0), "w", ["id"], 100, 4, "share").count() == 0


def test_annotation_windows_are_dealt_and_batched(spark, folder, monkeypatch):
    """Many recordings with a note each are work of all tasks, however few bytes their rows have; rows are handed on by cells."""
    from chirplake.operators import geometry

    path = str(folder / "tiny.wav")
    kinds = "orid long, path string, media_info struct<timeexp: double>, data array<struct<id: long, notetype: string, start_time: double, end_time: double, min_freq: double, max_freq: double, verts: array<array<double>>>>"
    notes = spark.createDataFrame([(i, path, (1.0,), [(i, "bbox", 0.0, 0.5, 100.0, 900.0 + i, None)]) for i in range(200)], kinds)
    notes = notes.join(spark.range(200).withColumnRenamed("id", "orid").hint("merge"), "orid")  # as a collection has them: after a shuffle by orid
    want = None
    for cells in (1, 1000, 1 << 18):
        monkeypatch.setattr(geometry, "CELLS", cells)
        got = geometry.annotation_matrices(notes, n_fft=256, hop=128).withColumn("task", F.spark_partition_id()).collect()
        assert len(got) == 200 and len({r.task for r in got}) == spark.sparkContext.defaultParallelism
        rows = sorted((r.orid, r.id, r.start, r.stop, r.low, r.high, str(r.spec), str(r["mask"])) for r in got)
        assert want is None or rows == want
        want = rows


def test_getters_by_range(spark, folder):
    files = readers.wav_files(spark, str(folder)).where("samplerate IS NOT NULL AND path NOT LIKE '%below%'")
    records = [{"path": r.path, "timeexp": 1.0} for r in files.collect()]
    col = Collection(spark, "ranged").insert_media(records, files)
    rows = {json.loads(r.metadata)["path"].rsplit("/", 1)[-1]: r.orid for r in col.get_metadata().collect()}
    whole, _ = dsp.decode((folder / "long.wav").read_bytes())
    (got,) = col.get_signals({"orid": rows["long.wav"]}, channel=1, mask=(30.0, 31.0)).collect()
    assert got.signal == list(whole[1, 30 * RATE : 31 * RATE])
    assert len(col.get_zcr({"orid": rows["tiny.wav"]}).first().zcr) == len(dsp.zcr(np.zeros(2 * RATE)))
    chunks = col.write_chunks(str(folder / "out"), chop=100.0, query={"orid": rows["long.wav"]}).collect()
    assert len(chunks) == 4
    part, _ = dsp.decode(open(chunks[2].path, "rb").read())
    np.testing.assert_allclose(part, whole[:, 200 * RATE : 300 * RATE], atol=1e-4)


def test_annotation_windows_by_range(spark, folder):
    """Spectrograms and masks of windows are those cut out of the whole recording's, for every kind of mask."""
    from chirplake.operators.geometry import annotation_matrices, draw, profile, window_of

    verts = {1: [[3.0, 500.0], [9.0, 3500.0], [12.0, 100.0]], 2: None, 3: [[399.0, 10.0], [400.0, 4000.0]]}
    boxes = {1: ("linestring", 3.0, 12.0, 100.0, 3500.0), 2: ("bbox", 100.0, 101.0, 1000.0, 1200.0), 3: ("linestring", 399.0, 400.0, None, None)}
    notes = [(i, kind, a, b, lo, hi, verts[i]) for i, (kind, a, b, lo, hi) in boxes.items()]
    path = str(folder / "long.wav")
    kinds = "orid long, path string, media_info struct<timeexp: double>, data array<struct<id: long, notetype: string, start_time: double, end_time: double, min_freq: double, max_freq: double, verts: array<array<double>>>>"
    df = spark.createDataFrame([(7, path, (1.0,), notes)], kinds)
    whole, _ = dsp.decode((folder / "long.wav").read_bytes())
    spec = dsp.spectrogram(dsp.pick_channel(whole, None), 256, 128)
    duration, top = whole.shape[1] / RATE, RATE / 2
    for size, masks in (((None, None), "window"), ((5.0, 3000.0), "window"), ((None, None), "time"), ((2.0, None), "frequency")):
        got = {r.id: r for r in annotation_matrices(df, size, n_fft=256, hop=128, masks=masks).collect()}
        for i, (kind, a, b, lo, hi) in boxes.items():
            low, high = lo or 0.0, hi or top
            points = verts[i] or [[a, low], [b, low], [b, high], [a, high]]
            w = window_of((a, b, low, high), duration, top, spec.shape, size)
            mask = w.cut(draw(points, duration, top, spec.shape, kind == "bbox"))
            np.testing.assert_allclose(np.array(got[i].spec), w.cut(spec), rtol=1e-9, atol=1e-12)
            assert (np.array(got[i].mask) == (mask if masks == "window" else profile(mask, masks)[None, :])).all() and np.any(mask)
    assert annotation_matrices(df, n_fft=256, hop=128, masks="whole").where("spec IS NULL").count() == 3
