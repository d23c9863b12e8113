import numpy as np
import pytest
from pyspark.sql import functions as F

from chirplake.functions import arrays, dsp
from chirplake.operators import aggregates, chunks, geometry, joins, sampling


@pytest.mark.parametrize("duration,rows", [(0.0, 0), (29.0, 0), (30.0, 0), (31.0, 1), (90.0, 2), (150.0, 2), (180.0, 3)])
def test_chunks_round_half_to_even(spark, duration, rows):
    df = spark.createDataFrame([(1, duration, 1.5e9)], "orid long, fileDuration double, absStart double")
    got = chunks.split_time(df, 60).orderBy("chunkFileStart").collect()
    assert len(got) == rows == max(int(round(duration / 60)), 0)
    for k, r in enumerate(got):
        start, stop = k * 60.0, min((k + 1) * 60.0, duration)
        assert r.chunkId == f"1-{1.5e9 + start}-{1.5e9 + stop}" and r.channel == 99


def test_export_limits(spark):
    df = spark.createDataFrame([(1, 250.0), (2, 59.0), (3, 100.0)], "orid long, duration double")
    got = {}
    for r in chunks.export_limits(df, 100, 1.0).orderBy("orid", "number").collect():
        got.setdefault(r.orid, []).append(list(r.tlimits))
    assert got == {1: [[0, 100], [100, 200], [200, 250]], 2: [[0, 59]], 3: [[0, 100]]}


def test_samples(spark):
    df = spark.range(100).select(F.col("id").alias("orid"), F.when(F.col("id") < 90, F.col("id") % 3).alias("g"))
    one = sampling.stratified_sample(df, ["g", "none"], 5)
    assert sorted(r["count"] for r in one.groupBy("g").count().collect()) == [5, 5, 5]
    assert one.subtract(sampling.stratified_sample(df.repartition(7), ["g"], 5)).count() == 0
    assert sampling.stratified_sample(df, ["g"], -1).count() == 100
    assert sampling.stratified_sample(df, ["g"], 200).count() == 90  # a null key is no group
    again = sampling.stratified_sample(df, ["g"], 5, replace=True)
    assert sorted(r["count"] for r in again.groupBy("g").count().collect()) == [5, 5, 5]
    shares = sampling.dataset_split(spark.range(2000), "id").groupBy("split").count().collect()
    assert abs(next(r["count"] for r in shares if r.split == "train") - 1400) < 100


def test_percentiles_bracketed(spark, monkeypatch):
    """Exact also where a sketch is coarse, values repeat, are null or all the same."""
    monkeypatch.setattr(aggregates, "ACCURACY", 50)
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.normal(size=3000), rng.integers(0, 5, 3000), np.full(3000, 2.0)])
    rows = [(i, *map(float, v)) for i, v in enumerate(x)] + [(3000, None, None, None)]
    df = spark.createDataFrame(rows, "orid long, `a.b` double, c double, d double")
    got = aggregates.exact_percentiles(df, ["a.b", "c", "d"], (0, 12.5, 50, 100))
    assert np.allclose(got, np.percentile(x, [0, 12.5, 50, 100], axis=0).T, atol=1e-12)
    assert aggregates.exact_percentiles(df.limit(0), ["c"], (20,)) == [[None]]
    assert aggregates.percentile_scores(df, ["a.b", "c"], (20, 60)).where("score IS NULL").count() == 1


def test_percentiles_by_group(spark, monkeypatch):
    """Each group's own, also where a group is null, tiny, all null or most of the rows; nothing runs before the result does."""
    monkeypatch.setattr(aggregates, "ACCURACY", 50)
    rng = np.random.default_rng(4)
    sizes = {"big": 2500, "b": 300, "one": 1, None: 40}
    rows = [(f"{g}{i}", g, float(v), float(rng.integers(0, 4))) for g, n in sizes.items() for i, v in enumerate(rng.normal(size=n))]
    rows += [(f"n{i}", "none", None, 1.0) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, `g.x` string, a double, `b.c` double")
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("lazy"))
    spark.sparkContext.setJobGroup("lazy", "")
    scored = aggregates.percentile_scores(df, ["a", "b.c"], (10, 62.5), ["g.x"])
    table = aggregates.percentile_table(df, ["a", "b.c"], (10, 62.5), ["g.x"])
    assert jobs() == 0
    got = {(r["g.x"], r["level"], r["percentile"]): r["value"] for r in table.collect()}
    assert len(got) == 4 * 4 + 2
    want = {}
    for g in sizes:
        own = np.array([r[2:] for r in rows if r[1] == g])
        want[g] = np.percentile(own, [10, 62.5], axis=0)
        for level in (0, 1):
            for j in (0, 1):
                assert got[g, level, j] == pytest.approx(want[g][j, level], abs=1e-12)
    for r in scored.collect():
        if r["g.x"] == "none":
            assert r.score is None
        else:
            lim = want[r["g.x"]]
            assert r.score == int(lim[0, 0] <= r.a <= lim[1, 0]) + int(lim[0, 1] <= r["b.c"] <= lim[1, 1])
    top = aggregates.top_scores(scored, 3, ["k"], ["g.x"]).collect()
    assert sorted((str(r["g.x"]) for r in top)) == sorted(["big"] * 3 + ["b"] * 3 + ["one"] + ["None"] * 3 + ["none"] * 3)


def test_percentiles_of_few_rows(spark):
    """Groups of one to thirty rows: ranks are rounded another way than the sketch's."""
    rng = np.random.default_rng(9)
    rows = [(n, float(v)) for n in range(1, 31) for v in rng.normal(size=n)]
    at = (0, 1, 10, 30, 33.3, 50, 62.5, 90, 99.5, 100)
    got = aggregates.percentile_table(spark.createDataFrame(rows, "g int, v double"), ["v"], at, ["g"]).collect()
    want = {n: np.percentile([v for g, v in rows if g == n], at) for n in range(1, 31)}
    assert len(got) == 300 and all(r.value == pytest.approx(want[r.g][r.percentile], abs=1e-12) for r in got)


def test_dotted_fields(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(30)], "orid long, `site.id` long")
    assert {(r[0], r[1]) for r in aggregates.group_counts(df, ["site.id"]).collect()} == {(0, 10), (1, 10), (2, 10)}
    assert sampling.stratified_sample(df, ["site.id"], 2).columns == df.columns
    for replace in (False, True):
        assert sampling.stratified_sample(df, ["site.id"], 2, replace).count() == 6
    assert aggregates.combinations(df, ["site.id"]).count() == 3


def test_annotations_of_no_recording(spark):
    """They don't reach the grouping, however many they are."""
    notes = spark.createDataFrame([(i, None, "x") for i in range(50)] + [(99, 1, "y")], "id long, orid long, label string")
    media = spark.createDataFrame([(1, "x")], "orid long, media_info string")
    nested = joins.annotated(notes, media)
    assert "isnotnull(orid" in nested._jdf.queryExecution().optimizedPlan().toString()
    assert [len(r.data) for r in nested.collect()] == [1]


def test_annotated_media(spark):
    notes = spark.createDataFrame([(1, 10, '{"sp": "a"}'), (2, 10, '{"sp": "b"}'), (3, 10, '{"sp": "a"}'), (4, None, "{}"), (5, 77, "{}")], "id long, orid long, label string")
    media = spark.createDataFrame([(10, "x"), (11, "y")], "orid long, media_info string")
    (row,) = joins.annotated(notes, media).collect()
    assert [d.id for d in row.data] == [1, 2, 3] and row.data[0].atype == "single"
    (row,) = joins.annotated(notes, media, {"id": {"$gt": 0}}, (), ("orid", "label.sp")).collect()
    assert [(d.gkey_label_sp, d.atype, [n.id for n in d.data]) for d in row.data] == [("a", "group", [1, 3]), ("b", "group", [2])]
    nested = joins.annotated(notes, media, None, (), ("label.sp",))
    assert {(r.id, r.gkey_label_sp) for r in geometry.notes(nested).collect()} == {(1, "a"), (2, "b"), (3, "a")}
    assert geometry.notes(joins.annotated(notes, media)).count() == 3


def test_matrix_and_percentiles(spark):
    df = spark.createDataFrame([(0, 1.0, None), (0, 3.0, 2.0), (2, 5.0, 4.0)], "timeCell long, a double, b double")
    got = {(r.timeCell, r.level): (r.value, r.norm) for r in aggregates.crono_matrix(df, ["a", "b"], 0, 2).collect()}
    assert got[0, "a"] == (2.0, 0.25) and got[0, "b"] == (1.0, 0.0) and got[1, "a"] == (None, None) and got[2, "a"] == (5.0, 1.0)
    x = np.random.default_rng(0).normal(size=(200, 2))
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "orid long, a double, b double")
    low, high = np.percentile(x, 20, axis=0), np.percentile(x, 60, axis=0)
    want = ((x >= low) & (x <= high)).sum(axis=1)
    assert [r.score for r in aggregates.percentile_scores(rows, ["a", "b"], (20, 60)).orderBy("orid").collect()] == want.tolist()


def test_array_columns(spark):
    df = spark.createDataFrame([(1, [1.0, -1.0, 3.0], [[1.0, 2.0], [3.0, 4.0]]), (2, [2.0, 2.0], [[5.0, 6.0]])], "i int, x array<double>, c array<array<double>>")
    a, b = df.select(arrays.min_max_norm(F.col("x")).alias("n"), arrays.channel_mean(F.col("c")).alias("m"), arrays.zero_crossing_rate(F.col("x")).alias("z")).collect()
    assert a.n == [0.5, 0.0, 1.0] and a.m == [2.0, 3.0] and a.z == pytest.approx(2 / 3)
    assert b.n == [None, None] and b.m == [5.0, 6.0] and b.z == 0
    assert arrays.level_range((2000, 5000), 0, 10000, 10) == (2, 5)
    with pytest.raises(ValueError):
        arrays.level_range((5, 5), 0, 10, 2)


def test_signals():
    rate, n = 22050, 22050 * 3
    x = np.sin(2 * np.pi * 1000 * np.arange(n) / rate)
    spec = dsp.spectrogram(x, 1024, 512)
    freqs = dsp.frequencies(rate, 1024)
    assert spec.shape == (513, 1 + n // 512)
    assert abs(freqs[spec[:, 10:-10].mean(axis=1).argmax()] - 1000) < rate / 1024
    assert dsp.zcr(x)[5] == pytest.approx(2 * 1000 / rate, rel=0.05)
    assert dsp.mfcc(x, rate).shape[0] == 20
    data = dsp.encode(np.stack([x, -x]) * 0.5, rate)
    back, sr = dsp.decode(data, 1.0, 1.0)
    assert sr == rate and back.shape == (2, rate) and np.abs(back[0] - 0.5 * x[rate : 2 * rate]).max() < 1e-4
    assert dsp.wav_info(data) == {"samplerate": rate, "nchannels": 2, "sampwidth": 2, "nframes": n}
    half, sr = dsp.decode(data, sr=11025)
    assert half.shape == (2, n // 2) and sr == 11025
    assert dsp.spectrogram(np.zeros(10)).shape[0] == 513
    bands = dsp.frequency_bands(freqs, (0, 10000), 10)
    frames, weight, values = dsp.slice_energy(spec, 3.0, 0.0, 43, bands)
    assert values.index(max(values)) in (0, 1) and weight == 1 and frames == 43
    assert dsp.slice_energy(spec, 3.0, 2.9, 43, bands)[2] == [0.0] * 10


def test_windows_and_masks():
    w = geometry.window_of((4.0, 5.0, 1000, 2000), 10.0, 5000, (100, 200), (4.0, None))
    assert w.time[1] - w.time[0] == 80 and w.freq == (20, 40) and w.before == (0, 0)
    edge = geometry.window_of((0.0, 1.0, 0, 1000), 10.0, 5000, (100, 200), (4.0, None))
    assert edge.before[0] == 30 and edge.cut(np.ones((100, 200))).shape == (20, 80)
    long = geometry.window_of((0.0, 9.0, 0, 1000), 10.0, 5000, (100, 200), (3.0, None), truncate=True)
    assert long.cut(np.ones((100, 200))).shape[1] == 60
    mask = geometry.draw([[0, 0], [10, 5000]], 10.0, 5000, (50, 50))
    assert mask[np.arange(50), np.arange(50)].all() and mask.sum() < 200
    assert geometry.profile(mask, "time").all() and not geometry.draw([], 1, 1, (3, 3)).any()
