import random
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from chirplake.functions import timefns


def test_cells_follow_python(spark):
    rng = random.Random(0)
    units = [(rng.uniform(-4e5, 4e5), u, m) for u, m in ((3600, 24), (900, 7), (60, 10)) for _ in range(300)]
    units += [(1800.0, 3600, 24), (5400.0, 3600, 24), (-1800.0, 3600, 24), (85800.0, 3600, 24)]
    for u, m in {(u, m) for _, u, m in units}:
        rows = [s for s, a, b in units if (a, b) == (u, m)]
        got = [r[0] for r in spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "i int, s double").orderBy("i").select(timefns.time_cell(F.col("s"), 0.0, u, m)).collect()]
        assert got == [int(round((s % (u * m)) / u)) % m for s in rows]


def test_localize_takes_standard_time_in_folds(spark):
    zones = ["America/New_York", "Europe/Madrid", "America/Mexico_City"]
    walls = [datetime(2020, 11, 1, 0, 30) + timedelta(minutes=15 * i) for i in range(12)] + [datetime(2020, 10, 25, 1, 0) + timedelta(minutes=15 * i) for i in range(12)]
    df = spark.createDataFrame([(z, w) for z in zones for w in walls], "z string, w timestamp_ntz")
    for r in df.withColumn("utc", timefns.localize(F.col("w"), F.col("z"))).collect():
        fold = r.w.replace(tzinfo=ZoneInfo(r.z), fold=1).astimezone(ZoneInfo("UTC")).replace(tzinfo=None)
        assert r.utc == fold, (r.z, r.w)


def test_time_fields(spark):
    df = spark.createDataFrame([("03-02-2020 04:05:06", "America/Mexico_City", 90.5), ("bad", "UTC", 1.0)], "t string, z string, d double")
    good, bad = df.select(*[c.alias(k) for k, c in timefns.time_fields(F.col("t"), F.col("z"), F.col("d")).items()]).collect()
    start = datetime(2020, 2, 3, 4, 5, 6, tzinfo=ZoneInfo("America/Mexico_City"))
    assert (good.absStart, good.absStop) == (start.timestamp(), start.timestamp() + 90.5)
    assert good.standardStart == "2020-02-03 04:05:06-06:00" and good.standardStop.startswith("2020-02-03 04:06:36")
    assert bad.absStart is None


def test_patterns():
    assert timefns.java_pattern("%Y-%m-%dT%H:%M:%S") == "yyyy-MM-dd'T'HH:mm:ss"
    with pytest.raises(ValueError):
        timefns.java_pattern("%Q")
