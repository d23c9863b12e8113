"""Dumps of statements: written, read by ranges, equal."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from chirplake.plans.collection import Collection
from chirplake.schema import TABLES
from chirplake.sources import statements

HARD = ["plain", "it's; quoted", "a');\nINSERT INTO \"t\" VALUES(9,'no');", "", "'", "''", ";", "é;'é", "\n;\n", "x" * 5000 + "';" * 50, "NULL", "1e5"]


def pieces(path, size, whole):
    """The statements of all ranges, each found without what is before it."""
    out = []
    for start in range(0, len(whole), size):
        inside = whole[:start].count(b"'") % 2 == 1
        out += statements.range_statements(str(path), start, min(start + size, len(whole)), inside)
    return [s.strip() for s in out if s.strip()]


@pytest.mark.parametrize("seed", range(6))
def test_every_range_size_gives_the_same_statements(tmp_path, monkeypatch, seed):
    rng = random.Random(seed)
    want = []
    for i in range(30):
        text = rng.choice(HARD[:9]).replace("'", "''")
        want.append(f"INSERT INTO \"t\" VALUES({i},'{text}');" if rng.random() < 0.8 else "COMMIT;")
    whole = ("\n" * (seed % 2)).join(want).encode()
    (tmp_path / "d.sql").write_bytes(whole)
    for block in (3, 64, 1 << 20):
        monkeypatch.setattr(statements, "BLOCK", block)
        for size in (1, 2, 7, 40, 333, 10_000):
            assert pieces(tmp_path / "d.sql", size, whole) == want


def test_values():
    one = lambda s: [(n, c, v) for n, c, v in statements.parsed(s)]
    assert one("INSERT INTO \"a\"\"b\" VALUES(1,-2.5e3,NULL,'it''s','',X'4142');") == [('a"b', None, ["1", "-2.5e3", None, "it's", "", "AB"])]
    assert one(" insert into t (x, \"y\") values ( 1 , 'b' ) , (2,'c');") == [("t", ["x", "y"], ["1", "b"]), ("t", ["x", "y"], ["2", "c"])]
    assert one("CREATE TABLE t (a);") == one("-- INSERT") == one("") == []
    for wrong in ("INSERT INTO t VALUES(1;", "INSERT INTO t VALUES(1 2);", "INSERT INTO t VALUES();"):
        with pytest.raises(ValueError):
            one(wrong)


KINDS = "k long, s string, d double, b boolean, a array<string>, m struct<x: double, y: string>"


def test_tables_come_back(spark, tmp_path, monkeypatch):
    rows = [(i, s, float(i) / 3, i % 2 == 0, [s, "'"] if i % 3 else None, (1.5, s)) for i, s in enumerate(HARD)] + [(None, None, None, None, None, None), (99, "x", float("inf"), True, [], (None, None))]
    df = spark.createDataFrame(rows * 20, KINDS).repartition(3)
    statements.write_statements({"t": df, "e": df.limit(0)}, str(tmp_path / "dump"))
    for size in (1000, None):
        got = statements.read_statements(spark, str(tmp_path / "dump"), {"t": df.schema, "e": df.schema}, size)
        assert sorted(map(str, got["t"].collect())) == sorted(map(str, df.collect())) and got["e"].count() == 0
    lines = [x for f in (tmp_path / "dump" / "t.sql").glob("part*") for x in [f.read_text()]]
    base = sqlite3.connect(":memory:")
    for text in sorted(lines, key=lambda x: not x.startswith("CREATE")):
        base.executescript(text)  # another engine takes it as it is
    assert base.execute("select count(*), count(distinct s) from t").fetchone() == (len(rows) * 20, len(HARD) + 1)


def test_a_dump_of_another_engine(spark, tmp_path):
    base = sqlite3.connect(":memory:")
    base.execute("create table t (k integer, s text, d real)")
    base.executemany("insert into t values (?, ?, ?)", [(i, s, i / 7) for i, s in enumerate(HARD * 5)])
    (tmp_path / "all.sql").write_text("\n".join(base.iterdump()))
    schema = spark.createDataFrame([], "k long, s string, d double").schema
    got = statements.read_statements(spark, str(tmp_path / "all.sql"), {"t": schema}, 700)["t"]
    assert sorted(map(tuple, got.collect())) == sorted(base.execute("select * from t").fetchall())


def test_nothing_is_read_from_the_start(tmp_path, monkeypatch):
    text = "".join(f"INSERT INTO \"t\" VALUES({i},'{'v' * 100}');\n" for i in range(2000))
    (tmp_path / "d.sql").write_text(text)
    reads = []
    plain = statements.RangedFile.at
    monkeypatch.setattr(statements.RangedFile, "at", lambda self, a, n: reads.append((a, n)) or plain(self, a, n))
    monkeypatch.setattr(statements, "BLOCK", 4096)
    start = len(text) // 2
    assert len(list(statements.range_statements(str(tmp_path / "d.sql"), start, start + 5000, False))) > 30
    assert min(a for a, _ in reads) == start - 1 and sum(n for _, n in reads) < 5000 + 3 * 4096


def test_collections(spark, tmp_path):
    records = [{"path": f"/r/{i}", "timeexp": 1.0, "note": s} for i, s in enumerate(HARD)]
    media = spark.createDataFrame([(f"/r/{i}", f"m{i}", 10, 8000, 2, 1, 8000) for i in range(len(HARD))], "path string, md5 string, filesize long, samplerate int, sampwidth int, nchannels int, nframes long")
    col = Collection(spark, "c").insert_media(records, media)
    col.annotate(col.tables["parsed"].select(F.lit("weak").alias("notetype"), "orid", *[F.lit(0.1).alias(c) for c in ("start_time", "end_time", "duration")], *[F.lit('{"a": "it\'s;"}').alias(c) for c in ("label", "groups", "metadata")]))
    col.dump(str(tmp_path / "dump"), form="sql")
    assert col.as_statements().count() == sum(df.count() for df in col.tables.values())
    other = Collection(spark, "c").load_statements(str(tmp_path / "dump"))
    moved = col.transfer(str(tmp_path / "moved"))
    for name in TABLES:
        want = sorted(map(str, col.tables[name].collect()))
        assert want and sorted(map(str, other.tables[name].collect())) == want and sorted(map(str, moved.tables[name].collect())) == want
    with pytest.raises(ValueError):
        other.load_statements(str(tmp_path / "dump"))
